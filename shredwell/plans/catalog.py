"""The catalogue: a table for each path, and how its rows are laid out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..naming import TableNames, column_names, parent_column, truncated
from ..options import Options
from ..types import BIGINT, JSONB, TEXT, UUID, Phys, from_json, resolve, to_json, widen
from .infer import Path, Stats

#: Layouts whose tables hold what their children held.
ABSORBING = {"pivot", "jsonb", "structured_pivot", "keyed_pivot", "normalize", "flatten", "jsonb_flatten"}


@dataclass(frozen=True)
class Column:
    """role: id, parent, order, field, key, value, suffix, data (raw JSON), flat (a child's field), flat_json (a whole child)."""

    name: str
    key: str
    type: Phys
    role: str = "field"
    not_null: bool = False
    source: str | None = None  # the child's key, for flat columns

    @property
    def generated(self) -> bool:
        return self.role in ("id", "parent", "order") or (self.role == "data" and self.name.endswith("_data"))


@dataclass
class Table:
    """kind: root, object, object_array, scalar_array. layout: columns, pivot, jsonb, structured_pivot, auto_split,
    wide (its companion), keyed_pivot, multi_keyed_pivot, group (of one), normalize, flatten, jsonb_flatten."""

    name: str
    path: Path
    kind: str
    depth: int
    parent: str | None = None
    columns: list[Column] = field(default_factory=list)
    layout: str = "columns"
    params: dict = field(default_factory=dict)
    rows: int = 0

    @property
    def key(self) -> str:
        return self.path[-1]

    @property
    def data(self) -> list[Column]:
        return [c for c in self.columns if not c.generated]

    def generated_columns(self) -> list[Column]:
        return [c for c in self.columns if c.role in ("id", "parent", "order")]

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass
class Catalog:
    tables: list[Table]
    options: Options
    stats: Stats | None = None
    names_changed: list[tuple[str, str]] = field(default_factory=list)
    collisions: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def __getitem__(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)

    def get(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name == name), None)

    def __iter__(self):
        return iter(self.tables)

    def names(self) -> list[str]:
        return [t.name for t in self.tables]

    def children(self, name: str) -> list[Table]:
        return [t for t in self.tables if t.parent == name]

    def copy(self) -> Catalog:
        return replace(self, tables=[replace(t, columns=list(t.columns), params=dict(t.params)) for t in self.tables], warnings=list(self.warnings))

    def sorted(self) -> Catalog:
        self.tables.sort(key=lambda t: t.depth)  # stable: parents come first
        return self

    def exclude_absorbed(self) -> Catalog:
        """Without the tables whose rows another layout holds, and without all below them."""
        whole = {t.name for t in self.tables if t.layout in ABSORBING}
        gone = {n for t in self.tables if t.layout == "multi_keyed_pivot" for g in t.params["groups"] for n in g["absorbed"]}
        for t in self.tables:
            if t.parent and (t.parent in gone or (t.parent in whole and t.layout != "wide")):
                gone.add(t.name)
        self.tables = [t for t in self.tables if t.name not in gone]
        return self


def generated(o: Options, kind: str, parent: str | None, order: bool | None = None) -> list[Column]:
    out = [Column(f"{o.prefix}id", "", UUID, "id", True)]
    if parent:
        out.append(Column(parent_column(o.prefix, parent), "", UUID, "parent", True))
    if order if order is not None else kind in ("object_array", "scalar_array"):
        out.append(Column(f"{o.prefix}order", "", BIGINT, "order", True))
    return out


def build(stats: Stats, o: Options) -> Catalog:
    """A table for each path in plain columns, before any layout is chosen."""
    names, tables = TableNames(), []
    catalog = Catalog(tables, o, stats)
    (root,) = [p for p in stats.rows if len(p) == 1]
    todo: list[tuple[Path, str, str | None]] = [(root, "root", None)]
    while todo:
        path, kind, parent = todo.pop(0)
        name = names.name(path)
        t = Table(name, path, kind, len(path) - 1, parent, generated(o, kind, parent), rows=stats.rows.get(path, 0))
        tables.append(t)
        if kind == "scalar_array":
            f = stats.fields[path[:-1]][path[-1]]
            t.columns.append(Column("value", "value", resolve(f.element_tags, f.element_max_len, o.text_threshold), "value"))
            continue
        fields = stats.fields.get(path, {})
        ordered = sorted(fields, key=lambda k: k.encode())
        as_column = {k: o.array_columns and fields[k].kind == "scalar_array" for k in ordered}
        keys = [k for k in ordered if fields[k].scalars or as_column[k]]
        physical, clash = column_names(keys, {c.name for c in t.columns})
        catalog.collisions += [(name, k) for k in clash]
        for k in keys:
            f = fields[k]
            if as_column[k] and not sum(f.tags.values()):
                kind_of = Phys("array", element=resolve(f.element_tags, f.element_max_len, o.text_threshold))
                t.columns.append(Column(physical[k], k, kind_of))
            else:
                t.columns.append(Column(physical[k], k, resolve(f.tags, f.max_len, o.text_threshold), not_null=f.nulls == 0))
        for k in ordered:
            child = fields[k].kind
            if child and not as_column[k]:
                todo.append(((*path, k), child, name))
    catalog.names_changed = names.changed
    catalog.names_taken = names
    return catalog.sorted()


# ---- layouts of wide tables

MIN_ROWS, STABLE_SHARE = 10, 0.5


def choose_wide(catalog: Catalog) -> Catalog:
    from .suffix import detect

    o = catalog.options
    if not o.wide_threshold:
        return catalog
    for t in list(catalog.tables):
        fields = catalog.stats.fields.get(t.path, {})
        scalar = [c for c in t.data if c.role == "field"]
        if t.kind not in ("root", "object") or len(scalar) <= o.wide_threshold:
            continue
        share = {c.key: fields[c.key].scalars / max(t.rows, 1) for c in scalar}
        stable = [c for c in scalar if share[c.key] >= o.stable_threshold]
        if len(stable) / len(scalar) > STABLE_SHARE and t.rows >= MIN_ROWS:
            continue
        if t.kind == "root" and any(c.kind in ("object", "object_array") for c in catalog.children(t.name)):
            auto_split(catalog, t, share)
        elif suffixes := detect({c.key: c.type for c in scalar}):
            structured_pivot(catalog, t, suffixes)
        else:
            set_layout(catalog, t, "pivot" if len({c.type.category for c in scalar}) == 1 else "jsonb")
    return catalog.sorted()


def auto_split(catalog: Catalog, t: Table, share: dict[str, float]) -> None:
    """Frequent keys stay columns, less frequent ones become rows of a companion, rare ones go (they are reported)."""
    o = catalog.options
    scalar = [c for c in t.data if c.role == "field" and c.type.name != "array"]
    medium = [c for c in scalar if o.rare_threshold <= share[c.key] < o.stable_threshold]
    dropped = [c.key for c in t.data if c not in medium and not (c in scalar and share[c.key] >= o.stable_threshold)]
    t.columns = [c for c in t.columns if c.generated or (c in scalar and share[c.key] >= o.stable_threshold)]
    t.layout = "auto_split"
    if dropped:
        catalog.warnings.append(f"{t.name}: {len(dropped)} rare or array keys are left out: {', '.join(sorted(dropped))}")
    if not medium:
        return
    base = t.name[: -len("_wide")] if t.name.endswith("_wide") else t.name
    name = f"{base}_wide"
    if catalog.get(name):
        name = f"{base}_eav"
    name = catalog.names_taken.free(name)
    wide = Table(name, (*t.path, name), "wide", t.depth + 1, t.name, generated(o, "object", t.name), "wide", {"keys": [c.key for c in medium]}, 0)
    wide.columns += [Column("key", "key", TEXT, "key", True), Column("value", "value", widest(medium), "value")]
    catalog.tables.append(wide)


def widest(columns: list[Column]) -> Phys:
    out = columns[0].type if columns else TEXT
    for c in columns[1:]:
        out = widen(out, c.type)
    return out


def with_parent(catalog: Catalog, t: Table) -> list[Column]:
    """Generated columns of a table that has several rows for one object: a root refers to its own record's id."""
    out = t.generated_columns()
    return out if t.parent else [*out, Column(parent_column(catalog.options.prefix, t.name), "", UUID, "parent", True)]


def set_layout(catalog: Catalog, t: Table, layout: str) -> Table:
    o = catalog.options
    if layout == "pivot":
        t.columns = [*with_parent(catalog, t), Column("key", "key", TEXT, "key", True), Column("value", "value", widest([c for c in t.data if c.role == "field"]), "value")]
    elif layout == "jsonb":
        t.columns = [*t.generated_columns(), Column("data", "data", JSONB, "data")]
    elif layout == "columns":
        fresh = next((x for x in build(catalog.stats, o) if x.path == t.path), None) if catalog.stats else None
        if fresh:
            t.columns = fresh.columns
    t.layout, t.params = layout, {}
    return t


def structured_pivot(catalog: Catalog, t: Table, suffixes) -> Table:
    """suffixes: (list of (suffix, column, type), value type)."""
    found, value = suffixes
    t.columns = [*with_parent(catalog, t), Column("name", "name", TEXT, "key", True), Column("value", "value", value, "value"), *(Column(c, s, p, "suffix") for s, c, p in found)]
    t.layout, t.params = "structured_pivot", {"suffixes": [s for s, _, _ in found]}
    return t


def guard(catalog: Catalog) -> Catalog:
    """Tables of more columns than a database takes become one JSON column each; their children stay."""
    most = catalog.options.max_columns
    for t in catalog.tables:
        if most and t.layout in ("columns", "auto_split", "flatten") and len(t.columns) > most:
            n = len(t.columns)
            t.columns = [*t.generated_columns(), Column("data", "data", JSONB, "data")]
            t.layout, t.params = "jsonb_guard", {}
            catalog.warnings.append(f"{t.name}: {n} columns are more than {most}; stored as JSON")
    return catalog


def plan(stats: Stats, o: Options, layouts: bool = True) -> Catalog:
    from .siblings import merge_siblings

    catalog = build(stats, o)
    if layouts:
        catalog = merge_siblings(choose_wide(catalog)).exclude_absorbed()
        catalog = guard(catalog)
    if o.depth_limit is not None and any(t.depth > o.depth_limit for t in catalog):
        catalog.warnings.append(f"tables nest deeper than {o.depth_limit}")
    return catalog


# ---- snapshots

VERSION = 1


def to_snapshot(catalog: Catalog) -> dict:
    c = lambda x: {"name": x.name, "key": x.key, "type": to_json(x.type), "role": x.role, "not_null": x.not_null, "source": x.source}
    t = lambda x: {"name": x.name, "path": list(x.path), "kind": x.kind, "depth": x.depth, "parent": x.parent, "layout": x.layout, "params": x.params, "rows": x.rows, "columns": [c(y) for y in x.columns]}
    o = {k: v for k, v in vars(catalog.options).items()}
    rows = catalog.stats.rows.get(catalog.tables[0].path[:1], 0) if catalog.stats else catalog.tables[0].rows
    return {"version": VERSION, "total_rows": rows, "options": o, "schemas": [t(x) for x in catalog], "truncated_names": catalog.names_changed, "column_collisions": catalog.collisions}


def from_snapshot(x: dict) -> Catalog:
    if x.get("version") != VERSION:
        raise ValueError(f"snapshot version {x.get('version')} is not {VERSION}")
    tables = [Table(t["name"], tuple(t["path"]), t["kind"], t["depth"], t["parent"], [Column(c["name"], c["key"], from_json(c["type"]), c["role"], c["not_null"], c["source"]) for c in t["columns"]], t["layout"], t["params"], t["rows"]) for t in x["schemas"]]
    return Catalog(tables, Options(**x["options"]), None, [tuple(n) for n in x["truncated_names"]], [tuple(n) for n in x["column_collisions"]])
