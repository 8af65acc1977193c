"""Layouts and types that the user sets: functions on the catalogue, and their TOML form."""

from __future__ import annotations

import tomllib

from ..naming import column_names, sanitize, truncated
from ..types import JSONB, TEXT, parse_type
from . import catalog as C
from .siblings import columns_for, union_columns
from .suffix import detect, explicit

RESERVED = ("strategy", "suffix_columns", "id_column", "prefix", "max_depth")


class OverrideError(ValueError):
    pass


def _table(catalog: C.Catalog, name: str) -> C.Table:
    if t := catalog.get(name):
        return t
    raise OverrideError(f"no table {name}")


def set_layout(catalog: C.Catalog, name: str, layout: str) -> C.Catalog:
    """pivot, jsonb or columns; columns come back from the statistics."""
    out = catalog.copy()
    C.set_layout(out, _table(out, name), layout)
    return out.exclude_absorbed()


def structured_pivot(catalog: C.Catalog, name: str, suffixes: list[str] | None = None) -> C.Catalog:
    out = catalog.copy()
    t = _table(out, name)
    types = {c.key: c.type for c in t.data if c.role == "field"}
    found = explicit(types, suffixes) if suffixes else detect(types)
    if not found:
        raise OverrideError(f"{name}: no common suffix")
    C.structured_pivot(out, t, found)
    return out.exclude_absorbed()


def normalize(catalog: C.Catalog, name: str, id_column: str = "key_id") -> C.Catalog:
    """The object children of a table become its rows, with their keys in id_column."""
    out = catalog.copy()
    t = _table(out, name)
    members = [c for c in out.children(name) if c.kind == "object" and c.layout == "columns"]
    if not members:
        raise OverrideError(f"{name} has no object children")
    base = C.with_parent(out, t)
    t.columns = [*base, C.Column(id_column, id_column, TEXT, "key", True), *union_columns(members, {c.name for c in base} | {id_column})]
    t.layout, t.params = "normalize", {"array": False}
    return out.exclude_absorbed()


def flatten(catalog: C.Catalog, name: str, prefix: str | None = None, max_depth: int = 1) -> C.Catalog:
    """A table's columns become columns of its parent, prefixed; names that the parent has already are left out."""
    out = catalog.copy()
    t = _table(out, name)
    if not t.parent:
        raise OverrideError("the root has no parent to be flattened into")
    if t.kind != "object":
        raise OverrideError(f"{name} has several rows for one of its parent's")
    parent = _table(out, t.parent)
    prefix = f"{t.name}_" if prefix is None else prefix
    taken = {c.name for c in parent.columns}
    for c in t.data:
        if c.role == "field" and (new := truncated(prefix + c.name)) not in taken:
            parent.columns.append(C.Column(new, c.key, c.type, "flat", source=t.key))
    t.layout, t.params = "flatten", {"max_depth": max_depth}
    out.exclude_absorbed()
    return skip(out, name)


def jsonb_flatten(catalog: C.Catalog, name: str) -> C.Catalog:
    """A child, whole, becomes a JSON column of its parent."""
    out = catalog.copy()
    t = _table(out, name)
    if not t.parent:
        raise OverrideError("the root has no parent to be flattened into")
    _table(out, t.parent).columns.append(C.Column(t.name, t.key, JSONB, "flat_json", source=t.key))
    t.layout = "jsonb_flatten"
    out.exclude_absorbed()
    return skip(out, name)


def skip(catalog: C.Catalog, name: str) -> C.Catalog:
    """Without a table and all below it."""
    out = catalog.copy()
    _table(out, name)
    gone = {name}
    for t in out.tables:
        if t.parent in gone:
            gone.add(t.name)
    out.tables = [t for t in out.tables if t.name not in gone]
    return out


def merge_group(catalog: C.Catalog, group: str, members: list[str]) -> C.Catalog:
    """Given tables, wherever they are, as one with a key column."""
    out = catalog.copy()
    found = [_table(out, m) for m in members]
    if len(found) < 2:
        raise OverrideError(f"group {group}: at least two members are needed")
    if any(not t.parent for t in found):
        raise OverrideError(f"group {group}: the root can't be a member")
    array = any(t.kind == "object_array" for t in found)
    name = group if not out.get(group) else truncated(f"{group}_group")
    parents = {t.parent for t in found}
    parent = found[0].parent
    t = C.Table(sanitize(name), (*out[parent].path, name), "object_array" if array else "object", out[parent].depth + 1, parent, layout="keyed_pivot")
    t.columns = columns_for(out, C.generated(out.options, "object", parent if len(parents) == 1 else "parent"), "key_id", found, array)
    t.params = {"array": array, "members": [{"parent": m.parent, "key": m.key} for m in found]}
    out.tables.append(t)
    gone = {m.name for m in found}
    for x in out.tables:
        if x.parent in gone:
            gone.add(x.name)
    out.tables = [x for x in out.tables if x.name not in gone]
    return out.sorted()


def set_type(catalog: C.Catalog, table: str, column: str, kind: str) -> C.Catalog:
    out = catalog.copy()
    t, p = out.get(table), parse_type(kind)
    if t is None:
        out.warnings.append(f"no table {table}")
    elif t.column(column) is None:
        out.warnings.append(f"no column {table}.{column}")
    elif p is None:
        out.warnings.append(f"no type {kind} for {table}.{column}")
    else:
        t.columns = [C.Column(c.name, c.key, p, c.role, c.not_null, c.source) if c.name == column else c for c in t.columns]
    return out


def apply_toml(catalog: C.Catalog, text: str) -> C.Catalog:
    """Types and single-table layouts first, then normalisation, flattening and groups."""
    config = tomllib.loads(text)
    groups = config.pop("group", {})
    out = catalog
    later = []
    for name, x in config.items():
        if not isinstance(x, dict):
            continue
        if out.get(name) is None:
            out = out.copy()
            out.warnings.append(f"no table {name}")
            continue
        for column, kind in x.items():
            if column not in RESERVED and isinstance(kind, str):
                out = set_type(out, name, column, kind)
        strategy = x.get("strategy")
        if strategy in ("pivot", "jsonb", "columns"):
            out = set_layout(out, name, strategy)
        elif strategy == "structured_pivot":
            out = structured_pivot(out, name, x.get("suffix_columns"))
        elif strategy == "normalize_dynamic_keys":
            later.append((0, lambda c, n=name, x=x: normalize(c, n, x.get("id_column", "key_id"))))
        elif strategy == "flatten":
            later.append((1, lambda c, n=name, x=x: flatten(c, n, x.get("prefix"), x.get("max_depth", 1))))
        elif strategy in ("ignore", "skip"):
            later.append((1, lambda c, n=name: skip(c, n)))
        elif strategy == "jsonb_flatten":
            later.append((1, lambda c, n=name: jsonb_flatten(c, n)))
        elif strategy is not None:
            out = out.copy()
            out.warnings.append(f"{name}: no strategy {strategy}")
    for _, f in sorted(later, key=lambda p: p[0]):
        out = f(out)
    for name, g in groups.items():
        if g.get("strategy", "keyed_pivot") == "keyed_pivot":
            out = merge_group(out, name, g.get("members", []))
    return out
