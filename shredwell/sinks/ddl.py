"""DDL text for a catalogue."""

from __future__ import annotations

from ..naming import quoted, truncated
from ..plans.catalog import Catalog, Column, Table


def column_line(c: Column, p: str = "  ") -> str:
    return f"{p}{quoted(c.name)} {c.type}{' NOT NULL' if c.role in ('id', 'parent', 'order') else ''}"


def create_table(t: Table, schema: str, if_not_exists: bool = True, inline_parent: bool = False) -> str:
    lines = [column_line(c) for c in t.columns]
    key = next(c.name for c in t.columns if c.role == "id")
    lines.append(f"  CONSTRAINT {quoted(truncated('pk_' + t.name))} PRIMARY KEY ({quoted(key)})")
    if inline_parent and (fk := parent_reference(t)):
        lines.append(f"  CONSTRAINT {quoted(truncated(f'fk_{t.name}_parent'))} FOREIGN KEY ({quoted(fk[0])}) REFERENCES {quoted(schema)}.{quoted(fk[1])} ({quoted(key)})")
    return f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{quoted(schema)}.{quoted(t.name)} (\n" + ",\n".join(lines) + "\n);"


def parent_reference(t: Table) -> tuple[str, str] | None:
    c = next((c for c in t.columns if c.role == "parent"), None)
    return (c.name, t.parent) if c and t.parent else None


def foreign_key(t: Table, schema: str, key: str) -> str | None:
    """Added once: a constraint of that name that exists already is kept."""
    fk = parent_reference(t)
    if not fk:
        return None
    name = truncated(f"fk_{t.name}_parent")
    alter = f"ALTER TABLE {quoted(schema)}.{quoted(t.name)} ADD CONSTRAINT {quoted(name)} FOREIGN KEY ({quoted(fk[0])}) REFERENCES {quoted(schema)}.{quoted(fk[1])} ({quoted(key)})"
    return f"DO $$ BEGIN\n  {alter};\nEXCEPTION WHEN duplicate_object THEN NULL;\nEND $$;"


def referenced(catalog: Catalog, t: Table) -> bool:
    """Whether the parent's table has a row for each id that its children refer to."""
    p = catalog.get(t.parent) if t.parent else None
    return p is not None and p.layout in ("columns", "auto_split", "multi_keyed_pivot", "jsonb", "jsonb_guard")


def script(catalog: Catalog, drop_existing: bool | None = None) -> str:
    """Everything that a load needs, parents first."""
    o = catalog.options
    drop = o.drop_existing if drop_existing is None else drop_existing
    out = [f"DROP TABLE IF EXISTS {quoted(o.schema)}.{quoted(t.name)} CASCADE;" for t in reversed(catalog.tables)] if drop else []
    out += [create_table(t, o.schema, not drop) for t in catalog]
    out += [fk for t in catalog if referenced(catalog, t) and (fk := foreign_key(t, o.schema, f"{o.prefix}id"))]
    return "\n\n".join(out)


def preview(catalog: Catalog) -> str:
    return "\n\n".join(create_table(t, catalog.options.schema, True, referenced(catalog, t)) for t in catalog)


def spark_table(t: Table, name: str | None = None) -> str:
    from ..types import spark_type

    cols = ", ".join(f"`{c.name.replace('`', '``')}` {spark_type(c.type).simpleString()}{' NOT NULL' if c.role == 'id' else ''}" for c in t.columns)
    return f"CREATE TABLE IF NOT EXISTS {name or t.name} ({cols}) USING parquet"
