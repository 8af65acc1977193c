"""Column statistics as a table and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import Catalog
from ..types import TAGS


def dominant(tags: dict[str, int]) -> str | None:
    """The most frequent tag; of equals the wider one."""
    best = max(tags.values(), default=0)
    return next((t for t in TAGS if best and tags.get(t) == best), None)


def rows(catalog: Catalog) -> list[tuple]:
    """(table, column, type, total, nulls, present, dominant, mixed, histogram) by table and column, from the inference's counts."""
    out = []
    for t in catalog:
        fields = catalog.stats.fields.get(t.path, {})
        for c in t.columns:
            if c.role == "field" and c.key in fields:
                f = fields[c.key]
                tags = {k: n for k, n in f.tags.items() if n}
                out.append((t.name, c.name, str(c.type), t.rows, f.nulls, f.scalars, dominant(tags), len(tags) > 1, tags))
    return sorted(out)


SCHEMA = "table string, column string, type string, total long, nulls long, present long, dominant string, mixed boolean, histogram map<string,long>"


def frame(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame(rows(catalog), SCHEMA)


def text(catalog: Catalog) -> str:
    lines, last = [], None
    for table, column, kind, total, nulls, present, _, mixed, tags in rows(catalog):
        if table != last:
            lines.append(f"{table} ({total} rows)")
            last = table
        note = f"  ** MIXED: {', '.join(f'{n} {t}' for t, n in sorted(tags.items(), key=lambda x: (-x[1], x[0])))} **" if mixed else ""
        lines.append(f"  {column}: {kind}, {present} present, {nulls} null{note}")
    return "\n".join(lines)
