"""Inference: what occurs at each path of all records, gathered level by level in one aggregation each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import raw_tag, value_tag
from ..types import TAGS

Path = tuple[str, ...]


@dataclass
class Field:
    """One key of the objects at a path: how often which tag, and what its arrays hold."""

    tags: dict[str, int] = field(default_factory=dict)
    nulls: int = 0
    objects: int = 0
    object_arrays: int = 0
    scalar_arrays: int = 0
    empty_arrays: int = 0
    element_objects: int = 0
    element_tags: dict[str, int] = field(default_factory=dict)
    element_nulls: int = 0
    max_len: int = 0
    element_max_len: int = 0
    stray_scalars: int = 0  # scalars in arrays that hold objects too

    @property
    def scalars(self) -> int:
        """Values that make it a column, nulls among them."""
        return sum(self.tags.values()) + self.nulls

    @property
    def total(self) -> int:
        return self.scalars + self.objects + self.object_arrays + self.scalar_arrays + self.empty_arrays

    @property
    def kind(self) -> str | None:
        """The child table: an array of objects before an object before an array of scalars."""
        return "object_array" if self.object_arrays else "object" if self.objects else "scalar_array" if self.scalar_arrays else None

    def merge(self, other: Field) -> Field:
        out = Field()
        for name, a in vars(self).items():
            b = getattr(other, name)
            v = {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}} if isinstance(a, dict) else max(a, b) if name.endswith("max_len") else a + b
            setattr(out, name, v)
        return out


@dataclass
class Stats:
    """Fields by path and key, and the number of objects at each path."""

    rows: dict[Path, int]
    fields: dict[Path, dict[str, Field]]

    def merge(self, other: Stats) -> Stats:
        """The statistics of both inputs together."""
        rows = {p: self.rows.get(p, 0) + other.rows.get(p, 0) for p in {*self.rows, *other.rows}}
        fields: dict[Path, dict[str, Field]] = {}
        for p in {*self.fields, *other.fields}:
            a, b = self.fields.get(p, {}), other.fields.get(p, {})
            fields[p] = {k: a[k].merge(b[k]) if k in a and k in b else a.get(k) or b[k] for k in {*a, *b}}
        return Stats(rows, fields)


def level_fields(nodes: DataFrame) -> DataFrame:
    """A row for each value below the nodes (path, v); arrays give one for each element, empty ones a null."""
    rows = nodes.lateralJoin(nodes.sparkSession.tvf.variant_explode(F.col("v").outer())).select("path", "key", F.col("value").alias("x"))
    rows = rows.withColumn("schema", F.schema_of_variant("x"))
    s, is_array = F.col("schema"), F.col("schema").startswith("ARRAY")
    items = F.when(is_array, F.try_variant_get("x", "$", "array<variant>")).otherwise(F.array("x"))
    rows = rows.select("path", "key", is_array.alias("in_array"), items.alias("items"), s.startswith("ARRAY<OBJECT").alias("all_objects"), s.startswith("ARRAY<VARIANT").alias("various"))
    # only items that have no type in common need to be looked at one by one
    some = F.when(F.col("various"), F.exists("items", lambda i: F.schema_of_variant(i).startswith("OBJECT"))).otherwise(F.col("all_objects"))
    rows = rows.withColumn("with_objects", F.coalesce(F.col("in_array") & some, F.lit(False)))
    out = rows.select("path", "key", "in_array", "with_objects", F.posexplode_outer("items").alias("pos", "item"))
    out = out.withColumn("raw", raw_tag(F.col("item")))
    return out.withColumn("tag", value_tag(F.col("item"), F.col("raw")))


def level_stats(fields: DataFrame) -> DataFrame:
    """A row for each path, key, kind of place (in an array or not, ...) and tag: how many, and how long its strings get."""
    first = F.col("in_array") & F.coalesce(F.col("pos") == 0, F.lit(True))
    size = F.when(F.col("raw") == "string", F.octet_length(F.try_variant_get("item", "$", "string")))
    places = ["path", "key", "in_array", "with_objects", first.alias("first"), F.isnull("pos").alias("empty"), "tag"]
    return fields.select(*places, size.alias("size")).groupBy("path", "key", "in_array", "with_objects", "first", "empty", "tag").agg(F.count("*").alias("n"), F.max("size").alias("longest"))


def gathered(f: Field, r) -> None:
    """Add a row of level_stats to its field."""
    n, tag, longest = r["n"], r["tag"], r["longest"] or 0
    if not r["in_array"]:
        if tag in f.tags:
            f.tags[tag] += n
        f.nulls += n * (tag == "null")
        f.objects += n * (tag == "object")
        f.max_len = max(f.max_len, longest)
        return
    if r["first"]:
        f.object_arrays += n * r["with_objects"]
        f.scalar_arrays += n * (not r["with_objects"] and not r["empty"])
        f.empty_arrays += n * r["empty"]
    if r["with_objects"]:
        f.element_objects += n * (tag == "object")
        f.stray_scalars += n * (tag is not None and tag != "object")
    else:
        if tag in f.element_tags:
            f.element_tags[tag] += n
        f.element_nulls += n * (tag == "null")
        f.element_max_len = max(f.element_max_len, longest)


def child_nodes(fields: DataFrame) -> DataFrame:
    return fields.filter(F.col("tag") == "object").select(F.concat("path", F.array("key")).alias("path"), F.col("item").alias("v"))


def infer(records: DataFrame, root: str, max_depth: int = 100) -> Stats:
    """Statistics of (doc_id, v). One job a level; what comes to the driver are a few rows for each path and key."""
    stats = Stats({(root,): records.count()}, {})
    nodes = records.select(F.array(F.lit(root)).alias("path"), "v")
    for depth in range(1, max_depth + 1):
        fields = level_fields(nodes)
        for r in level_stats(fields).collect():
            if r["key"] is not None:  # an empty object has none
                f = stats.fields.setdefault(tuple(r["path"]), {}).setdefault(r["key"], Field(dict.fromkeys(TAGS, 0), element_tags=dict.fromkeys(TAGS, 0)))
                gathered(f, r)
        deeper = False
        for path in [p for p in stats.fields if len(p) == depth]:
            for key, f in stats.fields[path].items():
                if n := f.objects + f.element_objects:
                    stats.rows[(*path, key)] = n
                    deeper = True
        if not deeper:
            return stats
        nodes = child_nodes(fields)
    raise ValueError(f"records are nested deeper than {max_depth} levels")


def mixed_columns(stats: Stats) -> list[tuple[Path, str, dict[str, int]]]:
    """Columns in which more than one tag occurs."""
    return [(p, k, {t: n for t, n in f.tags.items() if n}) for p in sorted(stats.fields) for k, f in sorted(stats.fields[p].items()) if sum(1 for n in f.tags.values() if n) > 1]
