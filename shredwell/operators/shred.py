"""Rows of each table of a catalogue, as DataFrames over the records. Expressions only; nothing runs until it is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import coerce
from ..functions.tags import raw_tag
from ..plans import catalog as C
from ..types import TEXT

LONGEST_EXAMPLE = 200


def member(v: Column, key: str) -> Column:
    """The value of a key, NULL if there is none."""
    if '"' not in key and "\\" not in key:
        return F.try_variant_get(v, f'$["{key}"]', "variant")
    if "'" not in key and "\\" not in key:
        return F.try_variant_get(v, f"$['{key}']", "variant")
    return F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


def identity(*parts: Column) -> Column:
    """The id of a row, by what it hangs on and where: md5 in the form of a UUID. Any job that derives it gets the same."""
    h = F.md5(F.concat(*parts))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def child_id(parent: Column, key: Column, at: Column | None = None) -> Column:
    return identity(parent, F.lit("/"), key) if at is None else identity(parent, F.lit("/"), key, F.lit("["), at.cast("string"), F.lit("]"))


def as_items(v: Column) -> Column:
    """Elements of an array, or a lone object as an array of one."""
    raw = raw_tag(v)
    return F.when(raw == "array", F.try_variant_get(v, "$", "array<variant>")).when(raw == "object", F.array(v))


def entries(objects: DataFrame) -> DataFrame:
    """A row for each key of each object: id, parent, ord, key, x."""
    e = F.explode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("e")
    return objects.select("id", "parent", "ord", e).select("id", "parent", "ord", F.col("e.key").alias("key"), F.col("e.value").alias("x"))


class Shredder:
    """objects(t) are the JSON objects at a table's path, rows(t) the table's typed rows before values and anomalies part."""

    def __init__(self, records: DataFrame, catalog: C.Catalog):
        self.records, self.catalog = records, catalog
        self._objects: dict[str, DataFrame] = {}
        self._rows: dict[str, DataFrame] = {}

    def objects(self, t: C.Table) -> DataFrame:
        """(id, parent, ord, v); scalar arrays have their elements as v."""
        if t.name in self._objects:
            return self._objects[t.name]
        if not t.parent:
            out = self.records.select(identity(F.lit(f"{t.path[0]}:"), F.col("doc_id")).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("ord"), "v")
        else:
            above = self.objects(self.catalog[t.parent]).select(F.col("id").alias("parent"), member(F.col("v"), t.key).alias("x"))
            key = F.lit(t.key)
            if t.kind == "object":
                out = above.filter(raw_tag(F.col("x")) == "object").select(child_id(F.col("parent"), key).alias("id"), "parent", F.lit(None).cast("long").alias("ord"), F.col("x").alias("v"))
            else:
                items = as_items(F.col("x")) if t.kind == "object_array" else F.when(raw_tag(F.col("x")) == "array", F.try_variant_get("x", "$", "array<variant>"))
                each = above.select("parent", F.posexplode(items).alias("ord", "v"))
                if t.kind == "object_array":
                    each = each.filter(raw_tag(F.col("v")) == "object")
                out = each.select(child_id(F.col("parent"), key, F.col("ord")).alias("id"), "parent", F.col("ord").cast("long").alias("ord"), "v")
        self._objects[t.name] = out
        return out

    def rows(self, t: C.Table) -> DataFrame:
        """A struct (value, bad, raw) for each data column, values for generated ones."""
        if t.name not in self._rows:
            self._rows[t.name] = LAYOUTS[t.layout](self, t)
        return self._rows[t.name]

    def typed(self, df: DataFrame, t: C.Table, value_of: Callable[[C.Column], Column | tuple[Column]]) -> DataFrame:
        """df has id, parent and ord; value_of gives a column's VARIANT, or a tuple of one value that is there already.

        Values come first, then their tags, then what uses both several times: Spark keeps such steps apart, so no
        value is looked up twice.
        """
        generated = {"id": "id", "parent": "parent", "order": "ord"}
        values = {i: value_of(c) for i, c in enumerate(t.columns) if c.role not in generated}
        ready = {i for i, v in values.items() if isinstance(v, tuple)}
        df = df.select("id", "parent", "ord", *[(v[0] if i in ready else v).alias(f"_v{i}") for i, v in values.items()])
        df = df.select("*", *[raw_tag(F.col(f"_v{i}")).alias(f"_r{i}") for i in values if i not in ready])
        out, none = [], F.lit(None).cast("string")
        for i, c in enumerate(t.columns):
            if c.role in generated:
                out.append(F.col(generated[c.role]).alias(c.name))
            elif i in ready:
                out.append(F.struct(F.col(f"_v{i}").alias("value"), none.alias("bad"), none.alias("raw")).alias(c.name))
            else:
                v, raw = F.col(f"_v{i}"), F.col(f"_r{i}")
                s = coerce(v, c.type, raw)
                text = F.when(s["bad"].isNotNull(), F.when(raw == "string", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))
                out.append(F.struct(s["value"].alias("value"), s["bad"].alias("bad"), text.alias("raw")).alias(c.name))
        return df.select(*out)

    def data(self, t: C.Table | str) -> DataFrame:
        t = self.catalog[t] if isinstance(t, str) else t
        rows = self.rows(t)
        return rows.select(*[F.col(f"`{c.name}`") if c.role in ("id", "parent", "order") else F.col(f"`{c.name}`.value").alias(c.name) for c in t.columns])

    def anomalies(self, t: C.Table | str) -> DataFrame:
        """table, column, row_id, expected_type, actual_value (cut), actual_length, actual_type."""
        t = self.catalog[t] if isinstance(t, str) else t
        id_name = next(c.name for c in t.columns if c.role == "id")
        kinds = [c for c in t.columns if c.role not in ("id", "parent", "order", "key")]
        empty = "table string, column string, row_id string, expected_type string, actual_value string, actual_length int, actual_type string"
        if not kinds:
            return self.records.sparkSession.createDataFrame([], empty)
        found = F.filter(F.array(*[F.struct(F.lit(c.name).alias("column"), F.lit(str(c.type)).alias("expected_type"), F.col(f"`{c.name}`.raw").alias("raw"), F.col(f"`{c.name}`.bad").alias("bad")) for c in kinds]), lambda x: x["bad"].isNotNull())
        each = self.rows(t).select(F.col(f"`{id_name}`").alias("row_id"), F.explode(found).alias("a"))
        return each.select(F.lit(t.name).alias("table"), F.col("a.column").alias("column"), "row_id", F.col("a.expected_type").alias("expected_type"), cut(F.col("a.raw")).alias("actual_value"), F.char_length("a.raw").alias("actual_length"), F.col("a.bad").alias("actual_type"))

    def all_anomalies(self) -> DataFrame:
        parts = [self.anomalies(t) for t in self.catalog]
        for x in self.stray_scalars():
            parts.append(x)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def stray_scalars(self) -> list[DataFrame]:
        """Scalars in arrays that hold objects too have no table; they are anomalies of the array's table."""
        out = []
        for t in self.catalog:
            if t.kind != "object_array" or not t.parent or t.layout == "group":
                continue
            f = self.catalog.stats and self.catalog.stats.fields.get(t.path[:-1], {}).get(t.key)
            if f is not None and not f.stray_scalars:
                continue
            above = self.objects(self.catalog[t.parent]).select("id", member(F.col("v"), t.key).alias("x"))
            each = above.filter(raw_tag(F.col("x")) == "array").select("id", F.explode(F.try_variant_get("x", "$", "array<variant>")).alias("i"))
            stray = each.withColumn("raw", raw_tag(F.col("i"))).filter("raw <> 'object' and raw <> 'null'")
            text = F.to_json("i")
            out.append(stray.select(F.lit(t.name).alias("table"), F.lit("").alias("column"), F.col("id").alias("row_id"), F.lit("OBJECT").alias("expected_type"), cut(text).alias("actual_value"), F.char_length(text).alias("actual_length"), F.lit("scalar_in_object_array").alias("actual_type")))
        return out


def cut(s: Column) -> Column:
    return F.when(F.char_length(s) > LONGEST_EXAMPLE, F.concat(F.left(s, F.lit(LONGEST_EXAMPLE)), F.lit("…"))).otherwise(s)


def _columns(s: Shredder, t: C.Table) -> DataFrame:
    v = F.col("v")

    def value_of(c: C.Column):
        if c.role == "flat":
            return member(member(v, c.source), c.key)
        if c.role == "flat_json":
            x = member(v, c.source)
            return (F.when(raw_tag(x) != "null", F.to_json(x)),)
        x = member(v, c.key)
        # a scalar column says nothing of objects and arrays under its key where these have a table of their own
        return x if c.type.name == "array" or not below.get(c.key) else F.when(~raw_tag(x).isin("object", "array"), x)

    below = {x.key: True for x in s.catalog.children(t.name)}
    fields = s.catalog.stats.fields.get(t.path, {}) if s.catalog.stats else {}
    below |= {k: True for k, f in fields.items() if f.kind and not s.catalog.options.array_columns}
    return s.typed(s.objects(t), t, value_of)


def _scalars(s: Shredder, t: C.Table) -> DataFrame:
    return s.typed(s.objects(t), t, lambda c: F.col("v"))


def _pivot(s: Shredder, t: C.Table) -> DataFrame:
    e = entries(s.objects(t))
    if "keys" in t.params:
        e = e.filter(F.col("key").isin(t.params["keys"]) & ~raw_tag(F.col("x")).isin("object", "array"))
    up = F.col("parent") if t.parent else F.col("id")
    e = e.select(child_id(F.col("id"), F.col("key")).alias("id"), up.alias("parent"), "ord", "key", "x")
    return s.typed(e, t, lambda c: (F.col("key"),) if c.role == "key" else F.col("x"))


def _wide(s: Shredder, t: C.Table) -> DataFrame:
    """The companion of a split table: its keys are looked up one by one, so the scan reads no others."""
    above = s.objects(s.catalog[t.parent])
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), member(F.col("v"), k).alias("x")) for k in t.params["keys"]])
    e = above.select(F.col("id").alias("parent"), F.explode(F.filter(pairs, lambda p: p["x"].isNotNull() & ~raw_tag(p["x"]).isin("object", "array"))).alias("e"))
    e = e.select(child_id(F.col("parent"), F.col("e.key")).alias("id"), "parent", F.lit(None).cast("long").alias("ord"), F.col("e.key").alias("key"), F.col("e.x").alias("x"))
    return s.typed(e, t, lambda c: (F.col("key"),) if c.role == "key" else F.col("x"))


def _jsonb(s: Shredder, t: C.Table) -> DataFrame:
    return s.typed(s.objects(t), t, lambda c: (F.to_json("v"),))


def _structured(s: Shredder, t: C.Table) -> DataFrame:
    """The keys of one object meet within its row, so nothing is shuffled."""
    suffixes = t.params["suffixes"]

    def suffix_of(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for x in reversed(suffixes):
            out = F.when(key.endswith(x) & (F.char_length(key) > len(x)), x).otherwise(out)
        return out

    def base_of(key: Column) -> Column:
        out = key
        for x in reversed(suffixes):
            out = F.when(key.endswith(x) & (F.char_length(key) > len(x)), F.substring(key, F.lit(1), F.char_length(key) - len(x))).otherwise(out)
        return out

    m = s.objects(t).select("id", "parent", "ord", F.try_variant_get("v", "$", "map<string,variant>").alias("m"))
    bases = F.array_sort(F.array_distinct(F.transform(F.map_keys("m"), base_of)))
    e = m.select("id", "parent", "ord", "m", F.explode(bases).alias("name"))
    up = F.col("parent") if t.parent else F.col("id")
    e = e.select(child_id(F.col("id"), F.col("name")).alias("id"), up.alias("parent"), "ord", "name", "m")

    def value_of(c: C.Column):
        if c.role == "key":
            return (F.col("name"),)
        if c.role == "value":
            return F.when(suffix_of(F.col("name")).isNull(), F.try_element_at(F.col("m"), F.col("name")))
        full = F.concat(F.col("name"), F.lit(c.key))
        return F.when(suffix_of(full) == c.key, F.try_element_at(F.col("m"), full))

    return s.typed(e, t, value_of)


def _members(s: Shredder, t: C.Table, e: DataFrame, array: bool, up: Column) -> DataFrame:
    """Rows for the objects under each key: key column, fields of the object, the object itself."""
    if array:
        e = e.select("id", "parent", "key", F.posexplode(as_items(F.col("x"))).alias("pos", "x")).filter(raw_tag(F.col("x")) == "object")
        e = e.select(child_id(F.col("id"), F.col("key"), F.col("pos")).alias("id"), up.alias("parent"), F.col("pos").cast("long").alias("ord"), "key", "x")
    else:
        e = e.filter(raw_tag(F.col("x")) == "object").select(child_id(F.col("id"), F.col("key")).alias("id"), up.alias("parent"), "ord", "key", "x")
    return s.typed(e, t, lambda c: (F.col("key"),) if c.role == "key" else (F.to_json("x"),) if c.role == "data" else member(F.col("x"), c.key))


def _keyed(s: Shredder, t: C.Table) -> DataFrame:
    if paths := t.params.get("members"):  # tables from several places
        return _merged(s, t, paths)
    return _members(s, t, entries(s.objects(t)), t.params.get("array", False), F.col("parent") if t.parent else F.col("id"))


def _merged(s: Shredder, t: C.Table, members: list[dict]) -> DataFrame:
    out = None
    for m in members:
        e = s.objects(s.catalog[m["parent"]]).select("id", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("ord"), F.lit(m["key"]).alias("key"), member(F.col("v"), m["key"]).alias("x"))
        out = e if out is None else out.unionByName(e)
    return _members(s, t, out, t.params.get("array", False), F.col("id"))


def _group(s: Shredder, t: C.Table) -> DataFrame:
    e = entries(s.objects(s.catalog[t.parent]))
    digits = F.col("key").rlike("^[0-9]+$")
    e = e.filter(digits if t.params["numeric"] else ~digits)
    if t.params["kept"]:
        e = e.filter(~F.col("key").isin(t.params["kept"]))
    return _members(s, t, e, t.params["array"], F.col("id"))


LAYOUTS: dict[str, Callable[[Shredder, C.Table], DataFrame]] = {
    "columns": _columns,
    "auto_split": _columns,
    "multi_keyed_pivot": _columns,
    "flatten": _columns,
    "jsonb_flatten": _columns,
    "pivot": _pivot,
    "wide": _wide,
    "jsonb": _jsonb,
    "jsonb_guard": _jsonb,
    "structured_pivot": _structured,
    "keyed_pivot": _keyed,
    "normalize": _keyed,
    "group": _group,
}
_plain = _columns
LAYOUTS["columns"] = lambda s, t: _scalars(s, t) if t.kind == "scalar_array" else _plain(s, t)
