"""Cleaning records before inference, as VARIANT throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import prepare

#: Fixed patterns of keys that hold machine-read or debugging data.
DROPPED_KEYS = r"_ocr_\d+(_result)?$|_debug_tags$"
STRINGIFIED = ("nutriments",)
NESTED_DROPS = {"images": ("uploaded", "selected")}


def cleaned(v: Column, dropped: str = DROPPED_KEYS, stringified: tuple[str, ...] = STRINGIFIED, nested: dict[str, tuple[str, ...]] = NESTED_DROPS) -> Column:
    """The record without such keys; some objects as strings of JSON; some keys of nested objects dropped, and these objects when nothing is left. NULL for what isn't an object."""
    m = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.rlike(dropped))

    def value(k: Column, x: Column) -> Column:
        out = x
        for name in stringified:
            out = F.when((k == name) & F.schema_of_variant(x).startswith("OBJECT"), F.to_json(x).cast("variant")).otherwise(out)
        for name, keys in nested.items():
            inner = F.map_filter(F.try_variant_get(x, "$", "map<string,variant>"), _not_in(keys))
            out = F.when((k == name) & inner.isNotNull(), F.when(F.size(inner) > 0, F.to_variant_object(inner))).otherwise(out)
        return out

    return F.to_variant_object(F.map_filter(F.transform_values(m, value), lambda _, x: x.isNotNull()))


def _not_in(keys: tuple[str, ...]):
    return lambda k, _: ~k.isin(*keys)


def records(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Cleaned records (doc_id, v) of JSON texts, parsed once; rows that aren't JSON objects go."""
    prepare(df.sparkSession)
    v = cleaned(F.try_parse_json(F.col(text)))
    return df.select(F.col(doc_id).cast("string").alias("doc_id"), v.alias("v")).filter("v IS NOT NULL")


def clean(df: DataFrame, text: str) -> DataFrame:
    """df with cleaned records as JSON text; rows that aren't JSON objects go."""
    prepare(df.sparkSession)
    return df.withColumn(text, F.to_json(cleaned(F.try_parse_json(F.col(text))))).filter(F.col(text).isNotNull())
