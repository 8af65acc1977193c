"""Values of VARIANT columns as typed columns; what doesn't fit becomes NULL and has a name for why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Phys, spark_type
from .tags import integral, is_integral, raw_tag

INTEGER_SHAPE = "^[+-]?[0-9]+$"
FLOAT_SHAPE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
NOT_FINITE = "^[+-]?(inf|infinity|nan)$"
TRIM = " \t\n\r\x0b\x0c"


def _kind(raw: Column) -> Column:
    """The name of a value's JSON type."""
    return F.when(raw.isin("null", "boolean", "string", "object", "array"), raw).otherwise("number")


def _result(value: Column, bad: Column) -> Column:
    return F.struct(value.alias("value"), bad.alias("bad"))


def coerce(v: Column, p: Phys, raw: Column | None = None) -> Column:
    """struct(value, bad): bad is NULL for values that fit, JSON nulls and missing values. raw: raw_tag(v), if it is at hand."""
    raw = raw_tag(v) if raw is None else raw
    none = raw.isNull() | (raw == "null")
    kind = _kind(raw)
    s = F.try_variant_get(v, "$", "string")
    t = F.btrim(s, F.lit(TRIM))
    null = F.lit(None)
    if p.name in ("integer", "bigint"):
        low, high = (-(1 << 31), (1 << 31) - 1) if p.name == "integer" else (-(1 << 63), (1 << 63) - 1)
        n = F.when(kind == "number", F.when(is_integral(v, raw), integral(v, raw))).when((raw == "string") & t.rlike(INTEGER_SHAPE), t.try_cast("bigint"))
        ok = n.between(F.lit(low), F.lit(high))
        why = F.when(kind == "number", "number_out_of_range" if p.name == "integer" else "float").otherwise(kind)
        return _result(F.when(ok, n).cast(spark_type(p)), F.when(~none & ~F.coalesce(ok, F.lit(False)), why))
    if p.name == "double":
        d = F.when(kind == "number", F.try_variant_get(v, "$", "double")).when((raw == "string") & t.rlike(FLOAT_SHAPE), t.try_cast("double"))
        ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
        odd = ((raw == "string") & F.lower(t).rlike(NOT_FINITE)) | (d.isNotNull() & ~ok)
        return _result(F.when(ok, d), F.when(~none & ~ok, F.when(odd, "float_not_finite").otherwise(kind)))
    if p.name == "boolean":
        low = F.lower(s)
        one = F.try_variant_get(v, "$", "double")
        b = (
            F.when(raw == "boolean", F.try_variant_get(v, "$", "boolean"))
            .when((raw == "string") & low.isin("true", "yes", "on", "1"), True)
            .when((raw == "string") & low.isin("false", "no", "off", "0"), False)
            .when((kind == "number") & one.isin(1.0, 0.0), one == 1.0)
        )
        return _result(b, F.when(~none & b.isNull(), kind))
    if p.name in ("uuid", "date", "timestamp"):
        nul = F.instr(s, "\0") > 0
        if p.name == "uuid":
            value = F.when(s.rlike("^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"), s)
        else:
            value = s.try_cast(spark_type(p))
        value = F.when((raw == "string") & ~nul, value)
        why = F.when(raw != "string", kind).when(nul, "string_contains_null_byte").when(value.isNull(), f"invalid_{p.name}")
        return _result(value, F.when(~none, why))
    if p.name == "jsonb":
        return _result(F.when(~none, F.to_json(v)), null.cast("string"))
    if p.name == "array":
        return coerce_array(v, p, raw, kind, none)
    # text and varchar
    nul = (raw == "string") & (F.instr(s, "\0") > 0)
    nested = raw.isin("object", "array")
    why = F.when(nested, kind).when(nul, "string_contains_null_byte")
    if p.name == "varchar":
        why = why.when(F.char_length(s) > p.length, "string_too_long")
    return _result(F.when(~none & why.isNull(), s), F.when(~none, why))


def coerce_array(v: Column, p: Phys, raw: Column, kind: Column, none: Column) -> Column:
    """Elements that don't fit are NULL without an anomaly; texts take any scalar, without NUL."""
    items = F.try_variant_get(v, "$", "array<variant>")
    if p.element.name in ("text", "varchar", "uuid", "date", "timestamp"):
        plain = F.transform(items, lambda x: F.replace(F.when(raw_tag(x).isin("object", "array"), F.to_json(x)).otherwise(F.try_variant_get(x, "$", "string")), F.lit("\0"), F.lit("")))
        value = plain if p.element.name in ("text", "varchar", "uuid") else F.transform(plain, lambda x: x.try_cast(spark_type(p.element)))
    else:
        value = F.transform(items, lambda x: coerce(x, p.element)["value"])
    return _result(F.when(raw == "array", value), F.when(~none & (raw != "array"), kind))
