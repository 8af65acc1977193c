"""Type tags of VARIANT values as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of strings that have tags of their own.
UUID_SHAPE = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATE_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIMESTAMP_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"


def raw_tag(v: Column) -> Column:
    """null, boolean, number (split below), string, object or array; SQL NULL for no value."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.isNull(), None)
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "STRING", "string")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .otherwise(s)
    )


def string_tag(s: Column) -> Column:
    """Length first: only strings of 36 bytes can be ids, of 10 dates, of 16 or more timestamps."""
    n = F.octet_length(s)
    return (
        F.when((n == 36) & s.rlike(UUID_SHAPE), "uuid")
        .when((n == 10) & s.rlike(DATE_SHAPE), "date")
        .when((n >= 16) & (n != 36) & s.rlike(TIMESTAMP_SHAPE), "timestamp")
        .otherwise("varchar")
    )


def is_integral(v: Column, raw: Column) -> Column:
    """Numbers without a fraction that 64 bits hold, 1.0 and 1e2 among them."""
    d = F.try_variant_get(v, "$", "double")
    small = (d >= -(2.0**63)) & (d < 2.0**63)
    return (raw == "BIGINT") | (raw.rlike(r"^DECIMAL\([0-9]+,0\)$") & small) | ((raw == "DOUBLE") & small & (d == F.floor(d).cast("double")))


def integral(v: Column, raw: Column) -> Column:
    """The 64-bit value where is_integral holds."""
    return F.when(raw == "BIGINT", F.try_variant_get(v, "$", "bigint")).when(raw == "DOUBLE", F.try_variant_get(v, "$", "double").cast("bigint")).otherwise(F.try_variant_get(v, "$", "decimal(38,0)").try_cast("bigint"))


def value_tag(v: Column, raw: Column) -> Column:
    """The tag that types follow from."""
    n = integral(v, raw)
    number = F.when(is_integral(v, raw), F.when(n.between(-(1 << 31), (1 << 31) - 1), "integer").otherwise("bigint")).otherwise("float")
    s = F.try_variant_get(v, "$", "string")
    return F.when(raw.isin("null", "boolean", "object", "array"), raw).when(raw == "string", string_tag(s)).when(raw.isNotNull(), number)
