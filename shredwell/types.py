"""Type tags of JSON values, what a column of them becomes, and what that is in Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

#: Tags, widest first: a column has the type of the widest tag that occurs in it.
TAGS = ("varchar", "float", "bigint", "integer", "boolean", "timestamp", "date", "uuid")


@dataclass(frozen=True)
class Phys:
    """A column's type: one of the names below, with a length for varchar and an element for array."""

    name: str
    length: int | None = None
    element: Phys | None = None

    def __str__(self) -> str:
        if self.name == "varchar":
            return f"VARCHAR({self.length})"
        if self.name == "array":
            return f"{self.element}[]"
        return SQL_NAMES[self.name]

    @property
    def category(self) -> str:
        return "numeric" if self.name in ("integer", "bigint", "double") else "date" if self.name in ("date", "timestamp") else "boolean" if self.name == "boolean" else "string"


SQL_NAMES = {"boolean": "BOOLEAN", "integer": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE PRECISION", "uuid": "UUID", "date": "DATE", "timestamp": "TIMESTAMP", "text": "TEXT", "jsonb": "JSONB"}

TEXT, JSONB, BIGINT, UUID = Phys("text"), Phys("jsonb"), Phys("bigint"), Phys("uuid")

SPARK = {"boolean": T.BooleanType(), "integer": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "uuid": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "text": T.StringType(), "varchar": T.StringType(), "jsonb": T.StringType()}


def spark_type(p: Phys) -> T.DataType:
    return T.ArrayType(spark_type(p.element)) if p.name == "array" else SPARK[p.name]


def resolve(counts: dict[str, int], max_len: int, text_threshold: int) -> Phys:
    """The widest tag present decides, however rare it is; nothing but nulls is text."""
    tag = next((t for t in TAGS if counts.get(t)), None)
    if tag == "varchar":
        return Phys("varchar", max(1, -(-max_len * 12 // 10))) if max_len <= text_threshold else TEXT
    return {"float": Phys("double"), None: TEXT}.get(tag) or Phys(tag)


def widen(a: Phys, b: Phys) -> Phys:
    """The type that holds values of both columns."""
    if a == b:
        return a
    names = {a.name, b.name}
    if names & {"text", "varchar", "jsonb", "array"}:
        return TEXT
    if "double" in names:
        return Phys("double")
    if "bigint" in names:
        return Phys("bigint")
    return TEXT


_ALIASES = {
    "text": "text", "integer": "integer", "int": "integer", "int4": "integer", "bigint": "bigint", "int8": "bigint",
    "double precision": "double", "double": "double", "float": "double", "float8": "double", "real": "double", "float4": "double",
    "boolean": "boolean", "bool": "boolean", "uuid": "uuid", "date": "date", "timestamp": "timestamp",
}


def parse_type(s: str) -> Phys | None:
    """A type by its SQL name, None if there is none such."""
    s = " ".join(s.lower().split())
    if m := re.fullmatch(r"(?:varchar|character varying)\s*\(\s*(\d+)\s*\)", s):
        return Phys("varchar", int(m[1]))
    return Phys(_ALIASES[s]) if s in _ALIASES else None


def to_json(p: Phys) -> dict | str:
    if p.name == "varchar":
        return {"varchar": p.length}
    return {"array": to_json(p.element)} if p.name == "array" else p.name


def from_json(x: dict | str) -> Phys:
    if isinstance(x, str):
        return Phys(x)
    return Phys("varchar", x["varchar"]) if "varchar" in x else Phys("array", element=from_json(x["array"]))
