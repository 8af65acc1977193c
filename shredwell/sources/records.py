"""Root records as (doc_id, v): one JSON object each, as VARIANT."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST = 1024
#: Files whose heads are looked at, at most.
HEADS = 64
#: Inputs of fewer bytes for each core are dealt out anew before they are parsed.
SMALL_SPLIT = 64 << 20
#: Arrays of more bytes are split item by item, not held as one value.
LARGE_ARRAY = 16 << 20
#: Splits of a text whose places are sent to every task, at most (100 bytes each).
MANY_SPLITS = 200_000


class SourceError(ValueError):
    pass


def prepare(spark: SparkSession) -> None:
    """Later ones of duplicate keys win, as in maps; times have no zone."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at a path, in order; nothing of them is read."""
    return [(r[0], r[1]) for r in spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()]


def _head(spark: SparkSession, path: str) -> bytes:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(b & 255 for b in stream.readNBytes(FIRST)).lstrip(b"\xef\xbb\xbf \t\r\n\x0b\x0c")
    finally:
        stream.close()


def detect_format(spark: SparkSession, path: str) -> str:
    """`array` or `ndjson`, by the first character that isn't white space among the first bytes; all of up to HEADS files must agree.

    Files without any such character count only if there are no others.
    """
    found = [f for f, _ in files(spark, path)]
    if not found:
        raise SourceError(f"no file at {path}")
    heads = {f: h for f in found[:HEADS] if (h := _head(spark, f))}
    if not heads:
        raise SourceError("empty input")
    kinds = {f: {b"[": "array", b"{": "ndjson"}.get(h[:1]) for f, h in heads.items()}
    for f, kind in kinds.items():
        if kind is None:
            raise SourceError(f"neither a JSON array nor JSON lines: {f} begins with {heads[f][:1]!r}")
    if len(set(kinds.values())) > 1:
        raise SourceError(f"some files at {path} hold arrays and some hold lines")
    return next(iter(kinds.values()))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its sources are small; what takes many scan tasks anyway isn't moved."""
    spark, size = df.sparkSession, 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    while leaves.hasNext():
        size += int(str(leaves.next().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * SMALL_SPLIT else df


def root_name(path: str, table: str | None = None) -> str:
    return table or re.sub(r"\.[^.]*$", "", os.path.basename(path.rstrip("/"))) or "root"


def checked(df: DataFrame) -> DataFrame:
    """df (doc_id, v), failing on root values that aren't objects."""
    kind = F.schema_of_variant("v")
    message = F.concat(F.lit("a value at root level is not an object: "), F.coalesce(kind, F.lit("null")))
    return df.select("doc_id", F.when(kind.startswith("OBJECT"), F.col("v")).otherwise(F.raise_error(message).cast("variant")).alias("v"))


def from_strings(df: DataFrame, text: str, doc_id: Column | str) -> DataFrame:
    """Records of a string column; rows that aren't JSON fail, blank ones are skipped."""
    prepare(df.sparkSession)
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rows = df.select(key.cast("string").alias("doc_id"), F.btrim(F.col(text), F.lit(" \t\r\n\x0b\x0c")).alias("_t")).filter("_t <> ''")
    return checked(rows.select("doc_id", F.parse_json("_t").alias("v")))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """A record for each line that isn't blank; its id is the file's path and the line's number from 0, however the files are split.

    A first pass counts the lines of each split; the numbers of lines before it in its file make its own lines' numbers.
    """
    prepare(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "^\ufeff", "").alias("t"))
    splits = lines.groupBy(F.col("f").alias("sf"), F.col("b").alias("sb")).agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = Window.partitionBy("sf").orderBy("sb").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("sf", "sb", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    if len(files(spark, path)) <= MANY_SPLITS and lines.select("f").rdd.getNumPartitions() <= MANY_SPLITS:
        splits = F.broadcast(splits)
    lines = lines.join(splits, (F.col("f") == F.col("sf")) & (F.col("b") == F.col("sb")))
    return from_strings(lines.select(F.concat_ws(":", "f", (F.col("n") + F.col("shift")).cast("string")).alias("doc_id"), "t"), "t", "doc_id")


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """The elements of the array that each file holds; an id is the file's path and the element's place."""
    prepare(spark)
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.parse_json(F.regexp_replace("value", "^﻿", "")).alias("a"))
    rows = whole.lateralJoin(spark.tvf.variant_explode(F.col("a").outer()))
    return checked(rows.select(F.concat_ws(":", "f", F.col("pos").cast("string")).alias("doc_id"), F.col("value").alias("v")))


_ARRAY_ITEM = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("t", T.StringType())])


def read_large_array(spark: SparkSession, path: str) -> DataFrame:
    """Elements of arrays too large for one value: each file is split by a scan that knows strings and brackets.

    One file is one task; missing or doubled commas and a missing closing bracket are tolerated.
    """
    prepare(spark)
    contents = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, items = [], []
                for k, item in enumerate(split_array(content)):
                    ids.append(f"{name}:{k}")
                    items.append(item.decode())
                    if len(items) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(items, pa.string())], ["doc_id", "t"])
                        ids, items = [], []
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(items, pa.string())], ["doc_id", "t"])

    return from_strings(contents.mapInArrow(run, _ARRAY_ITEM), "t", "doc_id")


_MARKS = re.compile(rb'["\[\]{},]')
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*"', re.S)


def split_array(content: bytes):
    """The top-level items of a JSON array, as bytes."""
    i = content.find(b"[") + 1
    if not i:
        raise SourceError("no array")
    depth: list[bytes] = []
    start, at = i, i
    while m := _MARKS.search(content, at):
        c, at = m[0], m.end()
        if c == b'"':
            end = _STRING_END.match(content, at)
            if not end:
                raise SourceError("string without end")
            at = end.end()
        elif c in b"[{":
            depth.append(b"]" if c == b"[" else b"}")
        elif c == b",":
            if not depth:
                if item := content[start : m.start()].strip():
                    yield item
                start = at
        elif depth:
            if depth.pop() != c:
                raise SourceError("brackets don't match")
            if not depth and c == b"}":  # an item ends with its bracket, comma or not
                yield content[start:at].strip()
                start = at
        elif c == b"]":
            if item := content[start : m.start()].strip():
                yield item
            return
        else:
            raise SourceError("brackets don't match")
    if depth:
        raise SourceError("unexpected end of input")
    if item := content[start:].strip():
        yield item


def read(spark: SparkSession, path: str) -> DataFrame:
    if detect_format(spark, path) == "ndjson":
        return read_ndjson(spark, path)
    large = max(n for _, n in files(spark, path)) > LARGE_ARRAY
    return read_large_array(spark, path) if large else read_array(spark, path)


def from_struct(df: DataFrame, doc_id: str) -> DataFrame:
    """Records of any table: all columns but the id, nested ones included; nulls stay nulls."""
    prepare(df.sparkSession)
    cols = [c for c in df.columns if c != doc_id]
    return df.select(F.col(doc_id).cast("string").alias("doc_id"), F.parse_json(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("v"))
