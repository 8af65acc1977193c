"""What the operators of this package share: inputs, written tables, batches of texts."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, wherever the contracts speak of words.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a side that may be broadcast, by the sizes of its columns.
MAX_BROADCAST = 32 << 20

#: Texts are long: batches of rows are bounded by bytes on their way to Python, and by fewer rows where Parquet is read.
#: The defaults (4096 rows, 64 MB) take hundreds of megabytes of each executor outside its heap.
SETTINGS = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

#: Bytes of a row group of the tables in between; a writer holds one in memory.
ROW_GROUP = 32 << 20

_written: list[tuple[SparkSession, str]] = []


def settle(spark: SparkSession) -> None:
    """Give the session SETTINGS, except for those that it has been given already."""
    given = spark.conf.getAll
    for k, v in SETTINGS.items():
        if k not in given:
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local one does, but only if there are no other machines."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="shredwell-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    The tables are deleted when the driver ends.
    """
    path = stored_path(df.sparkSession, name)
    settle(df.sparkSession)
    df.write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Delete the tables written after the first `since`, but not what `keep` reads; a stage that has been written needs its own no more."""
    read = set() if keep is None else {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()}
    gone = [(s, path) for s, path in _written[since:] if s is spark and path.rsplit("/", 1)[-1] not in read]
    _written[:] = [x for x in _written if x not in gone]
    _delete(gone)


def written() -> int:
    """How many tables there are now, for `let_go`."""
    return len(_written)


def stored_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete)
    _written.append((spark, path))
    return path


def _delete(tables: list[tuple[SparkSession, str]] = _written) -> None:
    for spark, path in tables:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before
            return


def text_of(name: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def is_held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 2


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns whose names the operator's own outputs take (letter case ignored, as Spark does)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def helpers(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that none of df's columns has."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def most_rows(df: DataFrame) -> int:
    """Rows of df that may be broadcast; digests and sketches are at most 64 bytes, and so are the names that are sent."""
    known = {"boolean": 1, "int": 4, "bigint": 8, "double": 8}
    return MAX_BROADCAST // (16 + sum(known.get(kind, 64) for _, kind in df.dtypes))


def in_bounds(df: DataFrame) -> bool:
    """Whether df is so small that it may be broadcast; looks at no more rows than that takes."""
    most = most_rows(df)
    return df.limit(most + 1).count() <= most


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its size is within bounds, else as it is: then Spark shuffles both sides."""
    return F.broadcast(df) if in_bounds(df) else df


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, by the plan's statistics."""
    leaves, size = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator(), 0
    while leaves.hasNext():
        size += int(str(leaves.next().stats().sizeInBytes()))
    return size


Batch = pa.RecordBatch


def map_batches(df: DataFrame, f: Callable[[Iterator[Batch]], Iterator[Batch]], fields: list[T.StructField]) -> DataFrame:
    """mapInArrow with the result's fields; a worker that has done a task gives its free memory back, as it may idle for long."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        yield from f(batches)
        give_back()

    settle(df.sparkSession)
    return df.mapInArrow(run, T.StructType(fields))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch end to end, and where each begins (one more entry for the end)."""
    if column.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if column.type in (pa.string(), pa.large_string()) else b"")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with about `most` bytes in each; a longer text is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply, twice)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


_B = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _B, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in raw, and the number of words before each text. Words don't cross texts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~_IS_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = at[(at > 0) & (at < len(raw))]
    first[edges] |= word[edges]
    last[edges - 1] |= word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from all its bytes and its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    where = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = raw[np.repeat(starts, lengths) + where].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(letters * _powers(int(lengths.max()))[where], np.cumsum(lengths) - lengths)
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words from each word on; the caller leaves out those that cross texts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + words[k : len(words) - n + 1 + k]
        out ^= out >> np.uint64(31)
    return mix64(out)
