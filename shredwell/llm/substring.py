"""Substring dedup: every word covered by a window of words that also starts earlier goes; windows are judged on the input.

Any window of `window` words contains 11 runs of window-10 words; the one with the least hash is the window's anchor.
Equal windows have equal anchors, and neighbouring windows mostly share theirs; the stretch of text that windows with
one anchor cover is the unit here. First, anchors are counted (five bytes for each stretch, in blobs by their leading
bits) and those seen twice set bits of a filter of bounded size. Then stretches whose anchor is in the filter are keyed
by anchor and by a hash of the whole stretch. Of equal stretches the earliest stays and the windows of all others go. The
earliest ones still overlap where repeated passages begin and end at different places: anchors of several different
stretches get a filter of their own, and the windows of these stretches are compared one by one, the earliest again
staying. All of that is grouping by minimum, which merges
within tasks, and joins on thin rows; no task holds all places of a common passage. Last, the spans are joined to the
texts. The filter's false alarms cost work, never a wrong result. Keys are pairs of 64-bit hashes.

Order is by doc_id, then by place. Null texts and texts of fewer words than a window lose nothing. Documents with a
null id lose nothing and don't count as earlier. Rows that repeat an id are read as one place each: a window at the
same place of both isn't earlier than itself, and what one of them loses the other loses too. Empty tables give empty
results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, gram_hashes, helpers, in_bounds, map_batches, mix64, source_bytes, stored, table, text_bytes, text_of, without, word_hashes, word_spans

WINDOW = 20
RUNS = 11
CHUNK = 1 << 20
#: Bits of the filter, at most: 32 MB go to each executor, however many anchors there are.
FILTER_BITS = 1 << 28

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Stretches:
    """The stretches of all texts of a chunk: text, first window's start (in words of its text), number of windows, anchor."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, window: int):
        starts, ends, words = word_spans(raw, at)
        h = word_hashes(raw, starts, ends)
        n, run = len(h), window - RUNS + 1
        self.window = window
        self.text = self.start = self.count = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n < window:
            return
        g = gram_hashes(h, run)
        m = n - window + 1
        best, place = g[:m].copy(), np.zeros(m, np.int64)
        for k in range(1, RUNS):
            less = g[k : k + m] < best
            best[less] = g[k : k + m][less]
            place[less] = k
        text = np.repeat(np.arange(len(at) - 1), np.diff(words))
        inside = np.flatnonzero(text[:m] == text[window - 1 :])
        if not len(inside):
            return
        place = (place + np.arange(m))[inside]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(inside) != 1)])
        first = np.flatnonzero(new)
        self.first = inside[first]
        self.count = np.diff(np.append(first, len(inside)))
        self.text = text[self.first]
        self.start = self.first - words[self.text]
        self.anchor = best[self.first]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _geometric(_BASE, n), dtype=np.uint64)])
        self.back = _geometric(_BASE_INVERSE, n)

    def hashes(self, first: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Of the words from each first on, so many."""
        return mix64((self.sums[first + length] - self.sums[first]) * self.back[first] + np.asarray(length).astype(np.uint64))


#: Leading bits of an anchor name its blob; LOW_BITS more are counted. A blob's share of BLOB_INPUT bytes of documents is sorted in memory.
LOW_BITS, LEAST_BITS = 40, 12
BLOB_INPUT = 1 << 30
HELD = 2_000_000


def blob_bits(source: int) -> int:
    """So many that a blob's anchors come from about BLOB_INPUT bytes of source at most."""
    return min(24, max(LEAST_BITS, (source // BLOB_INPUT).bit_length()))


def _blobs(anchors: np.ndarray, bits: int) -> pa.RecordBatch:
    """Blobs of the anchors by their leading bits; what is there often is there twice."""
    a = np.sort(anchors >> np.uint64(64 - bits - LOW_BITS))
    a = np.concatenate([a[:-2][a[2:] != a[:-2]], a[-2:]]) if len(a) > 2 else a
    bucket = (a >> np.uint64(LOW_BITS)).astype(np.int32)
    low = a.view(np.uint8).reshape(-1, 8)[:, :5].copy()
    first = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1]) if len(a) else np.zeros(0, np.int64)
    offsets = np.append(first, len(a)).astype(np.int32) * 5
    blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(low.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), blobs], ["bucket", "blob"])


def repeated_anchors(df: DataFrame, window: int, text: str) -> DataFrame:
    """The leading bits of anchors that occur more than once, in the place they have in the anchor."""

    bits = blob_bits(source_bytes(df))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            raw, at = text_bytes(b.column(0))
            for i, j in chunks(at, CHUNK):
                held.append(Stretches(raw[at[i] : at[j]], at[i : j + 1] - at[i], window).anchor)
                if sum(map(len, held)) > HELD:
                    yield _blobs(np.concatenate(held), bits)
                    held = []
        if held:
            yield _blobs(np.concatenate(held), bits)

    def repeated(parts: list[np.ndarray], bucket: int) -> pa.RecordBatch:
        low = np.concatenate(parts)
        n = len(low) // 5
        a = np.zeros((n, 8), np.uint8)
        a[:, :5] = low.reshape(n, 5)
        a = np.sort(a.reshape(-1).view(np.uint64))
        a = np.unique(a[1:][a[1:] == a[:-1]]) | np.uint64(bucket) << np.uint64(LOW_BITS)
        return pa.RecordBatch.from_arrays([pa.array((a << np.uint64(64 - bits - LOW_BITS)).view(np.int64))], ["anchor"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now = [], -1  # of one bucket at a time: they come in order
        for b in batches:
            raw, at = text_bytes(b.column(1))
            buckets = b.column(0).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(buckets)], strict=True) if len(first) else ():
                if buckets[i] != now and parts:
                    yield repeated(parts, now)
                    parts = []
                now = int(buckets[i])
                parts.append(raw[at[i] : at[j]].copy())
        if parts:
            yield repeated(parts, now)

    blobs = map_batches(df.select(text_of(text).alias("text")), collect, [T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType())])
    return map_batches(blobs.repartition("bucket").sortWithinPartitions("bucket"), count, [T.StructField("anchor", T.LongType())])


def filter_of(repeated: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """Bits set by the anchors in `repeated`; the size follows their number up to the bound."""
    n = repeated.count()
    bits = 1 << 16
    while bits < most and bits < 16 * n:
        bits <<= 1
    place = F.shiftrightunsigned("anchor", 64 - bits.bit_length() + 1)
    # 4 KB for each 32768 bits
    rows = repeated.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for r in rows:
        # Spark's bucket 1 begins with number 1; number 0 is alone in bucket 0, and always counts as set here
        a = (r["k"] - 1) * 4096
        if a >= 0:
            out[a : a + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out[: bits // 8 + 1]


def in_filter(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    size = (len(bits) - 1) * 8
    p = (anchor >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
    q = np.maximum(p - 1, 0)
    return (bits[q >> 3] >> (q & 7).astype(np.uint8) & 1).astype(bool) | (p == 0)


_STRETCH = [T.StructField(n, T.LongType()) for n in ("anchor", "whole", "doc_id")] + [T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())]
_WINDOW = [T.StructField(n, T.LongType()) for n in ("anchor", "win", "doc_id")] + [T.StructField("start", T.IntegerType())]


def place_keys(whole: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of a stretch and where it is."""
    return mix64(whole ^ mix64(doc_id.astype(np.int64).view(np.uint64) * np.uint64(_BASE) + start.astype(np.int64).view(np.uint64)))


def keyed(firsts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, doc, start = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(place_keys(whole.view(np.uint64), doc, start).view(np.int64))], ["anchor"])

    return map_batches(firsts.select("whole", "first_doc", "first_start"), run, [T.StructField("anchor", T.LongType())])


def stretches(df: DataFrame, bits, window: int, text: str) -> DataFrame:
    """Stretches whose anchor is in the filter."""

    def rows(s: Stretches, ids: np.ndarray) -> list[np.ndarray]:
        k = np.flatnonzero(in_filter(bits.value, s.anchor))
        n = s.count[k]
        return [s.anchor[k].view(np.int64), s.hashes(s.first[k], n + window - 1).view(np.int64), ids[k], s.start[k].astype(np.int32), n.astype(np.int32)]

    return scanned(df, window, text, rows, _STRETCH)


def windows_at(df: DataFrame, bits, window: int, text: str) -> DataFrame:
    """The windows of the stretches whose places are in the filter. A false alarm adds windows that are there, and so changes nothing."""

    def rows(s: Stretches, ids: np.ndarray) -> list[np.ndarray]:
        whole = s.hashes(s.first, s.count + window - 1)
        k = np.flatnonzero(in_filter(bits.value, place_keys(whole, ids, s.start)))
        n = s.count[k]
        each = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        win = s.hashes(np.repeat(s.first[k], n) + each, window)
        return [np.repeat(s.anchor[k], n).view(np.int64), win.view(np.int64), np.repeat(ids[k], n), (np.repeat(s.start[k], n) + each).astype(np.int32)]

    return scanned(df, window, text, rows, _WINDOW)


def scanned(df: DataFrame, window: int, text: str, rows, fields: list[T.StructField]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = text_bytes(b.column(1))
            for i, j in chunks(at, CHUNK):
                s = Stretches(raw[at[i] : at[j]], at[i : j + 1] - at[i], window)
                if len(s.anchor):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows(s, ids[i + s.text])], [f.name for f in fields])

    return map_batches(df.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")), run, fields)


def spans(df: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """doc_id, start, count: windows that also start earlier, as runs of neighbouring starts."""
    sc = df.sparkSession.sparkContext
    repeated = stored(repeated_anchors(df, window, text), "anchors")
    bits = sc.broadcast(filter_of(repeated))
    rows = stored(stretches(df, bits, window, text), "stretches")
    bits.unpersist()
    place = F.struct("doc_id", "start")
    firsts = rows.groupBy("anchor", "whole").agg(F.min(place).alias("p"), F.count("*").alias("times"))
    firsts = stored(firsts.select("anchor", "whole", F.col("p.doc_id").alias("first_doc"), F.col("p.start").alias("first_start"), "times"), "firsts")
    # equal stretches: all but the earliest go whole
    later = (F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))
    again = firsts.filter("times > 1").drop("times")
    whole = rows.join(again, ["anchor", "whole"]).filter(later).select("doc_id", "start", F.col("n").alias("count"))
    # different stretches of one anchor: window by window, at the earliest place of each stretch
    mixed = firsts.groupBy("anchor").count().filter("count > 1").select("anchor")
    places = stored(keyed(firsts.join(mixed, "anchor", "left_semi")), "places")
    bits = sc.broadcast(filter_of(places))
    windows = stored(windows_at(df, bits, window, text), "windows")
    bits.unpersist()
    least = windows.groupBy("anchor", "win").agg(F.min(place).alias("p"), F.count("*").alias("times")).filter("times > 1").select("anchor", "win", F.col("p.doc_id").alias("first_doc"), F.col("p.start").alias("first_start"))
    single = windows.join(least, ["anchor", "win"]).filter(later).select("doc_id", "start", F.lit(1).alias("count"))
    return whole.unionByName(single)


_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


def remove(df: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """df with n_words, n_removed and, in place of the text, its kept words joined by one space."""
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    kept = without(df, [text, *(f.name for f in new)])
    key, id_, begins, sizes = helpers(df, "doc", "id", "starts", "counts")
    # runs that repeat (rows that share an id) merge, so a document has one entry a place at most
    by_doc = spans(df, window, text).groupBy("doc_id", "start").agg(F.max("count").alias("count"))
    by_doc = by_doc.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_list(F.struct("start", "count")).alias("s"))
    by_doc = by_doc.select(id_, F.col("s.start").alias(begins), F.col("s.count").alias(sizes))
    by_doc = stored(by_doc, "spans")
    docs = df.select(*[df[c] for c in kept.columns], df["doc_id"].cast("long").alias(key), text_of(text).alias(text))
    columns = [*kept.columns, text, begins, sizes]
    same = F.col(key) == F.col(id_)
    if in_bounds(by_doc):  # few enough ids to be sent round: only the documents that lose something move
        ids = F.broadcast(by_doc.select(id_))
        hit = docs.join(ids, same, "left_semi").join(by_doc, same).select(*columns)
        rest = docs.join(ids, same, "left_anti")
        none = F.lit(None).cast("array<int>")
        joined = rest.withColumn(begins, none).withColumn(sizes, none).select(*columns).unionByName(hit)
    else:
        joined = docs.join(by_doc, same, "left").select(*columns)
    names = [*kept.columns, *(f.name for f in new), text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                b = whole.slice(k, 2000)
                texts, total, gone = [], [], []
                n = b.num_columns
                for t, starts, counts in zip(b.column(n - 3).cast(pa.binary()), b.column(n - 2), b.column(n - 1), strict=True):
                    words = _WORDS(t.as_py())
                    total.append(len(words))
                    if starts.is_valid:
                        a, c = np.array(starts.as_py(), np.int64), np.array(counts.as_py(), np.int64)
                        edge = np.zeros(len(words) + window + 1, np.int64)
                        inside = a < len(words)  # another row of this id may be longer
                        np.add.at(edge, a[inside], 1)
                        np.add.at(edge, np.minimum(a + c + window - 1, len(words))[inside], -1)
                        out = np.cumsum(edge)[: len(words)] > 0
                        gone.append(int(out.sum()))
                        words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                    else:
                        gone.append(0)
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([*b.columns[: n - 3], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names)

    return map_batches(joined, run, [*kept.schema.fields, *new, T.StructField(text, T.StringType())])


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
