"""Language identification by nearest centroids of n-gram vectors.

A text is lower-cased, what isn't a letter becomes a space, and its byte 3-grams are counted in hashed slots. Counts
become 1 + log, times the slot's inverse document frequency, normalised. Each language has several centroids (spherical
k-means over its sample); a text gets the language of the centroid with the largest cosine. `rejected` tells that the
cosine is below the language's limit, the given quantile of its own sample's cosines less a margin: such a text is
far from all that was learnt. Rejecting operators (`reject=True`) then give `und`.

Fitting reads about `sample` texts for each language, those whose ids hash lowest, a bound that is a parameter; the
prediction reads all rows and whole texts. Null texts and texts without a letter are `und` with score 0. Rows with
a null language teach nothing. Without any language to learn all texts are `und`. Input columns named like an output
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, helpers, is_held_out, map_batches, table, text_bytes, without

SAMPLE = 1_200
SLOTS = 4096
CENTROIDS = 4
CHUNK = 1 << 20
UNKNOWN = "und"


def _plain() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


_PLAIN = _plain()


def counts(raw: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Hashed 3-gram counts, a row for each (lower-cased) text; grams with two spaces don't count."""
    n = len(at) - 1
    if len(raw) < 3:
        return np.zeros((n, slots), np.float32)
    b = _PLAIN[raw].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(at))
    space = b == 32
    ok = (doc[:-2] == doc[2:]) & (space[:-2].astype(np.int8) + space[1:-1] + space[2:] < 2)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    slot = (h >> np.uint32(32 - slots.bit_length() + 1)).astype(np.int64)
    return np.bincount((doc[:-2] * slots + slot)[ok], minlength=n * slots).reshape(n, slots).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows: several for each language
    owner: np.ndarray
    limits: np.ndarray

    def vectors(self, x: np.ndarray) -> np.ndarray:
        v = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * self.idf
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and the cosine."""
        cosine = self.vectors(x) @ self.centroids.T
        best = cosine.argmax(1)
        return self.owner[best], np.clip(cosine[np.arange(len(x)), best], 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def clustered(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from far apart starts."""
    centre = [_unit(v.mean(0))]
    while len(centre) < min(k, len(v)):
        centre.append(v[(v @ np.array(centre).T).max(1).argmin()])
    c = np.array(centre)
    for _ in range(rounds):
        near = (v @ c.T).argmax(1)
        c = np.array([_unit(v[near == i].mean(0)) if (near == i).any() else c[i] for i in range(len(c))])
    return c.astype(np.float32)


def fit(x: np.ndarray, langs: list[str], centroids: int = CENTROIDS, quantile: float = 0.01, margin: float = 0.05) -> Model:
    names = sorted(set(langs))
    n = len(langs)
    idf = (np.log((1 + n) / (1 + (x > 0).sum(0))) + 0.1).astype(np.float32) if n else np.ones(x.shape[1], np.float32)
    model = Model(names, idf, np.zeros((0, x.shape[1]), np.float32), np.zeros(0, np.int64), np.zeros(len(names)))
    v = model.vectors(x)
    which = np.array([names.index(z) for z in langs])
    parts = [clustered(v[which == i], centroids) for i in range(len(names))]
    if parts:
        model.centroids = np.concatenate(parts)
        model.owner = np.repeat(np.arange(len(parts)), [len(c) for c in parts])
        model.limits = np.array([np.quantile((v[which == i] @ parts[i].T).max(1), quantile) - margin for i in range(len(parts))])
    return model


def lowered(text: str = "text") -> Column:
    return F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, learn_from: Column | None = None) -> Model:
    """A model from docs (doc_id, text, lang). The counts for each language come to the driver, then the bounded sample's vectors."""
    fold = ~is_held_out() if learn_from is None else learn_from
    known = docs.filter(fold & F.col(lang).isNotNull())
    n = {r[0]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not n:
        return fit(np.zeros((0, SLOTS), np.float32), [])
    low = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(v) for k, c in n.items() for v in (k, min(1.0, sample / c))])
    chosen = known.filter(low < F.element_at(share, F.col(lang))).select("doc_id", F.col(lang).cast("string").alias("lang"), lowered(text).alias("t"))
    # of rows that repeat an id one is read, so there are no more than ids
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m")).select("doc_id", "lang", F.col("m.t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(2))
            out = []
            for i, j in chunks(at, CHUNK):
                out += [r.astype(np.float16).tobytes() for r in np.minimum(counts(raw[at[i] : at[j]], at[i : j + 1] - at[i]), 60000)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "lang", "counts"])

    fields = [docs.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("counts", T.BinaryType())]
    rows = sorted((r["lang"], str(r["doc_id"]), bytes(r["counts"])) for r in map_batches(chosen, run, fields).collect())
    x = np.array([np.frombuffer(c, np.float16) for _, _, c in rows], np.float32).reshape(-1, SLOTS)
    return fit(x, [z for z, _, _ in rows])


def predict(df: DataFrame, model: Model, text: str = "text", reject: bool = False) -> DataFrame:
    """df without its text, with lang_pred, score and rejected."""
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = without(df, [text, *(f.name for f in new)])
    names = [*kept.columns, *(f.name for f in new)]
    table = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(b.num_columns - 2))
            letter = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            best, cosine = np.full(len(at) - 1, len(model.languages)), np.zeros(len(at) - 1)
            for i, j in chunks(at, CHUNK) if model.languages else ():
                for a in range(i, j, 512):
                    z = min(j, a + 512)
                    best[a:z], cosine[a:z] = model.predict(counts(raw[at[a] : at[z]], at[a : z + 1] - at[a]))
            best[~letter], cosine[~letter] = len(model.languages), 0
            far = letter & (cosine < np.append(model.limits, 0)[best])
            if reject:
                best[far] = len(model.languages)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(table[best].tolist(), pa.string()), pa.array(cosine, pa.float64()), pa.array(far)], names)

    body, has = helpers(kept, "bytes", "letter")
    given = df.select(*kept.columns, lowered(text).alias(body), F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias(has))
    return map_batches(given, run, [*kept.schema.fields, *new])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
