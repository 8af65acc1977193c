"""Quality by positive-unlabelled learning.

A text's features are shares of byte classes and of pairs of neighbouring classes (letter case, digits, kinds of marks,
spaces, line ends), repetition of words and lines, and sizes. A linear model is fitted by the non-negative
unbiased risk

    prior * E[loss(g(x), +) | trusted positive] + max(0, E[loss(g(x), -) | unlabelled] - prior * E[loss(g(x), -) | trusted positive])

with the logistic loss, so that sigmoid(g) estimates the chance of being good. Unlabelled texts are web texts of the
training fold, drawn regardless of labels. Negative labels are never read, for the prior neither: it is the largest share
that scores of a first fit allow, the least ratio of the unlabelled's to the positives' upper tails.

Fitting reads `sample` trusted positives and `sample` unlabelled texts, those whose ids hash lowest, a bound that is
a parameter; scoring reads all rows and whole texts. Null texts are empty; empty texts are scored by the same model.
Rows that repeat an id are scored each; labels that contradict each other make a document positive and nothing else.
Without any positives every score is the prior, or 0.5. Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, helpers, is_held_out, map_batches, table, text_bytes, text_of, without, word_hashes, word_spans

SAMPLE = 8_000
THRESHOLD = 0.7
CHUNK = 1 << 20

#: Kinds of bytes; the second byte of a two-byte Latin letter tells its case.
KINDS = ["lower", "upper", "digit", "space", "line", "stop", "comma", "shout", "bar", "sign", "quote", "bracket", "lead", "control"]


def _kinds() -> np.ndarray:
    k = {name: i for i, name in enumerate(KINDS)}
    out = np.full(256, k["control"], np.int64)
    out[97:123], out[65:91], out[48:58] = k["lower"], k["upper"], k["digit"]
    out[[9, 32]], out[[10, 11, 12, 13]] = k["space"], k["line"]
    for name, chars in (("stop", ".;:?"), ("comma", ","), ("shout", "!"), ("bar", "|"), ("sign", "$%&#@*+=<>~^_/\\"), ("quote", "\"'`-"), ("bracket", "()[]{}")):
        out[[ord(c) for c in chars]] = k[name]
    out[128:160], out[160:192], out[192:] = k["upper"], k["lower"], k["lead"]
    return out


_KIND = _kinds()
_N = len(KINDS)
WIDTH = _N + _N * _N + 8


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text."""
    n, sizes = len(at) - 1, np.diff(at)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(raw):
        return out
    doc = np.repeat(np.arange(n), sizes)
    kind = _KIND[raw]
    one = np.bincount(doc * _N + kind, minlength=n * _N).reshape(n, _N)
    same = doc[1:] == doc[:-1]
    pair = np.bincount((doc[1:] * _N * _N + kind[:-1] * _N + kind[1:])[same], minlength=n * _N * _N).reshape(n, _N * _N)
    size = np.maximum(sizes, 1)[:, None]
    out[:, :_N], out[:, _N : _N + _N * _N] = np.sqrt(one / size), np.sqrt(pair / size)
    starts, ends, words = word_spans(raw, at)
    count = np.maximum(np.diff(words), 1)
    if len(starts):
        h, owner = word_hashes(raw, starts, ends), doc[starts]
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])])
        second = np.concatenate([[False, False], (h[2:] == h[:-2]) & (owner[2:] == owner[:-2])])[: len(h)]
        for k, v in enumerate((again, second, (ends - starts) > 20, (ends - starts) <= 2)):
            out[:, _N + _N * _N + k] = np.sqrt(np.bincount(owner, v, n) / count)
        out[:, -4] = np.bincount(owner, ends - starts, n) / count / 10
    out[:, -3] = np.log1p(np.diff(words)) / 5
    out[:, -2] = np.log1p(sizes) / 10
    out[:, -1] = np.sqrt(one[:, KINDS.index("line")] / count)
    return out


@dataclass
class Model:
    weights: np.ndarray  # the last is the constant
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """From scores of texts that the scoring model hasn't seen: no more positives than the rarest upper tail allows.

    A tail's share of the unlabelled over its share of the positives is the prior if no negative is in it. Each ratio counts
    with half its standard error added, so that chance alone doesn't push the least of them down.
    """
    cuts = np.quantile(positive, np.linspace(0.01, 0.3, 15))
    u, p = ((np.asarray(x)[None, :] >= cuts[:, None]).mean(1) for x in (unlabelled, positive))
    ratio = u / np.maximum(p, 1e-9)
    error = ratio * np.sqrt((1 - u) / np.maximum(u * len(unlabelled), 1) + (1 - p) / np.maximum(p * len(positive), 1))
    return float(np.clip((ratio + error / 2).min(), 0.02, 0.98))


def crossed_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 5, rounds: int = 100) -> float:
    """The prior by scores of models that have not seen what they score: each fold by one fitted to the others."""
    sp, su = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for k in range(folds):
        of_p, of_u = np.arange(len(positive)) % folds == k, np.arange(len(unlabelled)) % folds == k
        if of_p.all() or of_u.all():
            return 0.5
        model = fit(positive[~of_p], unlabelled[~of_u], 0.5, rounds)
        sp[of_p], su[of_u] = model.score(positive[of_p]), model.score(unlabelled[of_u])
    return estimated_prior(sp, su)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk by Adam on all rows; where the negative part goes below zero, its gradient is turned round."""
    width = unlabelled.shape[1] if len(unlabelled) else WIDTH
    if not len(positive) or not len(unlabelled):
        p = 0.5 if prior is None else prior
        return Model(np.append(np.zeros(width), np.log(p / (1 - p))), np.zeros(width), np.ones(width), p)
    if prior is None:
        prior = crossed_prior(positive, unlabelled)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-2
    p, u = ((x - mean) / scale for x in (positive, unlabelled))
    p, u = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (p, u))
    w = np.zeros(p.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    for t in range(1, rounds + 1):
        gp, gu = p @ w, u @ w
        sp, su = sigmoid(gp), sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_positive = prior * (p.T @ (sp - 1)) / len(p)
        d_negative = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        g = d_positive + d_negative if negative >= 0 else -d_negative
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(w, mean, scale, prior)


def featurised(df: DataFrame, text: str) -> DataFrame:
    """df without its text, with its features as bytes."""
    names = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(b.num_columns - 1))
            x = [r.tobytes() for i, j in chunks(at, CHUNK) for r in features(raw[at[i] : at[j]], at[i : j + 1] - at[i])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.binary())], [*names, "features"])

    return map_batches(df.select(*names, text_of(text).alias(text)), run, [*(f for f in df.schema.fields if f.name != text), T.StructField("features", T.BinaryType())])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, learn_from=None) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality); learn_from says which ids are of the training fold.

    Only labels of 1 are looked at. Of rows that repeat an id the one with the least text hash is read.
    """
    fold = ~is_held_out() if learn_from is None else learn_from
    low = lambda seed: F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    positive = labels.filter(fold & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    positive = positive.orderBy(low(17), "doc_id").limit(sample).select("doc_id", F.lit(1).alias("positive"))
    other = docs.filter(fold & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    other = other.orderBy(low(23), "doc_id").limit(sample).select("doc_id", F.lit(0).alias("positive"))
    ids = F.broadcast(positive.unionByName(other).withColumnRenamed("doc_id", "_id"))  # at most twice `sample` rows
    body = text_of(text)
    chosen = docs.select("doc_id", body.alias("_text")).join(ids, F.col("doc_id") == F.col("_id"))
    one = chosen.groupBy("doc_id", "positive").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("m"))
    rows = sorted((r["positive"], r["doc_id"], bytes(r["features"])) for r in featurised(one.select("doc_id", "positive", F.col("m.t").alias("text")), "text").collect())
    x = {k: np.array([np.frombuffer(f, np.float32) for p, _, f in rows if p == k], np.float32).reshape(-1, WIDTH) for k in (0, 1)}
    return fit(x[1], x[0])


def score(df: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with a score (and without its text, unless kept)."""
    names = without(df, ["score"] + ([] if keep_text else [text])).columns
    given = without(df, ["score"])
    (body,) = helpers(given, "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(b.num_columns - 1))
            s = [model.score(features(raw[at[i] : at[j]], at[i : j + 1] - at[i])) for i, j in chunks(at, CHUNK)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(s).astype(float) if s else [], pa.float64())], [*names, "score"])

    return map_batches(given.select(*names, text_of(text).alias(body)), run, [*(f for f in given.schema.fields if f.name in names), T.StructField("score", T.DoubleType())])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
