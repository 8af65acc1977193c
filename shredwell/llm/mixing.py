"""Mixing sources to target weights by Pareto order sampling.

A source with S words and a target of T gets T / S copies of each document on average: floor(T / S) whole copies are
certain, and the rest is a sample in which a document is included with odds p / (1 - p), p = T / S - floor(T / S).
Each document draws u from its id; the smallest (u / (1 - u)) / (p / (1 - p)) come first, until the source's target is
reached. Inclusion odds differ from source to source (and by document with `weight`, which scales a document's odds).
The document at the boundary is taken in part, so that a source's words are its target, rounded.

No task ever orders a whole source: ranks are cut into slices by u, slices are summed first, and only the slice that
holds the boundary is ordered, after being cut so fine that it has some thousands of documents.

Null sources are a source of their own, null texts have size 0, and documents of size 0 are taken 0 times. Rows that
repeat an id draw u from the id and their text, so they are documents of their own; rows alike in both share a rank.
An empty table gives an empty result; sources without words have target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, helpers, stored, table, without

#: Documents in a slice, about.
SLICE = 4096


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float, most: float) -> dict[str | None, float]:
    """Words for each source: share of all words by weight; what exceeds `most` times a source's size goes to the others."""
    total, out, left = share * sum(sizes.values()), {}, {k for k, v in sizes.items() if v > 0}
    while left:
        level = max(0.0, total - sum(out.values())) / sum(weights[k] for k in left)
        over = {k for k in left if level * weights[k] > most * sizes[k]}
        if not over:
            out |= {k: level * weights[k] for k in left}
            break
        out |= {k: most * sizes[k] for k in over}
        left -= over
    return {k: out.get(k, 0.0) for k in sizes}


def cyclic_weights(sources: list[str | None], cycle: tuple[float, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights by code point order of the sources, null last."""
    ordered = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def draw(doc_id: str, seed: int, also: list[str] | None = None) -> Column:
    """A number in (0, 1) that depends on the id, the seed and the columns `also` alone."""
    h = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(seed), *(F.col(c) for c in also or []))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = (3, 1, 2), seed: int = 0, weight: str | None = None, size: Column | None = None, also: list[str] | None = None) -> DataFrame:
    """df with size, source_size, target and taken (words that the mix takes of the row, repeats counted).

    df is read several times; `size` says where a row's size is, if not to be counted in the text, and `also` what tells rows
    of one id apart, if not the text. The sources' names and totals come to the driver: a row for each source.
    """
    added = ["size", "source_size", "target", "taken"]
    rows = without(df, added).withColumn("size", n_words(text) if size is None else size)
    found = rows.groupBy(source).agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()
    sizes = {r[0]: int(r["w"]) for r in found}
    target = targets(sizes, cyclic_weights(list(sizes), cycle), share, most)
    plan = []
    for r in found:
        s, t = sizes[r[0]], target[r[0]]
        ratio = t / s if s else 0.0
        whole = min(int(most), math.floor(ratio + 1e-12))
        p = max(0.0, ratio - whole)
        plan.append((r[0], s, float(t), whole, p if p > 1e-12 else 0.0, round(t) - whole * s if p > 1e-12 else 0, max(1, math.ceil(r["n"] / SLICE))))
    spark = df.sparkSession
    kind = dict(df.dtypes)[source]
    of, p_, whole_, rest_, slices_, u_, rank_, slice_, s_, cut_, here_, more_ = helpers(df, "source", "p", "whole", "rest", "slices", "u", "rank", "slice", "s", "cut", "here", "more")
    col = F.col
    plans = F.broadcast(spark.createDataFrame(plan, T.StructType([T.StructField(of, T._parse_datatype_string(kind)), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField(whole_, T.IntegerType()), T.StructField(p_, T.DoubleType()), T.StructField(rest_, T.LongType()), T.StructField(slices_, T.IntegerType())])))
    # the Pareto rank, u/(1-u) over the odds, brought to (0, 1): that orders as the rank does
    odds = F.when(col(p_) > 0, col(p_) / (1 - col(p_))).otherwise(F.lit(1.0))
    own = odds if weight is None else odds * F.coalesce(F.greatest(col(weight).cast("double"), F.lit(1e-9)), F.lit(1.0))
    rank = col(u_) / (col(u_) + (1 - col(u_)) * own)
    flat = col(rank_) * odds / (1 - col(rank_) + col(rank_) * odds)  # slices are even where there are no weights
    rows = rows.join(plans, col(source).eqNullSafe(col(of))).withColumn(u_, draw(doc_id, seed, [text] if also is None else also)).withColumn(rank_, rank).withColumn(slice_, F.least((flat * col(slices_)).cast("int"), col(slices_) - 1))
    sums = rows.filter(col(rest_) > 0).groupBy(of, slice_).agg(F.sum("size").alias("sum"), F.max(rest_).alias("rest"))
    # a row for each slice: some thousandths of the documents, and of a source's slices one for each SLICE documents
    run = sums.withColumn("upto", F.sum("sum").over(Window.partitionBy(of).orderBy(slice_)))
    cut = run.filter((col("upto") >= col("rest")) & (col("upto") - col("sum") < col("rest"))).select(col(of).alias(s_), col(slice_).alias(cut_), (col("rest") - col("upto") + col("sum")).alias(here_))
    rows = rows.join(F.broadcast(cut), col(of).eqNullSafe(col(s_)), "left")  # at most a row for each source
    inner, outer = rows.filter(col(slice_) == col(cut_)), rows.filter((col(slice_) != col(cut_)) | col(cut_).isNull())
    before = Window.partitionBy(of).orderBy(rank_, doc_id, "size").rowsBetween(Window.unboundedPreceding, -1)
    left = col(here_) - F.coalesce(F.sum("size").over(before), F.lit(0))
    inner = inner.withColumn(more_, F.greatest(F.lit(0), F.least(col("size"), left)))
    outer = outer.withColumn(more_, F.when(col(slice_) < col(cut_), col("size")).otherwise(F.lit(0)).cast("long"))
    both = outer.unionByName(inner).withColumn("taken", (col("size") * col(whole_) + col(more_)).cast("long"))
    return both.select(*without(df, added).columns, *added)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as many times as it is taken; the one at a source's boundary counts as whole from half its size on."""
    n = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    copies = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast(T.ArrayType(T.IntegerType())))
    (copy,) = helpers(mixed, "copy")
    return mixed.select(*columns, F.explode(copies).alias(copy)).select(*columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("n"), F.xxhash64("text").alias("h")), "sizes")
    return mix(sizes, size=F.col("n"), also=["h"]).select("doc_id", "size", "source_size", "target", "taken")
