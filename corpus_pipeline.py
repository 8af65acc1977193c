"""Documents through five stages: quality, exact dedup, near-dedup, mixing, packing.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last returns a row for
each packed piece. Nulls, empty texts and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredwell.llm import exact, mixing, near, packing, quality
from shredwell.llm.common import helpers, let_go, stored, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep_text=True).filter(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact.dedup(docs, largest=True).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the one with the smallest id."""
    return near.dedup(docs, n=5, similarity=0.8).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    (size,) = helpers(docs, "size")
    sized = stored(docs.withColumn(size, mixing.n_words()), "sized")  # words are counted once, the mix reads them several times
    return mixing.repeated(mixing.mix(sized, size=F.col(size)), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the joins' hashing or the packing program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = written()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
            let_go(spark, before - 1 if k else before, keep=docs)  # the stage's own tables and what it has read
    return docs
