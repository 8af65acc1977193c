"""Connected components of a graph whose edges are a DataFrame; nothing is collected by the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_bounds, map_batches, stored


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges (a, b), and the smallest vertex that each reaches."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, up = at[: len(a)], at[len(a) :], np.arange(len(v))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))  # roots hook on smaller roots
        while not np.array_equal(above := up[up], up):
            up = above
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return v, v[up]


def _in_one_task(edges: DataFrame) -> DataFrame:
    fields = [T.StructField("v", T.LongType()), T.StructField("component", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if got:
            v, component = least_reachable(*(np.concatenate(x) for x in zip(*got, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(component)], [f.name for f in fields])

    return map_batches(edges.coalesce(1), run, fields)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(v, component), the smallest vertex that is reachable, from edges (a, b); no vertex may be null.

    Edges that are few enough to be broadcast are joined in one task. Otherwise in each round every vertex hooks on its least neighbour, paths are halved until they end at a root, and the
    graph shrinks to its roots; edges within a tree go. At least half of the vertices go in each round. Minima merge
    within tasks before they move, so a vertex of very many edges is no hot key there. It fails rather than stop early.
    """
    edges = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b"), "edges")
    if in_bounds(edges):
        return stored(_in_one_task(edges), "components")
    left = edges.union(edges.select(F.col("b"), F.col("a"))).distinct()
    left, found = stored(left, "edges"), None
    for _ in range(rounds):
        up = stored(left.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("n")).select(F.col("a").alias("v"), "n"), "hooks")
        while True:
            above = up.select(F.col("v").alias("p"), F.col("n").alias("pn"))
            above = up.join(above, F.col("n") == F.col("p"))
            up = stored(above.select("v", F.col("pn").alias("n"), (F.col("pn") != F.col("n")).alias("moved")), "paths")
            if up.filter("moved").isEmpty():
                break
            up = up.select("v", "n")
        up = up.select("v", "n")
        if found is None:
            found = up.select("v", F.col("n").alias("component"))
        else:
            moved = up.select(F.col("v").alias("p"), "n")
            found = stored(found.join(moved, F.col("component") == F.col("p"), "left").select("v", F.coalesce("n", "component").alias("component")), "found")
        a, b = up.select(F.col("v").alias("va"), F.col("n").alias("na")), up.select(F.col("v").alias("vb"), F.col("n").alias("nb"))
        left = left.join(a, F.col("a") == F.col("va")).join(b, F.col("b") == F.col("vb")).filter("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct()
        left = stored(left, "edges")
        if left.isEmpty():
            return found
    raise RuntimeError(f"no end after {rounds} rounds")
