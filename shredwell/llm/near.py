"""Near-duplicates by a chosen-path set similarity join.

A document's set is that of its n-word shingles (A-Z lower-cased), or its whole word sequence if it has fewer words.
Equal sets are one set. Each set gets minwise tokens: for each of 64 hash functions the least hash of its shingles.
In each of `trees` independent trees a set walks down the path that its own minwise tokens choose: two levels first; a
node of more than SMALL sets branches again, each set into two children by further tokens. Small nodes are compared
exhaustively on sketches (4 bits of each token) and on sizes, which differ by a fifth at most if similarity is 0.8. In a
large node sets are compared with a pivot: those that are surely alike hang on it and leave, and so that none loses
them, whatever passes a sketch with one that left hangs on it, too (equal tokens with the pivot are then FAR at least);
the others branch on. What hangs together at the first level is a kin group: its sets are compared exactly at the end, so
from then on only pairs across kin groups count. A node without any goes, one with few is small however many sets it has,
so a large group of near copies doesn't branch again and again. What passes a sketch is a candidate; candidates only decide
which documents meet: within a connected group of candidates all sets are compared exactly, by counting common shingles in an inverted index, so links
are never guessed. Shared lines of short texts chain candidates of similarity 0.5 into groups that grow faster than the
input. Groups that weigh more than 2 * BLOCK are therefore taken apart: what hangs on the same pivots is a group, the
other candidates are compared in cells of two blocks each. Groups that still weigh as much are cut into blocks that share some pivots;
the blocks' outcomes are joined, and whatever hasn't joined its group's largest part is compared with every block. So no
task holds a whole large group and no pair is compared for nothing twice.

Two sets with similarity 0.8 take the same two-level path in a tree with chance 0.64, so one in 1e7 such pairs misses
all 16 trees; a sketch misses fewer.

Documents without words have an empty set, are linked with nothing and are kept. Documents with a null id are linked
with nothing and have no component. Rows that repeat an id are documents that share it. An empty table gives an empty
result. Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, give_back, gram_hashes, helpers, in_bounds, map_batches, mix64, small, stored, table, text_bytes, text_of, word_hashes, word_spans
from .graph import components

TOKENS = 64
TREES = 16
LEVELS = 2
SMALL = 64
DEEPEST = 8
#: Weight of a block; a set weighs one for every UNIT shingles begun, so that long texts make small blocks.
BLOCK, UNIT = 500, 2048
#: Equal tokens of two sketches, of 64: what similarity 0.8 doesn't fall below, what sets that hang on a pivot have with it, and
#: what any set has with the pivot that is NEAR one of those: at most 64 - NEAR of their HANG tokens differ.
NEAR, HANG = 34, 46
FAR = NEAR + HANG - TOKENS
CHUNK = 1 << 20

_rng = np.random.RandomState(20)
_A = (_rng.randint(0, 1 << 62, TOKENS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.randint(0, 1 << 62, TOKENS).astype(np.uint64)


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text."""
    raw = raw.copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    starts, ends, words = word_spans(raw, at)
    h = word_hashes(raw, starts, ends)
    grams = gram_hashes(h, n)
    out = []
    for a, z in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : z - n + 1]) if z - a >= n else gram_hashes(h[a:z], z - a) if z > a else np.zeros(0, np.uint64))
    return out


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """Tokens of non-empty sets, a row for each."""
    x = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    out = np.zeros((len(sets), TOKENS), np.uint32)
    for k in range(TOKENS):
        out[:, k] = np.minimum.reduceat(((x * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def signatures(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set, tokens."""
    fields = [df.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("tokens", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(1))
            for i, j in chunks(at, CHUNK):
                sets = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], n)
                full = [s for s in sets if len(s)]
                rows = iter(minwise(full)) if full else iter(())
                tokens = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array(tokens, pa.binary())], [f.name for f in fields])

    return map_batches(df.select("doc_id", text_of(text).alias("text")), run, fields)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    raw, _ = text_bytes(column)
    return raw.view(kind).reshape(-1, width) if len(raw) else np.zeros((0, width), kind)


def sketch(tokens: np.ndarray) -> np.ndarray:
    low = (tokens & 15).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal 4-bit tokens of sketches."""
    x = (a ^ b).view(np.uint64)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)  # the lowest bit of four is set if any is
    return TOKENS - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)


#: n: the set's size.
_NODE = [T.StructField("node", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("n", T.LongType())]


def _rows(reps: pa.Array, tokens: np.ndarray, nodes: list[np.ndarray], n: pa.Array) -> Iterator[pa.RecordBatch]:
    s = pa.array([r.tobytes() for r in sketch(tokens)], pa.binary())
    for node in nodes:
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), reps, s, n], [f.name for f in _NODE])


def planted(reps: DataFrame, trees: int) -> DataFrame:
    """Each set at its node of level LEVELS of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _matrix(b.column(1), TOKENS, np.uint32)
            nodes = []
            for k in range(trees):
                node = np.full(len(t), k + 1, np.uint64)
                for level in range(LEVELS):
                    node = mix64(node * np.uint64(0x9E3779B97F4A7C15) + t[:, (LEVELS * k + level) % TOKENS].astype(np.uint64))
                nodes.append(node)
            yield from _rows(b.column(0), t, nodes, b.column(2))

    return map_batches(reps.select("rep", "tokens", "n"), run, _NODE)


def branched(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Children of (node, rep): two for each row, by tokens that the node chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _matrix(b.column(2), TOKENS, np.uint32)
            node = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            children = []
            for k in range(2):
                pick = (mix64(node + np.uint64(k + 1)) % np.uint64(TOKENS)).astype(np.int64)
                token = t[np.arange(len(t)), pick].astype(np.uint64) + (pick.astype(np.uint64) << np.uint64(32))
                children.append(mix64(node * np.uint64(0x9E3779B97F4A7C15) + token))
            yield from _rows(b.column(1), t, children, b.column(3))

    return map_batches(rows.join(reps, "rep").select("node", "rep", "tokens", "n"), run, _NODE)


#: star: a set and the pivot on which it hangs; else sets that pass the sketches.
_EDGE = [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("star", T.BooleanType())]


class Sets:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _sizes_fit(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


#: Pairs whose sketches are held at a time.
PAIRS = 1 << 17


def _across(grp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with different numbers in the sorted grp, at most about PAIRS at a time (a place's pairs stay together)."""
    k = len(grp)
    begin = np.searchsorted(grp, grp, "right")  # a place is paired with all after its own kin
    count = k - begin
    for a, z in chunks(np.concatenate([[0], np.cumsum(count)]), PAIRS):
        c = count[a:z]
        yield np.repeat(np.arange(a, z), c), np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[a:z], c)


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs across kin groups in each of the small nodes that pass sizes and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, rep, s, size, grp = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TOKENS // 2), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def done(end: int) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.diff(node[:end])) + 1
            first, last = np.concatenate([[0], edge]), np.concatenate([edge, [end]])
            count = last - first
            two = first[count == 2]
            two = two[(grp[two] != grp[two + 1]) & (alike(s[two], s[two + 1]) >= NEAR) & _sizes_fit(size[two], size[two + 1], percent)]
            left, right = [rep[two]], [rep[two + 1]]
            for a, z in zip(first[count > 2].tolist(), last[count > 2].tolist(), strict=True):
                order = a + np.argsort(grp[a:z], kind="stable")
                for i, j in _across(grp[order]):
                    i, j = order[i], order[j]
                    fits = _sizes_fit(size[i], size[j], percent)
                    i, j = i[fits], j[fits]
                    passed = alike(s[i], s[j]) >= NEAR
                    left.append(rep[i[passed]])
                    right.append(rep[j[passed]])
            x, y = np.concatenate(left), np.concatenate(right)
            new = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
            if len(new):
                yield pa.RecordBatch.from_arrays([pa.array(new[:, 0]), pa.array(new[:, 1]), pa.array(np.zeros(len(new), bool))], [f.name for f in _EDGE])

        for b in batches:
            node = np.concatenate([node, b.column(0).to_numpy(zero_copy_only=False)])
            rep = np.concatenate([rep, b.column(1).to_numpy(zero_copy_only=False)])
            s = np.concatenate([s, _matrix(b.column(2), TOKENS // 2, np.uint8)])
            size = np.concatenate([size, b.column(3).to_numpy(zero_copy_only=False)])
            grp = np.concatenate([grp, b.column(4).to_numpy(zero_copy_only=False)])
            if len(node):
                n = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
                if n:
                    yield from done(n)
                    node, rep, s, size, grp = node[n:], rep[n:], s[n:], size[n:], grp[n:]
        if len(node):
            yield from done(len(node))

    return map_batches(rows.repartition("node").sortWithinPartitions("node").select("node", "rep", "sketch", "n", "grp"), run, _EDGE)


def against_pivots(rows: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Rows of nodes that have a pivot, with their equal tokens with it and whether sizes fit."""
    fields = [*_NODE[:2], T.StructField("pivot", T.LongType()), T.StructField("alike", T.IntegerType()), _NODE[3], T.StructField("fits", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = alike(_matrix(b.column(2), TOKENS // 2, np.uint8), _matrix(b.column(4), TOKENS // 2, np.uint8))
            fits = _sizes_fit(b.column(5).to_numpy(zero_copy_only=False), b.column(6).to_numpy(zero_copy_only=False), percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int32()), b.column(5), pa.array(fits)], [f.name for f in fields])

    return map_batches(rows.join(small(pivots), "node").select("node", "rep", "sketch", "pivot", "ps", "n", "pn"), run, fields)


def hung(held: DataFrame, percent: int) -> DataFrame:
    """Edges between sets and the pivots on which they hang."""
    hangs, apart = F.col("fits") & (F.col("alike") >= HANG), F.col("rep") != F.col("pivot")
    pair = [F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"), F.lit(True).alias("star")]
    # a pivot that goes alone is compared with all; what it takes with it may be like sets that aren't like the pivot
    taken = stored(held.filter(hangs).groupBy("node").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("taken")).filter("taken > 1").drop("taken"), "taken")
    kin = held.filter(~hangs).join(small(taken), "node").filter(apart & (F.col("alike") >= FAR) & (100 * F.col("n") >= percent * F.col("low")) & (percent * F.col("n") <= 100 * F.col("high")))
    return held.filter(apart & hangs).select(*pair).unionByName(kin.select(*pair)).distinct()


def candidates(reps: DataFrame, trees: int, similarity: float) -> DataFrame:
    """Edges (a, b, star) between sets that met in a node and pass the sketches, and between sets and the pivots that they hang on.

    Small nodes of all levels are compared in one pass at the end: a level only finds its large nodes and their pivots and branches.
    What hangs on pivots of the first level are kin groups; pairs within one are left out from then on, as stars join them.
    """
    rows, percent = planted(reps, trees), round(similarity * 100)
    large = stored(rows.groupBy("node").count().filter(F.col("count") > SMALL).select("node"), "large")
    if large.isEmpty():
        return stored(compared(rows.withColumn("grp", F.col("rep")), percent).distinct(), "near")
    # nodes of one set take no part; they are most of them
    alone, levels = rows.join(small(large), "node", "left_anti").withColumn("grp", F.col("rep")), []
    rows = stored(rows.join(small(large), "node", "left_semi").withColumn("grp", F.col("rep")), "large")
    apart, hangs = F.col("rep") != F.col("pivot"), F.col("fits") & (F.col("alike") >= HANG)
    stars = kin = None
    for level in range(LEVELS, DEEPEST + 1):
        # a node is large by its pairs across kin groups, twice SMALL * SMALL / 2; one without any has nothing left to compare
        least = F.min(F.struct(F.xxhash64("rep", "node").alias("h"), "rep", "sketch", "n"))
        pivot = rows.groupBy("node", "grp").agg(F.count("*").alias("k"), least.alias("p")).groupBy("node").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"), F.min("p").alias("p"))
        pivot = pivot.withColumn("across", F.col("k") * F.col("k") - F.col("own")).filter((F.col("k") > SMALL) & ((F.col("across") > SMALL * SMALL) | (F.col("across") == 0)))
        pivot = stored(pivot.select("node", F.col("p.rep").alias("pivot"), F.col("p.sketch").alias("ps"), F.col("p.n").alias("pn"), "across"), "pivots")
        alone = alone.unionByName(rows.join(small(pivot.select("node")), "node", "left_anti"))
        pivot = pivot.filter("across > 0").drop("across")
        if pivot.isEmpty():
            break
        levels.append(stored(against_pivots(rows, pivot, percent), "held"))
        if stars is None:
            stars = stored(hung(levels[0], percent), "stars")
            kin = small(components(stars).select(F.col("v").alias("rep"), F.col("component").alias("kin")))
            alone = with_kin(alone.drop("grp"), kin)
        if level < DEEPEST:
            rest = levels[-1].filter(~hangs).select("node", "rep")
            if level == LEVELS:  # what is left of a node may be of one kin group
                rest = with_kin(rest, kin)
                mixed = stored(rest.groupBy("node").agg((F.min("grp") < F.max("grp")).alias("mixed")).filter("mixed").select("node"), "mixed")
                rest = rest.join(small(mixed), "node", "left_semi").select("node", "rep")
            rows = stored(with_kin(branched(rest, reps), kin), "branched")
    if not levels:  # rows of one id are many, but no pairs
        return stored(compared(alone, percent).distinct(), "near")
    held = reduce(DataFrame.unionByName, levels)
    pair = [F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")]
    edges = compared(alone, percent).unionByName(held.filter(apart & F.col("fits") & (F.col("alike") >= NEAR)).select(*pair, F.lit(False).alias("star")))
    edges = reduce(DataFrame.unionByName, [edges, stars, *([hung(reduce(DataFrame.unionByName, levels[1:]), percent)] if levels[1:] else [])])
    if len(levels) > DEEPEST - LEVELS:  # too deep to branch: such sets stay with their pivot, and the exact comparison tells them apart
        edges = edges.unionByName(levels[-1].filter(apart).select(*pair, F.lit(True).alias("star")))
    return stored(edges.distinct(), "near")


def with_kin(rows: DataFrame, kin: DataFrame) -> DataFrame:
    """rows with grp, the kin group of rep; a set that has none is its own."""
    return rows.join(kin, "rep", "left").withColumn("grp", F.coalesce("kin", "rep")).drop("kin")


def links(sets: list[np.ndarray], similarity: float, own: Sets, only: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Joins in `own` what is similar (at least one of a pair being in `only`); returns pairs that joined something."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    if n < 2:
        return []
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = df[token] > 1
    token, owner = token[shared], owner[shared]
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    at = np.searchsorted(token[order], np.arange(len(df) + 1))
    mine = np.searchsorted(owner, np.arange(n + 1))
    percent = round(similarity * 100)
    out = []
    for i in range(n):
        if only is not None and not only[i]:
            continue
        t = token[mine[i] : mine[i + 1]]
        if not len(t):
            continue
        count = at[t + 1] - at[t]
        where = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[t], count)
        common = np.bincount(posting[where], minlength=n)
        found = np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common))
        for j in found.tolist():
            if j != i and own.join(i, j):
                out.append((i, j))
    return out


def resolved(members: DataFrame, n: int, similarity: float) -> DataFrame:
    """Edges between similar sets among the rows (bucket, part, rep, digest, text, label, only) that share bucket and part.

    Rows that share a label are known to be connected. If any row of a part is `only`, pairs without one are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        texts = [t.encode() for t in pdf["text"]]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        sets = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), at, n)
        true = [digest(s) == bytes(d) for s, d in zip(sets, pdf["digest"], strict=True)]
        frame = pdf.assign(_i=np.arange(len(pdf)))[true].drop_duplicates(["part", "rep", "digest"])
        for _, g in frame.sort_values("rep").groupby("part", sort=False):
            own = Sets(len(g))
            first: dict[int, int] = {}
            for k, label in enumerate(g["label"].tolist()):
                own.join(k, first.setdefault(label, k))
            rep, only = g["rep"].tolist(), g["only"].to_numpy()
            out += [(rep[i], rep[j]) for i, j in links([sets[i] for i in g["_i"]], similarity, own, only if only.any() else None)]
        give_back()
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return members.groupBy("bucket").applyInPandas(run, "a long, b long")


def weighed(groups: DataFrame, weights: DataFrame) -> DataFrame:
    """(rep, grp, size, weight) of members (rep, grp); size: the group's weight."""
    groups = stored(groups.join(weights, "rep"), "members")
    sizes = groups.groupBy("grp").agg(F.sum("weight").alias("size"))
    return stored(groups.join(small(sizes), "grp").select("rep", "grp", "size", "weight"), "groups")


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` with the text of each rep; only texts that are wanted move, as long as their ids are few enough to be sent."""
    texts, ids = docs.select(F.col("doc_id").cast("long").alias("rep"), text_of().alias("text")), wanted.select("rep").distinct()
    if not in_bounds(wanted):
        return texts.join(small(ids), "rep", "left_semi").join(wanted, "rep")
    return texts.join(F.broadcast(wanted), "rep")


def exact_components(docs: DataFrame, reps: DataFrame, near: DataFrame, n: int, similarity: float) -> DataFrame:
    """(v, component) of the true links among candidates (a, b, star)."""
    weights = stored(reps.groupBy("rep").agg(F.sum("weight").alias("weight")), "weights")
    groups = weighed(components(near).select(F.col("v").alias("rep"), F.col("component").alias("grp")), weights)
    large = stored(groups.filter(F.col("size") > 2 * BLOCK).select("rep", "grp", "size"), "chained")
    if large.isEmpty():
        return linked(docs, reps, groups, n, similarity)
    chained = stored(near.join(small(large.withColumnRenamed("rep", "a")), "a"), "chained")
    stars = components(chained.filter("star")).select(F.col("v").alias("rep"), F.col("component").alias("grp"))
    groups = weighed(groups.filter(F.col("size") <= 2 * BLOCK).select("rep", "grp").unionByName(stars), weights)
    result = linked(docs, reps, groups, n, similarity)
    pairs = chained.filter("not star").drop("star")
    for x in ("a", "b"):  # what stars join has been compared
        pairs = pairs.join(small(stars.withColumnsRenamed({"rep": x, "grp": f"s{x}"})), x, "left")
    pairs = pairs.filter(F.coalesce("sa", "a") != F.coalesce("sb", "b")).drop("sa", "sb")
    again = paired(docs, reps, weights, pairs, result, n, similarity)
    return components(result.filter("v <> component").select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(again))


def paired(docs: DataFrame, reps: DataFrame, weights: DataFrame, pairs: DataFrame, known: DataFrame, n: int, similarity: float) -> DataFrame:
    """Edges of the true links among pairs (a, b, grp, size) that aren't in one component of `known`.

    Pairs meet in cells, by the blocks of their group that a and b are in, so a text moves once for a cell and not for each pair.
    """
    by = small(known.filter("v <> component"))
    for x in ("a", "b"):
        pairs = pairs.join(by, F.col(x) == F.col("v"), "left").withColumn(f"l{x}", F.coalesce("component", x)).drop("v", "component")
    pairs = stored(pairs.filter("la <> lb"), "pairs")
    block = [F.pmod(F.xxhash64(x), F.ceil(F.col("size") / BLOCK)).cast("long") for x in ("a", "b")]
    sides = [pairs.select(F.col(x).alias("rep"), F.col(f"l{x}").alias("label"), F.concat_ws(":", "grp", *block).alias("part"), F.lit(x == "a").alias("only")) for x in ("a", "b")]
    wanted = sides[0].unionByName(sides[1]).groupBy("rep", "label", "part").agg(F.max("only").alias("only"))
    wanted = stored(wanted.join(reps.select("rep", "digest"), "rep"), "asked")
    buckets = max(1, wanted.join(weights, "rep").agg(F.sum("weight")).first()[0] or 0) // BLOCK + 1
    return resolved(with_texts(docs, wanted).withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets))), n, similarity)


def linked(docs: DataFrame, reps: DataFrame, groups: DataFrame, n: int, similarity: float) -> DataFrame:
    """(v, component) of the true links within candidate groups (rep, grp, size, weight)."""
    texts = with_texts(docs, groups.drop("weight").join(reps.select("rep", "digest"), "rep"))
    total = groups.agg(F.sum("weight")).first()[0] or 0
    buckets = max(1, total // BLOCK)
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK)).cast("long")
    part = F.when(F.col("size") <= 2 * BLOCK, F.concat_ws(":", "grp")).otherwise(F.concat_ws(":", "grp", block))
    base = texts.select("rep", "grp", "size", "digest", "text", F.col("rep").alias("label"), F.lit(False).alias("only"))
    bucket = F.when(F.col("size") <= 2 * BLOCK, F.pmod(F.xxhash64("grp"), F.lit(buckets))).otherwise(F.xxhash64("part"))
    whole = base.withColumn("part", part)
    giants = groups.filter(F.col("size") > 2 * BLOCK)
    large = stored(giants.select("grp", "size").distinct(), "giants")
    some = not large.isEmpty()
    if some:  # pivots of each large group are in all of its blocks
        pivots = giants.groupBy("grp").agg(F.slice(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64("rep", F.lit(7)), F.greatest(F.lit(1), F.col("size") / 64).cast("long")) == 0, F.col("rep")))), 1, 16).alias("p")).select("grp", F.explode("p").alias("rep"))
        more = base.join(small(pivots), ["rep", "grp"], "left_semi").withColumn("part", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK).cast("long") - 1), lambda i: F.concat_ws(":", "grp", i))))
        whole = whole.unionByName(more)
    found = stored(resolved(whole.withColumn("bucket", bucket), n, similarity), "links")
    result = components(found)
    if not some:
        return result
    # what hasn't joined the largest part of its large group is compared with all blocks
    labelled = giants.join(result, giants["rep"] == result["v"], "left").select("rep", "grp", "size", "weight", F.coalesce("component", "rep").alias("label"))
    labelled = stored(labelled, "labelled")
    main = labelled.groupBy("grp", "label").count().groupBy("grp").agg(F.max(F.struct("count", "label")).alias("m")).select("grp", F.col("m.label").alias("main"))
    rest = stored(labelled.join(small(main), "grp").filter(F.col("label") != F.col("main")).select("rep", "grp", "size", "weight", "label"), "rest")
    if rest.isEmpty():
        return result
    rests = rest.groupBy("grp").agg(F.sum("weight").alias("rests"))
    lots = F.ceil(F.col("rests") / BLOCK).cast("long")
    cell = F.concat_ws(":", "grp", "block", "lot")
    others = texts.join(small(labelled.select("rep", "label")), "rep").join(small(rests), "grp").withColumn("block", block)
    others = others.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1))).select("rep", "digest", "text", "label", F.lit(False).alias("only"), cell.alias("part"))
    asked = texts.join(small(rest.select("rep", "label")), "rep").join(small(rests), "grp").withColumn("lot", F.pmod(F.xxhash64("rep", F.lit(3)), lots))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK).cast("long") - 1))).select("rep", "digest", "text", "label", F.lit(True).alias("only"), cell.alias("part"))
    again = resolved(others.unionByName(asked).withColumn("bucket", F.xxhash64("part")), n, similarity)
    known = result.filter("v <> component").select(F.col("v").alias("a"), F.col("component").alias("b"))
    return components(known.unionByName(again))


def groups(df: DataFrame, n: int = 5, similarity: float = 0.8, trees: int = TREES, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept, for each row of df (ids are integers)."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(signatures(docs, n), "signed")
    sets = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.first(F.expr(f"1 + n_shingles div {UNIT}")).alias("weight"), F.first("n_shingles").alias("n"))
    # a doc_id of several rows may stand for several sets: they meet as one vertex
    reps = stored(sets.select("rep", "digest", "tokens", "weight", "n"), "reps")
    near = candidates(reps, trees, similarity)
    found = stored(exact_components(docs, reps, near, n, similarity), "components")
    moved = found.filter("v <> component")
    by = reps.select("digest", "rep").join(small(moved), F.col("rep") == F.col("v"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("tokens").join(by, "digest", "left")
    out = out.withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(df: DataFrame, n: int = 5, similarity: float = 0.8, trees: int = TREES, text: str = "text") -> DataFrame:
    """df with one document of each group, the one with the smallest id."""
    (mark,) = helpers(df, "gone")
    gone = stored(groups(df, n, similarity, trees, text).filter("not kept").select(F.col("doc_id").alias(mark)).distinct(), "gone")
    return df.join(small(gone), F.col("doc_id").cast("long") == F.col(mark), "left_anti")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), n=2)
