"""Exact dedup over a log-structured merge index; DataFrame functions only.

Each task of a batch's scan is a memtable: its rows' digests are sorted and flushed as one sorted run, and each batch's runs
carry a filter, the 64-bit fingerprints of their digests with how often each occurs. Nothing but fingerprints is shuffled
for that. A new batch is held against the filters: a row whose fingerprint is in no older filter and occurs once in its own
is new, and no run is read and no digest moved for it. What the filters let through is looked up in the runs whose filter
has it; these hits are verified on the bytes: texts are grouped by digest and text, equal ones merging within each task
before any shuffle, and a digest that different texts share comes apart into a group for each text. When FANOUT runs are on
a level they are compacted: merged by range of digest into one sorted run of the next level, an entry for each digest, which
keeps the identifier that stays (the smallest, or the largest if asked) and the number of copies. Entries merge by SHA-256;
should verification ever find two texts of one, it fails rather than merge them.

`Index.add` takes batches one after the other; a batch's outcome counts everything before it. `groups` and `dedup` take a
table as one batch. Null texts are empty texts. Null ids order below all others; a group without any id has keep_id null.
Rows that repeat both id and text count in group_size, one row comes out for each, and one of them is kept. Empty tables
give empty results. `digest_bytes` under 32 shortens the index's digests; that costs verification, never a wrong group.
Other columns of a batch are ignored by `add` and kept by `dedup`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import helpers, small, stored, table, text_of

#: Runs of one level that are merged into one of the next.
FANOUT = 4
#: Groups with more copies than one in so many rows are sent to all tasks when rows look their group up: there can't be more of them than that.
LARGE_GROUPS = 100_000


@dataclass
class Run:
    """entries: (digest, sha, doc_id, row, copies) sorted by digest within files; the digest is the beginning of sha and
    isn't stored besides. filter: (h, n) fingerprints. level: merges so far."""

    level: int
    entries: DataFrame
    filter: DataFrame


def _digests(rows: DataFrame, digest_bytes: int) -> DataFrame:
    """rows that have sha, with the index's digest of it."""
    return rows.withColumn("digest", F.substring("sha", 1, digest_bytes))


def _sha(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sha", F.unhex(F.sha2("_text", 256)))


def flush(rows: DataFrame, digest_bytes: int) -> Run:
    """Write one sorted run for each task, and the filter of all."""
    runs = _sha(rows).select("sha", "doc_id", F.monotonically_increasing_id().alias("row"), F.lit(1).cast("long").alias("copies"))
    runs = _digests(stored(runs.sortWithinPartitions("sha", "doc_id"), "run"), digest_bytes)
    return Run(0, runs, stored(_fingerprints(runs).groupBy("h").agg(F.sum("copies").alias("n")), "filter"))


def _fingerprints(entries: DataFrame) -> DataFrame:
    return entries.select(F.xxhash64("digest").alias("h"), "copies")


def best(largest: bool, old: Column) -> Column:
    """The identifier that stays, with its row; of equal ones the older."""
    x = F.struct("doc_id", old.alias("old"), "row")
    return F.max(x) if largest else F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", (~old).alias("new"), old.alias("old"), "row"))


def compacted(runs: list[Run], largest: bool, digest_bytes: int) -> Run:
    """One run of the next level: an entry for each digest and text hash, in ranges of digests; a task merges its own entries before they move."""
    x = _union([r.entries for r in runs]).groupBy("sha").agg(best(largest, F.lit(True)).alias("b"), F.sum("copies").alias("copies"))
    x = x.select("sha", "b.doc_id", "b.row", "copies")
    x = _digests(stored(x.repartitionByRange("sha").sortWithinPartitions("sha"), "run"), digest_bytes)
    return Run(1 + max(r.level for r in runs), x, stored(_union([r.filter for r in runs]).groupBy("h").agg(F.sum("n").alias("n")), "filter"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


@dataclass
class Batch:
    """What a batch's lookup found. new: entries that no filter lets through. entries: the others. hits: (digest, keep_id,
    keep_row, keep_old, group_size) of digests that several rows have, older ones counted. split: those digests that several texts
    share, as (digest, sha, doc_id, keep_id, keep_old, group_size, copies), or None."""

    new: DataFrame
    entries: DataFrame
    hits: DataFrame
    split: DataFrame | None
    rows: int


@dataclass
class Index:
    """Runs by level, newest last, and the batches whose texts hits are verified on."""

    largest: bool = False
    digest_bytes: int = 32
    runs: list[Run] = field(default_factory=list)
    texts: list[DataFrame] = field(default_factory=list)

    def look_up(self, df: DataFrame, text: str = "text") -> Batch:
        """Flush the batch, look it up, and take its runs in."""
        rows = df.select("doc_id", text_of(text).alias("_text"))
        run = flush(rows, self.digest_bytes)
        older = _union([r.filter.select("h") for r in self.runs]) if self.runs else None
        again = run.filter.filter("n > 1").select("h")
        if older is not None:
            again = again.union(run.filter.select("h").join(older, "h", "left_semi")).distinct()
        through = stored(again, "through").withColumn("_through", F.lit(True))
        entries = run.entries.withColumn("h", F.xxhash64("digest"))
        marked = entries.join(small(through), "h", "left")
        mine = stored(marked.filter("_through").drop("_through"), "entries")
        ids = mine.select("doc_id", "digest", "sha", "row", "copies", F.lit(False).alias("old"))
        if older is not None:  # runs whose filter hasn't got the fingerprint add nothing
            old = [r.entries.withColumn("h", F.xxhash64("digest")).join(small(through.select("h")), "h", "left_semi").select("doc_id", "digest", "sha", "row", "copies", F.lit(True).alias("old")) for r in self.runs]
            ids = stored(_union([ids, *old]), "found")
        hits = ids.groupBy("digest").agg(best(self.largest, F.col("old")).alias("b"), F.sum("copies").alias("group_size"))
        hits = stored(hits.filter("group_size > 1").select("digest", F.col("b.doc_id").alias("keep_id"), F.col("b.row").alias("keep_row"), F.col("b.old").alias("keep_old"), "group_size"), "hits")
        split = self._verified(rows, ids, hits)
        batch = Batch(marked.filter("_through IS NULL").drop("_through"), mine, hits, split, run.entries.count())
        self.texts.append(rows)
        self.runs.append(run)
        self._merge()
        return batch

    def _verified(self, rows: DataFrame, ids: DataFrame, hits: DataFrame) -> DataFrame | None:
        """The bytes of all hits: digests that several texts share come apart."""
        wanted = ids.join(small(hits.select("digest")), "digest", "left_semi").select(F.col("doc_id").alias("_id")).distinct()
        wanted = small(stored(wanted, "wanted"))
        new = [rows.withColumn("old", F.lit(False))]
        texts = _union(new + [t.withColumn("old", F.lit(True)) for t in self.texts])
        texts = _digests(_sha(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")), self.digest_bytes)
        distinct = stored(texts.groupBy("digest", "sha", "_text").agg(F.lit(1).alias("one")).groupBy("digest", "sha").agg(F.count("*").alias("texts")), "texts")
        if not distinct.filter("texts > 1").isEmpty():
            raise ValueError("different texts have one SHA-256")  # entries merge by it
        shared = stored(distinct.groupBy("digest").count().filter("count > 1").select("digest"), "shared")
        if shared.isEmpty():
            return None
        by_text = ids.join(shared, "digest", "left_semi").groupBy("digest", "sha").agg(best(self.largest, F.col("old")).alias("b"), F.sum("copies").alias("group_size"))
        mine = ids.filter("not old").groupBy("digest", "sha", "doc_id").agg(F.sum("copies").alias("copies"))
        out = mine.join(by_text, ["digest", "sha"])
        return stored(out.select("digest", "sha", "doc_id", F.col("b.doc_id").alias("keep_id"), F.col("b.old").alias("keep_old"), F.col("group_size").cast("long").alias("group_size"), "copies"), "split")

    def _merge(self) -> None:
        level = 0
        while len(same := [r for r in self.runs if r.level == level]) >= FANOUT:
            self.runs = [r for r in self.runs if r.level != level] + [compacted(same, self.largest, self.digest_bytes)]
            level += 1

    def add(self, df: DataFrame, text: str = "text") -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 for each row of the batch, by all that has been added up to it."""
        x = self.look_up(df, text)
        sha = F.lower(F.hex("sha")).alias("text_sha256")
        one = F.lit(1).cast("long").alias("group_size")
        out = x.new.select("doc_id", F.col("doc_id").alias("keep_id"), one, F.lit(True).alias("kept"), sha)
        rows, hits = x.entries, x.hits
        if x.split is not None:
            shared = x.split.select("digest").distinct()
            rows, hits = rows.join(shared, "digest", "left_anti"), hits.join(shared, "digest", "left_anti")
        # rows of a very large group don't meet on its digest: such groups go to the rows
        many = max(2, x.rows // LARGE_GROUPS)
        large = F.broadcast(hits.filter(F.col("group_size") > many).withColumnsRenamed({c: f"l_{c}" for c in ("keep_id", "keep_row", "keep_old", "group_size")}))
        rest = hits.filter(F.col("group_size") <= many)
        rows = rows.join(large, "digest", "left")
        of_large = rows.filter("l_group_size IS NOT NULL").withColumnsRenamed({f"l_{c}": c for c in ("keep_id", "keep_row", "keep_old", "group_size")})
        of_rest = rows.filter("l_group_size IS NULL").drop("l_keep_id", "l_keep_row", "l_keep_old", "l_group_size").join(rest, "digest", "left")
        hit = F.col("group_size").isNotNull()
        stays = ~hit | ((F.col("row") == F.col("keep_row")) & ~F.col("keep_old"))
        for part in (of_large, of_rest):
            out = out.unionByName(part.select("doc_id", F.when(hit, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), sha))
        if x.split is None:
            return out
        each = x.split.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1) & ~F.col("keep_old")
        return out.unionByName(each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), sha))


def groups(df: DataFrame, largest: bool = False, text: str = "text", digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of df."""
    return Index(largest, digest_bytes).add(df, text)


def dedup(df: DataFrame, largest: bool = False, text: str = "text", digest_bytes: int = 32) -> DataFrame:
    """df with one row of each group of equal texts; all its columns."""
    hash_, id_ = helpers(df, "sha", "id")
    fates = groups(df, largest, text, digest_bytes).filter("group_size > 1").groupBy("text_sha256", "doc_id").agg(F.max("kept").alias("stays"), F.count("*").alias("copies"))
    fates = stored(fates.withColumnsRenamed({"text_sha256": hash_, "doc_id": id_}), "fates")
    sha = F.sha2(text_of(text), 256)
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (sha == F.col(hash_))
    out = df.join(small(fates.filter("not stays or copies > 1").select(hash_, id_)), same, "left_anti")
    again = fates.filter("stays and copies > 1").select(hash_, id_)
    if again.isEmpty():
        return out
    # rows that repeat an id and its text: one of each stays
    return out.unionByName(df.join(small(again), same, "left_semi").withColumn(hash_, sha).dropDuplicates(["doc_id", hash_]).drop(hash_))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), largest=True)


ORACLE_OP4 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
