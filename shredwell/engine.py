"""infer, plan, load: from records to a catalogue to tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anomalies as A
from .operators.shred import Shredder
from .options import Options
from .plans import catalog as C
from .plans import infer as I
from .plans import overrides
from .sinks import write
from .sources import records as R


def infer(records: DataFrame, options: Options | None = None, layouts: bool = True) -> C.Catalog:
    """The catalogue of records (doc_id, v), from a scan of all of them."""
    o = options or Options()
    return C.plan(I.infer(records, o.root), o, layouts)


@dataclass
class Load:
    """Tables of records by a catalogue; nothing has run yet."""

    catalog: C.Catalog
    shredder: Shredder

    def __getitem__(self, name: str) -> DataFrame:
        return self.shredder.data(name)

    def tables(self) -> dict[str, DataFrame]:
        return {t.name: self.shredder.data(t) for t in self.catalog}

    def anomalies(self) -> DataFrame:
        return self.shredder.all_anomalies()

    def row_counts(self) -> DataFrame:
        """(table, total) in one job."""
        out = None
        for t in self.catalog:
            n = self.shredder.data(t).agg(F.count("*").alias("total")).select(F.lit(t.name).alias("table"), "total")
            out = n if out is None else out.unionByName(n)
        return out

    def summary(self) -> DataFrame:
        return A.summary(self.anomalies(), self.row_counts(), self.catalog.options.examples)


def load(records: DataFrame, catalog: C.Catalog) -> Load:
    return Load(catalog, Shredder(records, catalog))


def inspect(records: DataFrame, n: int = 500, options: Options | None = None) -> tuple[C.Catalog, list[str], int]:
    """Plain tables of n records, the records as text, and how many columns hold more than one type."""
    some = records.limit(n)
    samples = [r[0] for r in some.select(F.to_json("v")).collect()]
    spark = records.sparkSession
    again = R.from_strings(spark.createDataFrame([(str(i), s) for i, s in enumerate(samples)], "doc_id string, t string"), "t", "doc_id")
    o = replace(options or Options(), wide_threshold=0, sibling_threshold=0, max_columns=0)
    catalog = infer(again, o, layouts=False)
    return catalog, samples, len(I.mixed_columns(catalog.stats))


def save_snapshot(catalog: C.Catalog, path: str) -> None:
    Path(path).write_text(json.dumps(C.to_snapshot(catalog), indent=2, ensure_ascii=False))


def load_snapshot(path: str) -> C.Catalog:
    return C.from_snapshot(json.loads(Path(path).read_text()))


def run(spark: SparkSession, path: str, out: str, options: Options | None = None, snapshot: str | None = None, toml: str | None = None, fmt: str = "parquet", anomaly_dir: str | None = None) -> tuple[Load, list[dict]]:
    """Infer (or take a snapshot), apply overrides, write all tables, report anomalies. Too many of them fail the run after the data is written."""
    o = options or Options(root=R.root_name(path))
    records = R.read(spark, path).persist(StorageLevel.MEMORY_AND_DISK)  # every table reads it
    try:
        catalog = load_snapshot(snapshot) if snapshot else infer(records, o)
        if toml:
            catalog = overrides.apply_toml(catalog, toml)
        loaded = load(records, catalog)
        write.write_tables(loaded.tables(), catalog, out, fmt, o.drop_existing)
        if anomaly_dir:
            A.write_by_table(loaded.anomalies(), anomaly_dir)
        report = A.ordered(loaded.summary())
        total = sum(r["total"] for r in loaded.row_counts().collect())
        A.check_rate(sum(r["count"] for r in report), total, o.max_anomaly_rate)
        return loaded, report
    finally:
        records.unpersist()
