"""Command line: `python -m shredwell.cli load INPUT OUTPUT` and `python -m shredwell.cli inspect INPUT`."""

from __future__ import annotations

import argparse
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from . import engine
from .operators import anomalies as A
from .operators import stats
from .options import Options
from .plans import overrides
from .sinks import ddl
from .sources import records as R


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shredwell")
    sub = p.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load")
    load.add_argument("input")
    load.add_argument("output", nargs="?")
    load.add_argument("--schema", default="public")
    load.add_argument("--table")
    load.add_argument("--drop-existing", action="store_true")
    load.add_argument("--anomaly-dir")
    load.add_argument("--anomaly-output")
    load.add_argument("--anomaly-format", choices=["json", "csv"], default="json")
    load.add_argument("--max-anomaly-rate", type=float)
    load.add_argument("--text-threshold", type=int, default=256)
    load.add_argument("--dry-run", action="store_true")
    load.add_argument("--array-columns", action="store_true")
    load.add_argument("--depth-limit", type=int)
    load.add_argument("--schema-report", action="store_true")
    load.add_argument("--schema-report-output")
    load.add_argument("--schema-config")
    load.add_argument("--schema-output")
    load.add_argument("--schema-input")
    load.add_argument("--wide-column-threshold", type=int, default=100)
    load.add_argument("--sibling-threshold", type=int, default=3)
    load.add_argument("--sibling-jaccard", type=float, default=0.5)
    load.add_argument("--stable-threshold", type=float, default=0.10)
    load.add_argument("--rare-threshold", type=float, default=0.001)
    load.add_argument("--format", choices=["parquet", "orc", "json"], default="parquet")
    look = sub.add_parser("inspect")
    look.add_argument("input")
    look.add_argument("--limit", type=int, default=500)
    look.add_argument("--table")
    look.add_argument("--text-threshold", type=int, default=256)
    look.add_argument("--sample-output")
    return p


def options(a: argparse.Namespace) -> Options:
    return Options(root=R.root_name(a.input, a.table), text_threshold=a.text_threshold, array_columns=a.array_columns, wide_threshold=a.wide_column_threshold, sibling_threshold=a.sibling_threshold, sibling_jaccard=a.sibling_jaccard, stable_threshold=a.stable_threshold, rare_threshold=a.rare_threshold, depth_limit=a.depth_limit, max_anomaly_rate=a.max_anomaly_rate, schema=a.schema, drop_existing=a.drop_existing)


def stdin_file(spark: SparkSession) -> str:
    """Standard input as a file, as it is read twice: in the folder that driver and executors share, or of this machine if there is no other."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise R.SourceError("spark.checkpoint.dir must name a shared folder to load standard input on a cluster")
        base = f"file://{tempfile.mkdtemp()}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/stdin-{uuid.uuid4().hex}.json")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    try:
        while chunk := sys.stdin.read(1 << 20):
            out.write(bytearray(chunk.encode()))
    finally:
        out.close()
    return p.toString()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("shredwell").getOrCreate()
    path = stdin_file(spark) if a.input == "-" else a.input
    if a.command == "inspect":
        catalog, samples, mixed = engine.inspect(R.read(spark, path), a.limit, Options(root=R.root_name(a.input, a.table), text_threshold=a.text_threshold))
        print(f"{len(samples)} records, {len(catalog.tables)} tables, {mixed} columns of mixed types\n{stats.text(catalog)}")
        if a.sample_output:
            Path(a.sample_output).write_text("".join(s + "\n" for s in samples))
        return 0
    o, records = options(a), R.read(spark, path).persist(StorageLevel.MEMORY_AND_DISK)  # read once for counts, levels and tables
    try:
        return _load(a, o, records)
    finally:
        records.unpersist()


def _load(a: argparse.Namespace, o: Options, records: DataFrame) -> int:
    catalog = engine.load_snapshot(a.schema_input) if a.schema_input else engine.infer(records, o)
    if a.schema_config:
        catalog = overrides.apply_toml(catalog, Path(a.schema_config).read_text())
    for w in [*catalog.warnings, *(f"name of {p} is {n}" for p, n in catalog.names_changed), *(f"{t}: {k} has a name of its own" for t, k in catalog.collisions)]:
        print(f"warning: {w}", file=sys.stderr)
    if a.schema_output:
        engine.save_snapshot(catalog, a.schema_output)
    if a.schema_report or a.schema_report_output:
        text = stats.text(catalog) if catalog.stats else "no statistics in a snapshot"
        Path(a.schema_report_output).write_text(text) if a.schema_report_output else print(text)
    if a.dry_run:
        print(ddl.script(catalog))
        return 0
    if not a.output:
        print("an output folder is needed", file=sys.stderr)
        return 2
    loaded = engine.load(records, catalog)
    engine.write.write_tables(loaded.tables(), catalog, a.output, a.format, o.drop_existing)
    if a.anomaly_dir:
        A.write_by_table(loaded.anomalies(), a.anomaly_dir)
    summary = loaded.summary()
    if a.anomaly_output:
        Path(a.anomaly_output).write_text(A.report(summary, a.anomaly_format))
    rows = sum(r["total"] for r in loaded.row_counts().collect())
    bad = sum(r["count"] for r in A.ordered(summary))
    print(f"{rows} rows in {len(catalog.tables)} tables, {bad} anomalies", file=sys.stderr)
    if bad:
        for r in A.top_tables(loaded.anomalies()).collect():
            print(f"  {r['table']}: {r['count']} anomalies", file=sys.stderr)
    try:
        A.check_rate(bad, rows, o.max_anomaly_rate)
    except A.TooManyAnomalies as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
