"""Counts, rates, examples and reports of anomalies."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TooManyAnomalies(RuntimeError):
    pass


def summary(anomalies: DataFrame, rows: DataFrame, examples: int = 5) -> DataFrame:
    """table, column, expected_type, count, total, rate, examples: from anomalies and (table, total).

    Examples are the ones with the smallest row ids; each task keeps that many, so a column of very many is no burden.
    """
    keys = ["table", "column", "expected_type"]
    counts = anomalies.groupBy(*keys).agg(F.count("*").alias("count"))
    x = F.struct("row_id", "actual_value", "actual_type")
    firsts = anomalies.withColumn("_b", F.pmod(F.xxhash64("row_id"), F.lit(64))).groupBy(*keys, "_b").agg(F.slice(F.sort_array(F.collect_set(x)), 1, examples).alias("e"))
    firsts = firsts.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, examples).alias("examples"))
    out = counts.join(firsts, keys).join(F.broadcast(rows), "table", "left")  # rows: one for each table
    return out.select(*keys, "count", "total", (F.col("count") / F.col("total")).alias("rate"), "examples")


def ordered(summary: DataFrame) -> list[dict]:
    return sorted((r.asDict(recursive=True) for r in summary.collect()), key=lambda r: (-r["count"], r["table"], r["column"]))


def overall_rate(n_anomalies: int, n_rows: int) -> float:
    """Anomalies by rows of all tables; more than one is possible."""
    return n_anomalies / n_rows if n_rows else 0.0


def check_rate(n_anomalies: int, n_rows: int, most: float | None) -> None:
    if most is not None and (rate := overall_rate(n_anomalies, n_rows)) > most:
        raise TooManyAnomalies(f"anomaly rate {rate:.6f} is over {most}")


def top_tables(anomalies: DataFrame, n: int = 10) -> DataFrame:
    return anomalies.groupBy("table").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "table").limit(n)


def write_by_table(anomalies: DataFrame, path: str) -> None:
    """JSON lines in a folder for each table."""
    anomalies.write.mode("overwrite").partitionBy("table").json(path)


CSV_HEADER = ["table", "column", "expected_type", "count", "total", "rate_percent", "examples"]


def report(summary: DataFrame, kind: str = "json") -> str:
    rows = ordered(summary)
    if kind == "json":
        return json.dumps(rows, indent=2, ensure_ascii=False)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(CSV_HEADER)
    for r in rows:
        w.writerow([r["table"], r["column"], r["expected_type"], r["count"], r["total"], f"{(r['rate'] or 0) * 100:.4f}", " | ".join(str(e["actual_value"]) for e in r["examples"])])
    return out.getvalue()
