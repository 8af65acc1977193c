"""Loading a stream by a fixed catalogue: shredding is stateless, so each table is a streaming DataFrame of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..engine import load
from ..plans.catalog import Catalog
from ..sources.records import checked, prepare


def records(spark: SparkSession, path: str, doc_id: str = "$.id") -> DataFrame:
    """JSON lines as they arrive; a record's id is the given path of it, or the md5 of its text where it has none."""
    prepare(spark)
    lines = spark.readStream.text(path).filter(F.trim("value") != "")
    v = F.parse_json("value")
    return checked(lines.select(F.coalesce(F.try_variant_get(v, doc_id, "string"), F.md5("value")).alias("doc_id"), v.alias("v")))


def start(stream: DataFrame, catalog: Catalog, out: str, checkpoint: str, fmt: str = "parquet", available_now: bool = False) -> StreamingQuery:
    """One query writes all tables: each micro-batch is parsed once and its tables are appended, parents first. A batch that is run again replaces its own files."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for t in catalog:
                load(batch, catalog)[t.name].write.format(fmt).mode("overwrite").save(f"{out}/{t.name}/epoch={epoch}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def table(stream: DataFrame, catalog: Catalog, name: str) -> DataFrame:
    """One table as a streaming DataFrame."""
    return load(stream, catalog)[name]
