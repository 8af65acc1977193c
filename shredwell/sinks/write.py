"""Writing the tables of a load."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Catalog

FORMATS = ("parquet", "orc", "json")


def by_depth(catalog: Catalog) -> list[list[str]]:
    return [[t.name for t in g] for _, g in groupby(catalog.tables, key=lambda t: t.depth)]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_tables(frames: dict[str, DataFrame], catalog: Catalog, path: str, fmt: str = "parquet", overwrite: bool = False, workers: int = 4) -> None:
    """Each table in a folder of its name. All are written beside the target first and moved when all have succeeded, so a
    load that fails leaves nothing behind. Tables of one depth are independent jobs and run together, parents first."""
    spark = next(iter(frames.values())).sparkSession
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    fs, root = _fs(spark, path)
    try:
        for level in by_depth(catalog):
            with ThreadPoolExecutor(workers) as pool:
                list(pool.map(lambda n: frames[n].write.format(fmt).save(f"{staging}/{n}"), level))
        for level in by_depth(catalog):
            for n in level:
                _, source = _fs(spark, f"{staging}/{n}")
                _, target = _fs(spark, f"{path}/{n}")
                if overwrite:
                    fs.delete(target, True)
                if not fs.exists(target):
                    fs.rename(source, target)
                else:  # append: part files have names of their own
                    for f in fs.listStatus(source):
                        if not f.getPath().getName().startswith(("_", ".")):
                            fs.rename(f.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, f.getPath().getName()))
    finally:
        fs.delete(_fs(spark, staging)[1], True)


def save_as_tables(frames: dict[str, DataFrame], catalog: Catalog, database: str | None = None, overwrite: bool = False) -> None:
    for level in by_depth(catalog):
        for n in level:
            frames[n].write.mode("overwrite" if overwrite else "append").saveAsTable(f"{database}.{n}" if database else n)


def write_jdbc(frames: dict[str, DataFrame], catalog: Catalog, url: str, properties: dict[str, str], overwrite: bool = False, batch: int = 100_000) -> None:
    """Parents first; each table in batches."""
    for level in by_depth(catalog):
        for n in level:
            frames[n].write.option("batchsize", batch).option("truncate", True).jdbc(url, f"{checked_schema(catalog.options.schema)}.{n}", "overwrite" if overwrite else "append", properties)


def jdbc_url(host: str, port: int, database: str, user: str | None = None, password: str | None = None) -> str:
    """IPv6 hosts get brackets; what isn't plain is percent-encoded."""
    from urllib.parse import quote

    if not host or not database or not port:
        raise ValueError("a host, a port and a database are needed")
    host = f"[{host}]" if ":" in host and not host.startswith("[") else host if host.startswith("[") else quote(host, safe="")
    who = "&".join(f"{k}={quote(v, safe='')}" for k, v in (("user", user), ("password", password)) if v)
    return f"jdbc:postgresql://{host}:{port}/{quote(database, safe='')}{'?' + who if who else ''}"


def checked_schema(name: str) -> str:
    """The name of a database schema: letters, digits and underscores."""
    if not name or not all(c.isalnum() or c == "_" for c in name):
        raise ValueError(f"not a schema name: {name!r}")
    return name


def copy_field(c: Column) -> Column:
    """A value as COPY text: NULL is \\N; backslash, tab and line ends are escaped; a text with a NUL can't be copied and is NULL (the load has made it an anomaly)."""
    s = c.cast("string")
    s = F.when(F.instr(s, "\0") == 0, s)
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.coalesce(s, F.lit("\\N"))


def copy_text(df: DataFrame) -> DataFrame:
    """Rows as lines for COPY ... FROM STDIN. Arrays are in braces."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            item = lambda x: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(x.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("NULL"))
            c = F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(c, item), ","), F.lit("}")))
        cols.append(copy_field(c))
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def orphans(frames: dict[str, DataFrame], catalog: Catalog, name: str) -> DataFrame:
    """Rows of a table whose parent isn't there."""
    t = catalog[name]
    fk = next(c.name for c in t.columns if c.role == "parent")
    key = f"{catalog.options.prefix}id"
    parents = frames[t.parent].select(F.col(f"`{key}`").alias("_p"))
    return frames[name].join(parents, F.col(f"`{fk}`") == F.col("_p"), "left_anti")
