"""One query for each operator: records are built from the tables as JSON text, go through the engine, and come out as rows
that plain SQL on the same tables can tell."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine, naming
from .functions.tags import value_tag
from .operators import anomalies as A
from .operators import clean, stats
from .options import Options
from .plans import catalog as C
from .plans import infer as I
from .plans import overrides as O
from .plans import siblings
from .sinks import ddl, write
from .sources import records as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def frames(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables that stand in braces in it."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of JSON stay
    for t in used:
        sql = sql.replace("{{" + t + "}}", "{" + t + "}")
    return spark.sql(sql, **used)


def records(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return R.from_strings(R.spread(frames(spark, sf_dir, sql)), "t", "doc_id")


_kept: list[DataFrame] = []


def kept(r: DataFrame) -> DataFrame:
    """The records, parsed once for inference and load. Those of the query before are let go; should its result be read later, they are parsed again."""
    while _kept:
        _kept.pop().unpersist()
    _kept.append(r.persist(StorageLevel.MEMORY_AND_DISK))
    return r


def query(name: str, sql: str, root: str, select: Callable[[engine.Load], DataFrame], oracle: str | None, change: Callable[[C.Catalog], C.Catalog] | None = None, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = kept(records(spark, sf_dir, sql))
        c = engine.infer(r, replace(Options(root=root), **options))
        return select(engine.load(r, change(c) if change else c))

    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = oracle


def uuid(expr: str) -> str:
    """SQL for the id of a row."""
    h = f"md5({expr})"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"


def long(name: str, alias: str | None = None):
    return F.col(name).cast("long").alias(alias or name)


# ---- nested objects and arrays

CUSTOMERS = """SELECT CAST(c_custkey AS STRING) doc_id, to_json(named_struct('custkey', c_custkey, 'name', c_name, 'acctbal', c_acctbal,
  'nation', named_struct('name', n_name, 'region', named_struct('name', r_name)))) t
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
JOINED = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
ROOT_C = uuid("'customer:' || c_custkey")

query("norm_root", CUSTOMERS, "customer", lambda l: l["customer"].select("j2s_id", long("custkey"), "name", F.col("acctbal").cast("double")),
      f"SELECT {ROOT_C} AS j2s_id, c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal FROM {JOINED}")
query("norm_object_child", CUSTOMERS, "customer", lambda l: l["customer_nation"].select("j2s_id", "j2s_customer_id", "name"),
      f"SELECT {uuid(ROOT_C + " || '/nation'")} AS j2s_id, {ROOT_C} AS j2s_customer_id, n_name AS name FROM {JOINED}")
query("norm_grandchild", CUSTOMERS, "customer", lambda l: l["customer_nation_region"].select("j2s_customer_nation_id", "name"),
      f"SELECT {uuid(ROOT_C + " || '/nation'")} AS j2s_customer_nation_id, r_name AS name FROM {JOINED}")

ORDERS = """SELECT CAST(o_orderkey AS STRING) doc_id, to_json(named_struct('orderkey', o_orderkey, 'status', o_orderstatus, 'items', items, 'partkeys', items.partkey)) t
  FROM {orders} LEFT JOIN (SELECT l_orderkey, transform(sort_array(collect_list(struct(l_linenumber, l_partkey, l_quantity, l_extendedprice))),
    x -> named_struct('partkey', x.l_partkey, 'price', x.l_extendedprice)) items FROM {lineitem} GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
ITEMS = """(SELECT o_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ROOT_O = uuid("'orders:' || o_orderkey")

query("norm_object_array", ORDERS, "orders", lambda l: l["orders_items"].select("j2s_id", "j2s_orders_id", "j2s_order", long("partkey"), F.col("price").cast("double")),
      f"SELECT {uuid(ROOT_O + " || '/items[' || k || ']'")} AS j2s_id, {ROOT_O} AS j2s_orders_id, k AS j2s_order, l_partkey AS partkey, l_extendedprice AS price FROM {ITEMS}")
query("norm_order_col", ORDERS, "orders", lambda l: l["orders_items"].groupBy("j2s_order").agg(F.count("*").alias("n")),
      f"SELECT k AS j2s_order, count(*) AS n FROM {ITEMS} GROUP BY k")
query("norm_scalar_array", ORDERS, "orders", lambda l: l["orders_partkeys"].select("j2s_orders_id", "j2s_order", long("value")),
      f"SELECT {ROOT_O} AS j2s_orders_id, k AS j2s_order, l_partkey AS value FROM {ITEMS}")
query("array_column", ORDERS, "orders", lambda l: l["orders"].select(long("orderkey"), F.array_join("partkeys", ",").alias("partkeys")),
      f"SELECT o.o_orderkey AS orderkey, p AS partkeys FROM orders o LEFT JOIN (SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY k) AS p FROM {ITEMS} GROUP BY o_orderkey) x ON o.o_orderkey = x.o_orderkey", array_columns=True)


def _rejoin(l: engine.Load) -> DataFrame:
    i, o = l["orders_items"], l["orders"]
    return i.join(o, i["j2s_orders_id"] == o["j2s_id"]).groupBy(long("orderkey")).agg(F.count("*").alias("n"), F.sum(F.col("partkey").cast("long")).alias("parts"))


query("fk_rejoin_count", ORDERS, "orders", _rejoin, f"SELECT o_orderkey AS orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM {ITEMS} GROUP BY 1")
query("fk_integrity", ORDERS, "orders", lambda l: write.orphans(l.tables(), l.catalog, "orders_items").select("j2s_id"), "SELECT CAST(NULL AS VARCHAR) AS j2s_id WHERE false")

EVENTS = """SELECT CAST(event_id AS STRING) doc_id, concat('{"id":', event_id, ',"type":"', event_type, '","value":', value, ',"props":', props, '}') t FROM {events}"""
query("events_props_child", EVENTS, "events", lambda l: l["events_props"].select("j2s_events_id", long("k")),
      f"SELECT {uuid("'events:' || event_id")} AS j2s_events_id, CAST(props->>'k' AS BIGINT) AS k FROM events")

NULLS = """SELECT CAST(event_id AS STRING) doc_id, concat('{"id":', event_id, CASE event_id % 4 WHEN 0 THEN ',"tag":"null"' WHEN 1 THEN ',"tag":null' WHEN 2 THEN '' ELSE concat(',"tag":"', event_type, '"') END, '}') t FROM {events}"""
query("null_patterns", NULLS, "events", lambda l: l["events"].select(long("id"), "tag"),
      "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'null' WHEN 3 THEN event_type END AS tag FROM events")
query("missing_vs_null", NULLS, "events", lambda l: stats.frame(l.shredder.records.sparkSession, l.catalog).select("column", "total", "nulls", "present"),
      "SELECT 'id' AS \"column\", count(*) AS total, CAST(0 AS BIGINT) AS nulls, count(*) AS present FROM events UNION ALL SELECT 'tag', count(*), count(*) FILTER (event_id % 4 = 1), count(*) FILTER (event_id % 4 <> 2) FROM events")

# ---- layouts

PARTS = """SELECT CAST(p_partkey AS STRING) doc_id, to_json(named_struct('id', p_partkey, 'attrs', named_struct('size', p_size, 'price', p_retailprice,
  'low', IF(p_size % 2 = 0, p_size, NULL)))) t FROM {part}"""
PARTS_NULL = PARTS.replace(")))) t", "))), map('ignoreNullFields', 'false')) t")
ROOT_P = uuid("'part:' || p_partkey")
_pivot = lambda l: l["part_attrs"].select("j2s_part_id", "key", F.col("value").cast("double"))
query("pivot_eav", PARTS, "part", _pivot,
      f"SELECT {ROOT_P} AS j2s_part_id, 'size' AS key, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT {ROOT_P}, 'price', p_retailprice FROM part UNION ALL SELECT {ROOT_P}, 'low', p_size FROM part WHERE p_size % 2 = 0",
      lambda c: O.set_layout(c, "part_attrs", "pivot"))
query("pivot_null_value", PARTS_NULL, "part", _pivot,
      f"SELECT {ROOT_P} AS j2s_part_id, 'size' AS key, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT {ROOT_P}, 'price', p_retailprice FROM part UNION ALL SELECT {ROOT_P}, 'low', CASE WHEN p_size % 2 = 0 THEN p_size END FROM part",
      lambda c: O.set_layout(c, "part_attrs", "pivot"))
query("jsonb_child", PARTS, "part", lambda l: l["part_attrs"].select("j2s_part_id", F.get_json_object("data", "$.size").cast("long").alias("size")),
      f"SELECT {ROOT_P} AS j2s_part_id, CAST(p_size AS BIGINT) AS size FROM part", lambda c: O.set_layout(c, "part_attrs", "jsonb"))
query("jsonb_root", PARTS, "part", lambda l: l["part"].select("j2s_id", F.get_json_object("data", "$.attrs.low").cast("long").alias("low")),
      f"SELECT {ROOT_P} AS j2s_id, CAST(CASE WHEN p_size % 2 = 0 THEN p_size END AS BIGINT) AS low FROM part", lambda c: O.set_layout(c, "part", "jsonb"))
query("jsonb_flatten", PARTS, "part", lambda l: l["part"].select(long("id"), F.get_json_object("part_attrs", "$.size").cast("long").alias("size")),
      "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part", lambda c: O.jsonb_flatten(c, "part_attrs"))
query("flatten", PARTS, "part", lambda l: l["part"].select(long("id"), long("a_size"), F.col("a_price").cast("double"), long("a_low")),
      "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS a_size, p_retailprice AS a_price, CAST(CASE WHEN p_size % 2 = 0 THEN p_size END AS BIGINT) AS a_low FROM part", lambda c: O.flatten(c, "part_attrs", "a_"))
query("skip_table", PARTS, "part", lambda l: l.shredder.records.sparkSession.createDataFrame([(n,) for n in l.catalog.names()], "name string"), "SELECT 'part' AS name", lambda c: O.skip(c, "part_attrs"))

MEASURES = """SELECT CAST(p_partkey AS STRING) doc_id, to_json(named_struct('id', p_partkey, 'm', named_struct('size', p_size, 'size_100g', p_size * 2, 'size_unit', 'cm',
  'cost_100g', CAST(p_size + 1 AS BIGINT), 'cost_unit', p_brand))) t FROM {part}"""
MEASURED = f"SELECT {ROOT_P} AS j2s_part_id, 'size' AS name, CAST(p_size AS BIGINT) AS value, CAST(p_size * 2 AS BIGINT) AS c_100g, 'cm' AS unit FROM part UNION ALL SELECT {ROOT_P}, 'cost', NULL, p_size + 1, p_brand FROM part"
_measured = lambda l: l["part_m"].select("j2s_part_id", "name", long("value"), long("c_100g"), "unit")
query("structured_pivot", MEASURES, "part", _measured, MEASURED, lambda c: O.structured_pivot(c, "part_m", ["_100g", "_unit"]))
SPREAD = """SELECT CAST(p_partkey AS STRING) doc_id, concat('{"id":', p_partkey, ',"m":{"b', k, '":', p_size, ',"b', k, '_100g":', p_size * 2, ',"b', k, '_unit":"', p_brand, '"}}') t FROM (SELECT *, p_partkey % 20 AS k FROM {part})"""
query("suffix_detect", SPREAD, "part", _measured, f"SELECT {ROOT_P} AS j2s_part_id, 'b' || (p_partkey % 20) AS name, CAST(p_size AS BIGINT) AS value, CAST(p_size * 2 AS BIGINT) AS c_100g, p_brand AS unit FROM part", wide_threshold=3)

SPARSE = """SELECT CAST(event_id AS STRING) doc_id, concat('{"id":', event_id, ',"type":"', event_type, '","p":', props, IF(event_id % 2 = 0, concat(',"half":"h', event_id, '"'), ''),
  IF(event_id % 4 = 0, concat(',"quarter":"q', event_id, '"'), ''), IF(event_id = 7, ',"rare":"r"', ''), IF(event_id = 8, ',"rarer":"r"', ''), '}') t FROM {events}"""
_split = {"wide_threshold": 3, "stable_threshold": 0.8, "rare_threshold": 0.1}
query("auto_split_main", SPARSE, "events", lambda l: l["events"].select("j2s_id", long("id"), "type"),
      f"SELECT {uuid("'events:' || event_id")} AS j2s_id, event_id AS id, event_type AS type FROM events", **_split)
query("auto_split_wide", SPARSE, "events", lambda l: l["events_wide"].select("j2s_events_id", "key", "value"),
      f"SELECT {uuid("'events:' || event_id")} AS j2s_events_id, 'half' AS key, 'h' || event_id AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT {uuid("'events:' || event_id")}, 'quarter', 'q' || event_id FROM events WHERE event_id % 4 = 0", **_split)

LANGS = """SELECT CAST(n_nationkey AS STRING) doc_id, to_json(named_struct('id', n_nationkey, 'tr', named_struct('en', named_struct('label', n_name), 'fr', named_struct('label', lower(n_name)), 'de', named_struct('label', concat('d', n_name))))) t FROM {nation}"""
ROOT_N = uuid("'nation:' || n_nationkey")
query("keyed_pivot_lang", LANGS, "nation", lambda l: l["nation_tr"].select("j2s_nation_id", "lang_code", "label", F.get_json_object("j2s_data", "$.label").alias("again")),
      f"SELECT {ROOT_N} AS j2s_nation_id, k AS lang_code, v AS label, v AS again FROM (SELECT n_nationkey, 'en' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'fr', lower(n_name) FROM nation UNION ALL SELECT n_nationkey, 'de', 'd' || n_name FROM nation)")
TURNS = """SELECT CAST(conv_id AS STRING) doc_id, to_json(named_struct('id', conv_id, 'turns', map_from_entries(collect_list(struct(CAST(turn AS STRING), named_struct('role', role, 'text', text)))))) t
  FROM (SELECT conv_id, turn, min_by(role, struct(role, text)) role, min_by(text, struct(role, text)) text FROM {conversations} GROUP BY conv_id, turn) GROUP BY conv_id"""
TURN_ROWS = "(SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS rn FROM conversations) WHERE rn = 1)"
query("keyed_pivot_numeric", TURNS, "conv", lambda l: l["conv_turns"].select("j2s_conv_id", "key_id", "role", "text"),
      f"SELECT {uuid("'conv:' || conv_id")} AS j2s_conv_id, CAST(turn AS VARCHAR) AS key_id, role, text FROM {TURN_ROWS}")
query("normalize_dynamic", TURNS, "conv", lambda l: l["conv_turns"].select("j2s_conv_id", "turn", "role"),
      f"SELECT {uuid("'conv:' || conv_id")} AS j2s_conv_id, CAST(turn AS VARCHAR) AS turn, role FROM {TURN_ROWS}", lambda c: O.normalize(c, "conv_turns", "turn"), sibling_threshold=0)
LINES = """SELECT CAST(o_orderkey AS STRING) doc_id, to_json(named_struct('id', o_orderkey, 'g', map_from_entries(collect_list(struct(concat('line_', l_linenumber), items))))) t
  FROM {orders} JOIN (SELECT l_orderkey, l_linenumber, transform(sort_array(collect_list(struct(l_partkey, l_quantity, l_extendedprice))), x -> named_struct('partkey', x.l_partkey)) items FROM {lineitem} GROUP BY l_orderkey, l_linenumber)
  ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
query("keyed_pivot_array", LINES, "orders", lambda l: l["orders_g"].select("j2s_orders_id", "key", "j2s_order", long("partkey")),
      f"SELECT {ROOT_O} AS j2s_orders_id, 'line_' || l_linenumber AS key, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice) - 1 AS j2s_order, l_partkey AS partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")

IMAGES = """SELECT CAST(p_partkey AS STRING) doc_id, concat('{"id":', p_partkey, ',"im":{"1":{"up":"', p_brand, '"},"2":{"up":"', p_type, '"},"3":{"up":"', p_name, '"},"front":{"rev":', p_size, '},"back":{"rev":', p_size + 1, '},"side":{"rev":', p_size + 2, '}}}') t FROM {part}"""
IM = uuid(ROOT_P + " || '/im'")
query("multi_keyed_num", IMAGES, "part", lambda l: l["part_im_num"].select("j2s_part_im_id", "key_id", "up"),
      f"SELECT {IM} AS j2s_part_im_id, '1' AS key_id, p_brand AS up FROM part UNION ALL SELECT {IM}, '2', p_type FROM part UNION ALL SELECT {IM}, '3', p_name FROM part")
query("multi_keyed_key", IMAGES, "part", lambda l: l["part_im_key"].select("j2s_part_im_id", "key", long("rev")),
      f"SELECT {IM} AS j2s_part_im_id, 'front' AS key, CAST(p_size AS BIGINT) AS rev FROM part UNION ALL SELECT {IM}, 'back', p_size + 1 FROM part UNION ALL SELECT {IM}, 'side', p_size + 2 FROM part")
query("multi_routing", IMAGES, "part", lambda l: l["part_im"].select("j2s_id", "j2s_part_id"), f"SELECT {IM} AS j2s_id, {ROOT_P} AS j2s_part_id FROM part")
UNIFIED = """SELECT CAST(p_partkey AS STRING) doc_id, concat('{"id":', p_partkey, ',"im":{"1":{"up":"', p_brand, '"},"2":{"up":"', p_type, '"},"front":{"up":"', p_name, '"}}}') t FROM {part}"""
query("unified_fallback", UNIFIED, "part", lambda l: l["part_im"].select("j2s_part_id", "key", "up"),
      f"SELECT {ROOT_P} AS j2s_part_id, '1' AS key, p_brand AS up FROM part UNION ALL SELECT {ROOT_P}, '2', p_type FROM part UNION ALL SELECT {ROOT_P}, 'front', p_name FROM part")
query("group_merge", UNIFIED, "part", lambda l: l["pics"].select("key_id", "up"),
      "SELECT '1' AS key_id, p_brand AS up FROM part UNION ALL SELECT 'front', p_name FROM part",
      lambda c: O.apply_toml(c, '[group.pics]\nstrategy = "keyed_pivot"\nmembers = ["part_im_c_1", "part_im_front"]'), sibling_threshold=0)

# ---- coercion

DIRTY = """SELECT CAST(event_id AS STRING) doc_id, concat('{"id":', event_id, ',"x":', CASE event_id % 12 WHEN 0 THEN '5.0' WHEN 1 THEN '9.5' WHEN 2 THEN '" +7 "' WHEN 3 THEN 'true' WHEN 4 THEN '"Yes"' WHEN 5 THEN '"off"'
  WHEN 6 THEN 'null' WHEN 7 THEN '3000000000' WHEN 8 THEN '"NaN"' WHEN 9 THEN '"1e3"' WHEN 10 THEN '0' ELSE '"2024-02-03"' END, '}') t FROM {events}"""


def coerced(name: str, kind: str, cast: str, cases: str, alias: str = "x") -> None:
    query(name, DIRTY, "events", lambda l: l["events"].select(long("id"), F.col("x").cast(cast).alias(alias)), f"SELECT event_id AS id, CAST(CASE event_id % 12 {cases} END AS {'VARCHAR' if cast == 'string' else cast}) AS {alias} FROM events", lambda c: O.set_type(c, "events", "x", kind))


coerced("coerce_int", "INTEGER", "bigint", "WHEN 0 THEN 5 WHEN 2 THEN 7 WHEN 10 THEN 0")
coerced("coerce_bigint", "BIGINT", "bigint", "WHEN 0 THEN 5 WHEN 2 THEN 7 WHEN 7 THEN 3000000000 WHEN 10 THEN 0")
coerced("coerce_double", "DOUBLE PRECISION", "double", "WHEN 0 THEN 5 WHEN 1 THEN 9.5 WHEN 2 THEN 7 WHEN 7 THEN 3000000000 WHEN 9 THEN 1000 WHEN 10 THEN 0")
coerced("coerce_bool", "BOOLEAN", "boolean", "WHEN 3 THEN true WHEN 4 THEN true WHEN 5 THEN false WHEN 10 THEN false")
coerced("coerce_date", "DATE", "string", "WHEN 11 THEN '2024-02-03'")
coerced("coerce_text", "TEXT", "string", "WHEN 0 THEN '5' WHEN 1 THEN '9.5' WHEN 2 THEN ' +7 ' WHEN 3 THEN 'true' WHEN 4 THEN 'Yes' WHEN 5 THEN 'off' WHEN 7 THEN '3000000000' WHEN 8 THEN 'NaN' WHEN 9 THEN '1e3' WHEN 10 THEN '0' WHEN 11 THEN '2024-02-03'")
coerced("varchar_overflow", "VARCHAR(4)", "string", "WHEN 0 THEN '5' WHEN 1 THEN '9.5' WHEN 2 THEN ' +7 ' WHEN 3 THEN 'true' WHEN 4 THEN 'Yes' WHEN 5 THEN 'off' WHEN 8 THEN 'NaN' WHEN 9 THEN '1e3' WHEN 10 THEN '0'")

TIMES = """SELECT CAST(event_id AS STRING) doc_id, concat('{"id":', event_id, ',"at":"', CASE WHEN event_id % 3 = 0 THEN '2024-13-01T00:00:00' ELSE date_format(CAST(ts AS TIMESTAMP_NTZ), "yyyy-MM-dd'T'HH:mm:ss'Z'") END, '"}') t FROM {events}"""
query("coerce_ts", TIMES, "events", lambda l: l["events"].select(long("id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at")),
      "SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events")
ARRAYS = """SELECT CAST(event_id AS STRING) doc_id, concat('{"id":', event_id, ',"xs":[', event_id, IF(event_id % 3 = 0, ',"7"', ',null'), ',4]}') t FROM {events}"""
query("coerce_array", ARRAYS, "events", lambda l: l["events"].select(long("id"), F.to_json(F.col("xs").cast("array<string>")).alias("xs")),
      "SELECT event_id AS id, '[\"' || event_id || CASE WHEN event_id % 3 = 0 THEN '\",\"7\"' ELSE '\",null' END || ',\"4\"]' AS xs FROM events", array_columns=True)

# ---- anomalies

_int = lambda c: O.set_type(c, "events", "x", "INTEGER")
WHY = "CASE event_id % 12 WHEN 1 THEN 'number_out_of_range' WHEN 7 THEN 'number_out_of_range' WHEN 3 THEN 'boolean' WHEN 4 THEN 'string' WHEN 5 THEN 'string' WHEN 8 THEN 'string' WHEN 9 THEN 'string' WHEN 11 THEN 'string' END"
VALUE = "CASE event_id % 12 WHEN 1 THEN '9.5' WHEN 7 THEN '3000000000' WHEN 3 THEN 'true' WHEN 4 THEN 'Yes' WHEN 5 THEN 'off' WHEN 8 THEN 'NaN' WHEN 9 THEN '1e3' WHEN 11 THEN '2024-02-03' END"
BAD = f"(SELECT event_id, {WHY} AS why, {VALUE} AS value FROM events) WHERE why IS NOT NULL"
query("anomalies_detail", DIRTY, "events", lambda l: l.anomalies().select("table", "column", "row_id", "expected_type", "actual_value", "actual_type"),
      f"SELECT 'events' AS \"table\", 'x' AS \"column\", {uuid("'events:' || event_id")} AS row_id, 'INTEGER' AS expected_type, value AS actual_value, why AS actual_type FROM {BAD}", _int)
query("anomaly_summary", DIRTY, "events", lambda l: l.summary().select("table", "column", "expected_type", "count", "total", F.size("examples").cast("long").alias("examples")),
      f"SELECT 'events' AS \"table\", 'x' AS \"column\", 'INTEGER' AS expected_type, count(*) AS count, (SELECT count(*) FROM events) AS total, CAST(5 AS BIGINT) AS examples FROM {BAD}", _int)
query("anomaly_rate", DIRTY, "events", lambda l: l.summary().agg(F.sum("count").alias("bad"), F.sum("total").alias("total"), F.round(F.sum("count") / F.sum("total"), 9).alias("rate")),
      f"SELECT CAST(count(*) AS BIGINT) AS bad, (SELECT count(*) FROM events) AS total, round(count(*) / (SELECT count(*) FROM events), 9) AS rate FROM {BAD}", _int)
query("anomaly_top10", DIRTY, "events", lambda l: A.top_tables(l.anomalies()), f"SELECT 'events' AS \"table\", count(*) AS count FROM {BAD}", _int)

# ---- inference and metadata

ORDER_DOCS = """SELECT CAST(o_orderkey AS STRING) doc_id, to_json(named_struct('orderkey', o_orderkey, 'custkey', o_custkey, 'status', o_orderstatus, 'total', o_totalprice, 'day', date_format(o_orderdate, 'yyyy-MM-dd'))) t FROM {orders}"""


def _types(l: engine.Load) -> DataFrame:
    rows = [(c.name, str(c.type) if c.type.name != "varchar" else "VARCHAR") for t in l.catalog for c in t.data]
    return l.shredder.records.sparkSession.createDataFrame(rows, "name string, type string")


query("infer_types", ORDER_DOCS, "orders", _types, "SELECT * FROM (VALUES ('custkey', 'INTEGER'), ('day', 'DATE'), ('orderkey', 'INTEGER'), ('status', 'VARCHAR'), ('total', 'DOUBLE PRECISION')) v(name, type)")


def infer_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.mixed_columns(I.infer(records(spark, sf_dir, DIRTY), "events"))
    return spark.createDataFrame([(k, t, n) for _, k, tags in found for t, n in tags.items()], "column string, tag string, n long")


QUERIES["infer_mixed"] = infer_mixed
ORACLE_SQL["infer_mixed"] = """SELECT 'x' AS "column", tag, count(*) AS n FROM (SELECT CASE event_id % 12 WHEN 0 THEN 'integer' WHEN 10 THEN 'integer' WHEN 1 THEN 'float' WHEN 3 THEN 'boolean' WHEN 7 THEN 'bigint' WHEN 11 THEN 'date' WHEN 6 THEN NULL ELSE 'varchar' END AS tag FROM events) WHERE tag IS NOT NULL GROUP BY tag"""
query("stats_report", DIRTY, "events", lambda l: stats.frame(l.shredder.records.sparkSession, l.catalog).select("table", "column", "total", "nulls", "dominant", "mixed"),
      "SELECT 'events' AS \"table\", 'id' AS \"column\", count(*) AS total, CAST(0 AS BIGINT) AS nulls, 'integer' AS dominant, false AS mixed FROM events UNION ALL SELECT 'events', 'x', count(*), count(*) FILTER (event_id % 12 = 6), 'varchar', true FROM events")
query("not_null_flags", DIRTY, "events", lambda l: l.shredder.records.sparkSession.createDataFrame([(c.name, c.not_null) for c in l.catalog["events"].data], "name string, not_null boolean"),
      "SELECT * FROM (VALUES ('id', true), ('x', false)) v(name, not_null)")
query("type_override", ORDER_DOCS, "orders", lambda l: l["orders"].select("orderkey", "total"), "SELECT CAST(o_orderkey AS VARCHAR) AS orderkey, o_totalprice AS total FROM orders", lambda c: O.apply_toml(c, '[orders]\norderkey = "TEXT"'))


def _roundtrip(c: C.Catalog) -> C.Catalog:
    return C.from_snapshot(json.loads(json.dumps(C.to_snapshot(c))))


query("schema_snapshot_roundtrip", ORDERS, "orders", lambda l: l["orders_items"].select("j2s_orders_id", long("partkey")), f"SELECT {ROOT_O} AS j2s_orders_id, l_partkey AS partkey FROM {ITEMS}", _roundtrip)


def inspect_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, samples, mixed = engine.inspect(records(spark, sf_dir, EVENTS), 500, Options(root="events"))
    return spark.createDataFrame([(len(samples), len(catalog.tables), mixed)], "samples long, tables long, mixed long").select("samples", "tables")


QUERIES["inspect_limit"] = inspect_limit
ORACLE_SQL["inspect_limit"] = "SELECT CAST(500 AS BIGINT) AS samples, CAST(2 AS BIGINT) AS tables"


def key_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"digits": [str(i) for i in range(9)] + ["x1"], "lang": ["en", "fr", "deu"], "mix": ["1", "two", "en"], "places": ["1", "front"], "slug": ["front_en", "back"]}
    return spark.createDataFrame([(k, siblings.key_shape(v)) for k, v in groups.items()], "keys string, shape string")


QUERIES["key_shape"] = key_shape
ORACLE_SQL["key_shape"] = "SELECT * FROM (VALUES ('digits', 'numeric'), ('lang', 'iso_lang'), ('mix', 'mixed'), ('places', 'slug'), ('slug', 'slug')) v(keys, shape)"


def jaccard_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = {"alike": [{"a", "b"}] * 3, "half": [{"a", "b"}, {"b", "a", "c", "d"}, {"a", "b", "c", "d"}], "pure": [set(), set()], "one_empty": [{"a"}, set()]}
    return spark.createDataFrame([(k, siblings.jaccard_min(v)) for k, v in cases.items()], "sets string, least double")


QUERIES["jaccard_min"] = jaccard_min
ORACLE_SQL["jaccard_min"] = "SELECT sets, CAST(least AS DOUBLE) AS least FROM (VALUES ('alike', 1.0), ('half', 0.5), ('pure', 1.0), ('one_empty', 0.0)) v(sets, least)"


def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [r[0] for r in frames(spark, sf_dir, "SELECT DISTINCT p_name || ' ' || p_brand AS k FROM {part}").collect()]
    return spark.createDataFrame([(k, naming.sanitize(k)) for k in keys], "key string, name string")


QUERIES["sanitize_names"] = sanitize_names
ORACLE_SQL["sanitize_names"] = "SELECT DISTINCT p_name || ' ' || p_brand AS key, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part"


def column_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, _ = naming.column_names(["a-b", "a_b", "c", ""])
    return spark.createDataFrame(sorted(names.items()), "key string, name string")


QUERIES["column_collisions"] = column_collisions
# the hash: 64-bit FNV-1a over the key's bytes, its last 28 bits in hex
ORACLE_SQL["column_collisions"] = """
WITH k(key, s) AS (VALUES ('a-b', 'a_b'), ('a_b', 'a_b'), ('c', 'c'), ('', 'col')),
h AS (SELECT key, s, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i, 1))::UHUGEINT)),
  lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM k)
SELECT key, CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN s || '_' || lpad(lower(to_hex((h % 268435456::UHUGEINT)::BIGINT)), 7, '0') ELSE s END AS name FROM h
"""
query("guard_overflow", PARTS.replace("named_struct('id', p_partkey, 'attrs', ", "named_struct('id', p_partkey, 'brand', p_brand, 'type', p_type, 'attrs', "), "part", lambda l: l["part"].select("j2s_id", F.get_json_object("data", "$.brand").alias("brand")),
      f"SELECT {ROOT_P} AS j2s_id, p_brand AS brand FROM part", max_columns=3)


def _ddl(l: engine.Load) -> DataFrame:
    lines = [x for x in ddl.script(l.catalog).splitlines() if x.strip()]
    return l.shredder.records.sparkSession.createDataFrame(list(enumerate(lines)), "n int, line string")


def _table(name: str, columns: list[str]) -> list[str]:
    return [f'CREATE TABLE IF NOT EXISTS "public"."{name}" (', *(f"  {c}," for c in columns), f'  CONSTRAINT "pk_{name}" PRIMARY KEY ("j2s_id")', ");"]


def _reference(name: str, parent: str) -> list[str]:
    alter = f'ALTER TABLE "public"."{name}" ADD CONSTRAINT "fk_{name}_parent" FOREIGN KEY ("j2s_{parent}_id") REFERENCES "public"."{parent}" ("j2s_id")'
    return ["DO $$ BEGIN", f"  {alter};", "EXCEPTION WHEN duplicate_object THEN NULL;", "END $$;"]


def _values(lines: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(lines)) + ") v(n, line)"


BELOW = ['"j2s_id" UUID NOT NULL', '"j2s_orders_id" UUID NOT NULL', '"j2s_order" BIGINT NOT NULL']
query("ddl_text", ORDERS, "orders", _ddl, _values([
    *_table("orders", [BELOW[0], '"orderkey" INTEGER', '"status" VARCHAR(2)']),
    *_table("orders_items", [*BELOW, '"partkey" INTEGER', '"price" DOUBLE PRECISION']),
    *_table("orders_partkeys", [*BELOW, '"value" INTEGER']),
    *_reference("orders_items", "orders"), *_reference("orders_partkeys", "orders")]))

NOISY = """SELECT CAST(event_id AS STRING) doc_id, concat('{"id":', event_id, ',"img_ocr_1":"x","img_ocr_22_result":{"a":1},"my_debug_tags":["d"],"nutriments":{"fat":', event_id, '},"images":{"uploaded":{"1":1}', IF(event_id % 2 = 0, ',"front":2', ''), '}}') t FROM {events}"""


def preprocess_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = kept(clean.records(R.spread(frames(spark, sf_dir, NOISY)), "t", "doc_id"))
    l = engine.load(r, engine.infer(r, Options(root="events")))
    e, i = l["events"], l["events_images"]
    keys = ",".join(c.name for t in l.catalog for c in t.data)
    return e.join(i, e["j2s_id"] == i["j2s_events_id"], "left").select(long("id"), "nutriments", long("front"), F.lit(keys).alias("keys"))


QUERIES["preprocess_clean"] = preprocess_clean
ORACLE_SQL["preprocess_clean"] = "SELECT event_id AS id, '{\"fat\":' || event_id || '}' AS nutriments, CAST(CASE WHEN event_id % 2 = 0 THEN 2 END AS BIGINT) AS front, 'id,nutriments,front' AS keys FROM events"


def value_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of values as an expression alone."""
    from .functions.tags import raw_tag

    v = F.try_variant_get("v", "$.x", "variant")
    r = records(spark, sf_dir, DIRTY).select(v.alias("x")).withColumn("raw", raw_tag(F.col("x")))
    return r.groupBy(value_tag(F.col("x"), F.col("raw")).alias("tag")).agg(F.count("*").alias("n"))


QUERIES["value_tags"] = value_tags
ORACLE_SQL["value_tags"] = "SELECT CASE event_id % 12 WHEN 0 THEN 'integer' WHEN 10 THEN 'integer' WHEN 1 THEN 'float' WHEN 3 THEN 'boolean' WHEN 7 THEN 'bigint' WHEN 11 THEN 'date' WHEN 6 THEN 'null' ELSE 'varchar' END AS tag, count(*) AS n FROM events GROUP BY 1"


def shared(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors meet; one of this machine's only if there is no other machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp()}"
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def array_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array document as a source, its elements in order."""
    rows = frames(spark, sf_dir, "SELECT concat('[', array_join(transform(sort_array(collect_list(struct(n_nationkey, n_name))), x -> to_json(x)), ','), ']') a FROM {nation}")
    R.prepare(spark)
    each = rows.select(F.parse_json("a").alias("a")).lateralJoin(spark.tvf.variant_explode(F.col("a").outer()))
    r = R.checked(each.select(F.col("pos").cast("string").alias("doc_id"), F.col("value").alias("v")))
    l = engine.load(r, engine.infer(r, Options(root="nation")))
    return l["nation"].select(long("n_nationkey"), "n_name")


QUERIES["array_document"] = array_document
ORACLE_SQL["array_document"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"


def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed catalogue over a stream, read once to its end; the table it wrote."""
    from .streaming import load as S

    base = shared(spark, "stream")
    frames(spark, sf_dir, EVENTS).select(F.col("t").alias("value")).write.text(f"{base}/in")
    c = engine.infer(records(spark, sf_dir, EVENTS), Options(root="events"))
    S.start(S.records(spark, f"{base}/in"), c, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out/events").select(long("id"), "type", F.col("value").cast("double"))


QUERIES["stream_load"] = stream_load
ORACLE_SQL["stream_load"] = "SELECT event_id AS id, event_type AS type, value FROM events"


# ---- files in, files out


def source_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in several files; ids are the lines' numbers, whichever way the files are split."""
    path = shared(spark, "lines")
    R.spread(frames(spark, sf_dir, EVENTS)).select(F.concat("t", F.lit("\n")).alias("value")).write.text(path)  # every second line is blank
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        a = kept(R.read(spark, path))
        l = engine.load(a, engine.infer(a, Options(root="events")))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
        b = R.read(spark, path).select("doc_id").distinct()
        same = a.join(b, "doc_id", "left_semi").count() == a.count() == b.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return l["events"].select(long("id"), "type", F.col("value").cast("double"), F.lit(same).alias("same_ids"))


QUERIES["source_ndjson"] = source_ndjson
ORACLE_SQL["source_ndjson"] = "SELECT event_id AS id, event_type AS type, value, true AS same_ids FROM events"


def source_array(large: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A JSON array in a file, as one value or split item by item."""
        path = shared(spark, "array")
        sql = "SELECT concat('[', array_join(transform(sort_array(collect_list(struct(n_nationkey, n_name))), x -> to_json(x)), ',\\n  '), ']') a FROM {nation}"
        frames(spark, sf_dir, sql).write.text(path)
        r = kept(R.read_large_array(spark, path) if large else R.read(spark, path))
        l = engine.load(r, engine.infer(r, Options(root="nation")))
        return l["nation"].select(long("n_nationkey"), "n_name")

    return run


for _name, _large in (("source_array", False), ("source_large_array", True)):
    QUERIES[_name] = source_array(_large)
    ORACLE_SQL[_name] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"


def _written(l: engine.Load) -> DataFrame:
    spark = l.shredder.records.sparkSession
    out = shared(spark, "tables")
    write.write_tables(l.tables(), l.catalog, out)
    return spark.read.parquet(f"{out}/part_attrs").select("j2s_part_id", long("size"), F.col("price").cast("double"))


query("sink_parquet", PARTS, "part", _written, f"SELECT {ROOT_P} AS j2s_part_id, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part")
COPIED = """SELECT CAST(p_partkey AS STRING) doc_id, to_json(named_struct('a', p_partkey, 'b', concat(p_brand, '\\t', p_type, '\\n\\\\'), 'c', IF(p_size % 2 = 0, p_size, NULL))) t FROM {part}"""
query("copy_text", COPIED, "part", lambda l: write.copy_text(l["part"].select("a", "b", "c")),
      r"""SELECT p_partkey || chr(9) || p_brand || '\t' || p_type || '\n\\' || chr(9) || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '\N' END AS value FROM part""")


def _anomaly_files(l: engine.Load) -> DataFrame:
    spark = l.shredder.records.sparkSession
    out = shared(spark, "anomalies")
    A.write_by_table(l.anomalies(), out)
    return spark.read.schema("`column` string, row_id string, actual_value string, actual_type string").json(f"{out}/table=events").select("column", "row_id", "actual_value", "actual_type")


query("anomaly_files", DIRTY, "events", _anomaly_files,
      f"SELECT 'x' AS \"column\", {uuid("'events:' || event_id")} AS row_id, value AS actual_value, why AS actual_type FROM {BAD}", _int)
IDS = """SELECT CAST(event_id AS STRING) doc_id, concat('{"id":', event_id, ',"u":"', concat_ws('-', substr(md5(CAST(event_id AS STRING)), 1, 8), substr(md5(CAST(event_id AS STRING)), 9, 4), substr(md5(CAST(event_id AS STRING)), 13, 4),
  substr(md5(CAST(event_id AS STRING)), 17, 4), substr(md5(CAST(event_id AS STRING)), 21, 12)), '","at":"', date_format(CAST(ts AS TIMESTAMP_NTZ), "yyyy-MM-dd HH:mm:ss"), '"}') t FROM {events}"""
query("uuid_and_timestamp", IDS, "events", lambda l: l["events"].select(long("id"), "u", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.lit(",".join(str(c.type) for c in l.catalog["events"].data)).alias("types")),
      f"SELECT event_id AS id, {uuid('CAST(event_id AS VARCHAR)')} AS u, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'TIMESTAMP,INTEGER,UUID' AS types FROM events")
WIDE = """SELECT CAST(p_partkey AS STRING) doc_id, concat('{"id":', p_partkey, ',"n":{"a', p_partkey % 7, '":', p_size, ',"b', p_partkey % 5, '":', p_partkey, '},"m":{"c', p_partkey % 7, '":"', p_brand, '","d', p_partkey % 5, '":', p_size, '}}') t FROM {part}"""
query("pivot_or_json", WIDE, "part", lambda l: l.shredder.records.sparkSession.createDataFrame([(t.name, t.layout) for t in l.catalog], "name string, layout string"),
      "SELECT * FROM (VALUES ('part', 'columns'), ('part_n', 'pivot'), ('part_m', 'jsonb')) v(name, layout)", wide_threshold=4, stable_threshold=0.5)
