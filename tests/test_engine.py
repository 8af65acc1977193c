"""Small record sets through inference, layouts, overrides and load."""

import json
from dataclasses import replace

import pytest

from shredwell import engine
from shredwell.operators import anomalies as A
from shredwell.operators import stats
from shredwell.options import Options
from shredwell.plans import infer as I
from shredwell.plans import overrides as O
from shredwell.sinks import ddl, write
from shredwell.sources import records as R


def records(spark, docs):
    rows = [(str(i), d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    return R.from_strings(spark.createDataFrame(rows, "doc_id string, t string"), "t", "doc_id")


def loaded(spark, docs, o=None, change=None):
    r = records(spark, docs)
    c = engine.infer(r, o or Options())
    return engine.load(r, change(c) if change else c)


def rows(l, name, *cols, order=None):
    df = l[name]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


USERS = [
    {"id": 1, "name": "Alice", "address": {"city": "Paris"}, "tags": ["a", "b"], "orders": [{"n": 1, "items": [{"p": "x"}, {"p": "y"}]}]},
    {"id": 2, "name": "Bob", "address": {"city": "Rome"}, "tags": ["c"], "orders": [{"n": 2, "items": [{"p": "z"}]}, {"n": 3, "items": []}]},
    {"id": 3, "name": "Eve", "address": {"city": "Oslo"}, "tags": ["d", "e", "f"], "orders": []},
]


def test_nested_tables(spark):
    l = loaded(spark, USERS, Options(root="users"))
    assert l.catalog.names() == ["users", "users_address", "users_orders", "users_tags", "users_orders_items"]
    counts = {r["table"]: r["total"] for r in l.row_counts().collect()}
    assert counts == {"users": 3, "users_address": 3, "users_tags": 6, "users_orders": 3, "users_orders_items": 3}
    assert l.anomalies().count() == 0
    assert [c.name for c in l.catalog["users_orders"].columns] == ["j2s_id", "j2s_users_id", "j2s_order", "n"]
    assert all(write.orphans(l.tables(), l.catalog, n).count() == 0 for n in l.catalog.names() if n != "users")
    assert rows(l, "users_tags", "j2s_order", "value")[:2] == [(0, "a"), (0, "c")]


def test_array_columns(spark):
    l = loaded(spark, USERS, Options(root="users", array_columns=True))
    assert len(l.catalog.names()) == 4
    assert sorted(len(r[0]) for r in l["users"].select("tags").collect()) == [1, 2, 3]


def test_types_and_nulls(spark):
    docs = [{"i": 1, "b": 5_000_000_000, "f": 1.5, "o": True, "u": "123e4567-e89b-12d3-a456-426614174000", "d": "2024-01-02", "t": "2024-01-02T03:04:05Z", "s": "x", "n": None, "z": 1.0}, {"i": None, "z": 1e2}]
    c = engine.infer(records(spark, docs), Options())
    got = {x.name: str(x.type) for x in c["root"].data}
    assert got == {"i": "INTEGER", "b": "BIGINT", "f": "DOUBLE PRECISION", "o": "BOOLEAN", "u": "UUID", "d": "DATE", "t": "TIMESTAMP", "s": "VARCHAR(2)", "n": "TEXT", "z": "INTEGER"}
    assert not c["root"].column("i").not_null and c["root"].column("b").not_null
    l = loaded(spark, [{"tag": "a"}, {"tag": None}, {}, {"tag": "null"}])
    assert rows(l, "root", "tag") == [("a",), ("null",), (None,), (None,)]


def test_widest_tag_wins_and_anomalies(spark):
    l = loaded(spark, [{"a": 1, "b": "x" * 3}, {"a": True, "b": "y"}, {"a": 2.5}, {"a": {"k": 1}}, {"a": [1]}])
    assert str(l.catalog["root"].column("a").type) == "DOUBLE PRECISION"
    found = l.anomalies().collect()
    assert [(r["column"], r["actual_type"], r["actual_value"]) for r in found] == [("a", "boolean", "true")]
    s = A.ordered(l.summary())
    assert (s[0]["count"], s[0]["total"], s[0]["rate"], len(s[0]["examples"])) == (1, 5, 0.2, 1)
    assert json.loads(A.report(l.summary()))[0]["count"] == 1
    assert A.report(l.summary(), "csv").splitlines()[1].startswith("root,a,DOUBLE PRECISION,1,5,20.0000,")
    with pytest.raises(A.TooManyAnomalies):
        A.check_rate(1, 5, 0.1)
    A.check_rate(1, 5, 0.2)


def test_override_types_give_anomalies(spark):
    docs = [{"name": "a", "score": 9.5}, {"name": "b", "score": 7.25}, {"name": "c", "score": 8}]
    l = loaded(spark, docs, Options(root="people"), lambda c: O.apply_toml(c, '[people]\nscore = "INTEGER"\nnothing = "TEXT"\n[ghost]\ncol = "TEXT"'))
    assert rows(l, "people", "score") == [(8,), (None,), (None,)]
    assert len(l.catalog.warnings) == 2
    assert {r["actual_type"] for r in l.anomalies().collect()} == {"number_out_of_range"}
    l = loaded(spark, docs, Options(root="people"), lambda c: O.apply_toml(c, '[people]\nscore = "TEXT"'))
    assert rows(l, "people", "score") == [("7.25",), ("8",), ("9.5",)]


NUTRIENTS = [{"id": 1, "n": {"fat": 1, "carbs": 2}}, {"id": 2, "n": {"fat": 3, "protein": None}}, {"id": 3}]


def test_pivot_and_jsonb(spark):
    l = loaded(spark, NUTRIENTS, None, lambda c: O.set_layout(c, "root_n", "pivot"))
    assert rows(l, "root_n", "key", "value") == [("carbs", 2), ("fat", 1), ("fat", 3), ("protein", None)] or rows(l, "root_n", "key", "value") == [("carbs", "2"), ("fat", "1"), ("fat", "3"), ("protein", None)]
    l = loaded(spark, NUTRIENTS, None, lambda c: O.set_layout(c, "root_n", "jsonb"))
    assert rows(l, "root_n", "data") == [('{"carbs":2,"fat":1}',), ('{"fat":3,"protein":null}',)]
    l = loaded(spark, NUTRIENTS, None, lambda c: O.set_layout(O.set_layout(c, "root_n", "jsonb"), "root_n", "columns"))
    assert rows(l, "root_n", "fat") == [(1,), (3,)]
    l = loaded(spark, NUTRIENTS, None, lambda c: O.set_layout(c, "root", "jsonb"))
    assert l.catalog.names() == ["root"] and l["root"].count() == 3


def test_flatten(spark):
    docs = [{"id": 1, "dims": {"w": 1, "h": 2}}, {"id": 2, "dims": {"w": 3}}]
    l = loaded(spark, docs, None, lambda c: O.flatten(c, "root_dims", "dims_"))
    assert l.catalog.names() == ["root"] and rows(l, "root", "id", "dims_w", "dims_h") == [(1, 1, 2), (2, 3, None)]
    l = loaded(spark, docs, None, lambda c: O.jsonb_flatten(c, "root_dims"))
    assert rows(l, "root", "root_dims") == [('{"h":2,"w":1}',), ('{"w":3}',)]
    with pytest.raises(O.OverrideError):
        O.flatten(l.catalog, "root")


def test_structured_pivot(spark):
    docs = [{"m": {"cal": 1, "cal_100g": 2, "cal_serving": 3, "fat_100g": 4, "fat_serving": 5}}]
    l = loaded(spark, docs, None, lambda c: O.structured_pivot(c, "root_m", ["_100g", "serving"]))
    assert [c.name for c in l.catalog["root_m"].data] == ["name", "value", "c_100g", "serving"]
    assert rows(l, "root_m", "name", "value", "c_100g", "serving") == [("cal", 1, 2, 3), ("fat", None, 4, 5)]
    l = loaded(spark, docs, replace(Options(), wide_threshold=3))
    assert l.catalog["root_m"].layout == "structured_pivot"


def test_auto_split(spark):
    docs = [{"id": i, "name": f"n{i}", "d": {"c": 1}, **({"ta": "x"} if i < 3 else {}), **({"tb": "y"} if i in (2, 3, 4) else {}), **({"rare": "z"} if i == 0 else {})} for i in range(5)]
    l = loaded(spark, docs, Options(root="p", wide_threshold=3, stable_threshold=0.8, rare_threshold=0.3))
    assert l.catalog.names() == ["p", "p_d", "p_wide"]
    assert [c.name for c in l.catalog["p"].data] == ["id", "name"]
    assert rows(l, "p_wide", "key", "value") == [("ta", "x")] * 3 + [("tb", "y")] * 3


def test_keyed_pivot(spark):
    tr = lambda: {k: {"desc": k, "label": "l"} for k in ("de", "en", "fr")}
    l = loaded(spark, [{"id": 1, "t": tr()}, {"id": 2, "t": tr()}])
    t = l.catalog["root_t"]
    assert t.layout == "keyed_pivot" and [c.name for c in t.columns] == ["j2s_id", "j2s_root_id", "lang_code", "desc", "label", "j2s_data"]
    assert rows(l, "root_t", "lang_code", "desc") == [("de", "de")] * 2 + [("en", "en")] * 2 + [("fr", "fr")] * 2
    arr = [{"g": {f"gcf_{k}": [{"s": 1, "t": 2}, {"s": 3, "t": 4}] for k in "abc"}}]
    l = loaded(spark, arr)
    assert rows(l, "root_g", "key", "j2s_order", "s")[:2] == [("gcf_a", 0, 1), ("gcf_a", 1, 3)]
    pure = [{"g": {f"key_{k}": {"in": {"c": True}} for k in "abc"}}]
    assert rows(loaded(spark, pure), "root_g", "key", "j2s_data")[0] == ("key_a", '{"in":{"c":true}}')


def test_multi_keyed_pivot(spark):
    docs = [{"id": 1, "im": {**{str(k): {"imgid": k, "up": "u"} for k in range(3)}, **{f"front_{k}": {"rev": k, "ang": 0} for k in "abc"}}}]
    l = loaded(spark, docs)
    assert l.catalog.names() == ["root", "root_im", "root_im_num", "root_im_key"]
    assert rows(l, "root_im_num", "key_id", "imgid") == [("0", 0), ("1", 1), ("2", 2)]
    assert rows(l, "root_im_key", "key", "rev") == [("front_a", "a"), ("front_b", "b"), ("front_c", "c")]
    assert l["root_im"].count() == 1


def test_normalize_group_skip(spark):
    docs = [{"im": {"a1": {"u": "x", "w": 1}}}, {"im": {"a2": {"u": "y"}}}]
    l = loaded(spark, docs, None, lambda c: O.normalize(c, "root_im", "img"))
    assert rows(l, "root_im", "img", "u", "w") == [("a1", "x", 1), ("a2", "y", None)]
    l = loaded(spark, docs, None, lambda c: O.merge_group(c, "both", ["root_im_a1", "root_im_a2"]))
    assert rows(l, "both", "key_id", "u") == [("a1", "x"), ("a2", "y")]
    assert O.skip(engine.infer(records(spark, docs)), "root_im").names() == ["root"]


def test_conflicts_dots_and_strays(spark):
    l = loaded(spark, [{"a.b": {"x": 1}, "m": [{"k": 1}, 7]}, {"m": {"k": 2}}])
    assert rows(l, "root_a_b", "x") == [(1,)]
    assert rows(l, "root_m", "j2s_order", "k") == [(0, 1), (0, 2)]
    assert [r["actual_type"] for r in l.anomalies().collect()] == ["scalar_in_object_array"]


def test_guard_stats_ddl_snapshot(spark, tmp_path):
    r = records(spark, [{f"k{i}": i for i in range(30)}])
    c = engine.infer(r, Options(max_columns=20))
    assert [x.name for x in c["root"].columns] == ["j2s_id", "data"] and c.warnings
    u = records(spark, USERS)
    c = engine.infer(u, Options(root="users"))
    assert I.infer(u, "users") == I.infer(records(spark, USERS[:2]), "users").merge(I.infer(records(spark, USERS[2:]), "users"))
    text = ddl.script(c)
    assert 'CREATE TABLE IF NOT EXISTS "public"."users_orders"' in text and '"fk_users_orders_parent"' in text and "j2s_order\" BIGINT NOT NULL" in text
    assert "FOREIGN KEY" in ddl.preview(c)
    engine.save_snapshot(c, str(tmp_path / "s.json"))
    again = engine.load_snapshot(str(tmp_path / "s.json"))
    assert [t.columns for t in again] == [t.columns for t in c]
    assert engine.load(u, again)["users_orders"].count() == 3
    assert ("users", "id") in {x[:2] for x in stats.rows(c)} and "users (3 rows)" in stats.text(c)


def test_sources_and_run(spark, tmp_path):
    (tmp_path / "users.json").write_text("\n [" + ",".join(json.dumps(u) for u in USERS) + "]")
    (tmp_path / "users.jsonl").write_text("\n".join(json.dumps(u) for u in USERS) + "\n\n")
    for f in ("users.json", "users.jsonl"):
        l, report = engine.run(spark, str(tmp_path / f), str(tmp_path / f"out-{f}"))
        assert spark.read.parquet(str(tmp_path / f"out-{f}" / "users_orders")).count() == 3 and report == []
    engine.run(spark, str(tmp_path / f), str(tmp_path / f"out-{f}"), Options(root="users", drop_existing=True))
    assert spark.read.parquet(str(tmp_path / f"out-{f}" / "users_orders")).count() == 3
    assert R.read_large_array(spark, str(tmp_path / "users.json")).count() == 3
    assert [x for x in R.split_array(b'[{"a":"]}"} {"b":[1]},,{"c":2}')] == [b'{"a":"]}"}', b'{"b":[1]}', b'{"c":2}']
    with pytest.raises(R.SourceError):
        list(R.split_array(b'[{"a":1]'))
    bad = spark.createDataFrame([("0", "[1]")], "doc_id string, t string")
    with pytest.raises(Exception, match="root level"):
        R.from_strings(bad, "t", "doc_id").select("v").collect()
