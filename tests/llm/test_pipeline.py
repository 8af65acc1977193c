"""The stages on small tables with awkward rows."""

import collections

import numpy as np
import pytest

from shredwell.llm import near

from .test_operators import brute_near

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    good = [(i, " ".join(f"word{(i * 31 + k * k * (i + 3)) % 997}." for k in range(1, 60)), "en", f"s{i % 3}", 1) for i in range(120)]
    near = [(500 + i, good[i][1] + " tail", "en", "s0", 1) for i in range(10)]
    copies = [(300 + i, good[i][1], "en", "s1", 1) for i in range(10)] + [(5, good[5][1], "en", "s0", 1)]
    bad = [(1000 + i, "!! $$$ ### %%% " * (5 + i), "en", "s2", 1) for i in range(30)]
    odd = [(None, None, None, None, None), (2000, "", "en", None, 0)]
    spark.createDataFrame(good + near + copies + bad + odd, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in good[::2]] + [(r[0], 0, 0) for r in bad[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda n: collections.Counter(r["doc_id"] for r in out[n].collect())
    q, e, n = ids("quality"), ids("exact_dedup"), ids("near_dedup")
    assert all(i in q for i in range(120)) and not any(i and 1000 <= i < 1030 for i in q)
    assert all(e[i] == (i >= 10) for i in range(120)) and all(e[300 + i] == 1 for i in range(10))
    assert all(n[300 + i] == 1 and n[500 + i] == 0 for i in range(10)) and n[50] == 1
    mixed = out["mixing"].count()
    assert mixed and out["packing"].count() == mixed


def test_near_stage_one_large_group(spark, monkeypatch):
    # a large group of near copies (five-word shingles) branches no more once it hangs together
    rng = np.random.RandomState(4)
    base, rows, made, keep = [f"b{k}" for k in range(80)], [], [], near.stored
    for i in range(240):
        w = list(base)
        for k in rng.choice(80, rng.randint(1, 4), replace=False):
            w[k] = f"x{rng.randint(10**6)}"
        rows.append((i, " ".join(w), "en", "s0", 1))

    def counted(df, name):
        out = keep(df, name)
        if name == "branched":
            made.append(out.count())
        return out

    monkeypatch.setattr(near, "SMALL", 8)
    monkeypatch.setattr(near, "stored", counted)
    got = {r["doc_id"] for r in pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {i for i, (_, c) in brute_near([r[:2] for r in rows], 5).items() if i == c}
    assert made and sum(made) < 2 * 16 * 240


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
