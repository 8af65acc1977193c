"""Each operator against brute force, a round trip or held-out accuracy, and on awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("shredwell.llm")
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shredwell.llm import chat, common, exact, graph, language, media, mixing, near, packing, quality, substring, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, "one", "en", "b", 3),
    (5, "one", "en", "b", 3),
    (5, "one", "en", "b", 3),  # a repeated row
    (6, LONG, "de", None, len(LONG)),
    (7, LONG + " end", "de", "a", len(LONG) + 4),
    (8, f"a b c {PASSAGE} d e f", "en", "c", 1),
    (9, f"g h i {PASSAGE} j k l", "en", "c", 1),
    (None, "no id at all", "en", "c", 1),
    (None, None, None, None, None),
    (10, "12 34 !!", None, "c", 8),
    (11, "Ünïcode 漢字 😀 \u0000 x <|endoftext|> </s>", "fr", "c", 1),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumn("media", F.lit("clash")).withColumn("SCORE", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("length", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media_round_trip(docs, empty):
    got = media.decode(media.encode(docs)).select("doc_id", "thumbnail", "width", "height", "error").collect()
    assert len(got) == len(AWKWARD) and all(r["error"] is None for r in got)
    want = []
    for _, t, *_ in AWKWARD:
        raw = (t or "").encode()
        want.append(raw + b" " * ((-len(raw)) % 192 if raw else 192))
    assert sorted(bytes(r["thumbnail"]) for r in got) == sorted(want)
    assert media.decode(media.encode(empty)).count() == 0


def test_media_foreign_streams(spark):
    rng = np.random.RandomState(1)
    levels = rng.randint(0, 256, (media.MAX_ROWS + 3, 192)).astype(np.uint8)
    (big,) = media.encode_payloads(levels, np.array([len(levels)]))
    assert (media.thumbnails([big])[0][2] == levels).all()
    (small,) = media.encode_payloads(levels[:2], np.array([2]))
    head, at = media.parse(small)
    data, starts, _ = media.split_scan(np.frombuffer(small, np.uint8)[at:])
    assert (media.decode_scalar(head, data, starts) + 128 == levels[:2]).all()
    rows = spark.createDataFrame([(1, None), (2, b""), (3, b"\xff\xd8\xff"), (4, small[:-50])], "id int, media binary")
    assert all(r["error"] and r["thumbnail"] is None for r in media.decode(rows).collect())


def test_media_any_bytes(spark):
    """Changed streams: a value decodes or has an error, alone and among others, and good ones beside it stay good."""
    rng = np.random.RandomState(7)
    levels = rng.randint(0, 256, (40, 192)).astype(np.uint8)
    good = media.encode_payloads(levels, np.array([1, 2, 5, 32]))
    bad = []
    for i in range(4000):
        v = bytearray(good[i % 4])
        for _ in range(rng.randint(1, 5)):
            v[rng.randint(0, len(v) if i % 2 else 400)] = rng.randint(0, 256)
        bad.append(bytes(v[: rng.randint(0, len(v))] if i % 7 == 0 else v))
    for i in range(0, len(bad), 100):
        got = media.thumbnails([good[2], *bad[i : i + 100], None, good[1]])
        assert (got[0][2] == levels[3:8]).all() and (got[-1][2] == levels[1:3]).all() and got[-2] == "null"
        assert all(isinstance(g, str) or g[2].shape == (-(-g[1] // 8), -(-g[0] // 8)) or len(g[2]) for g in got)


class Bits:
    """A small encoder of baseline scans: canonical codes, any components and coefficients."""

    def __init__(self, dc, ac):
        self.dc = {s: (c, n) for s, c, n in media.huffman_codes(dc[:16], dc[16:])}
        self.ac = {s: (c, n) for s, c, n in media.huffman_codes(ac[:16], ac[16:])}
        self.out = ""

    def put(self, code, n):
        if n:
            self.out += format(code, f"0{n}b")

    def block(self, diff, coefficients):
        size = abs(diff).bit_length()
        self.put(*self.dc[size])
        self.put(diff if diff >= 0 else diff + (1 << size) - 1, size)
        run = 0 if coefficients else 1
        for x in coefficients:
            if x == 0:
                run += 1
                continue
            while run > 15:
                self.put(*self.ac[0xF0])
                run -= 16
            size = abs(x).bit_length()
            self.put(*self.ac[run << 4 | size])
            self.put(x if x >= 0 else x + (1 << size) - 1, size)
            run = 0
        if run:
            self.put(*self.ac[0])

    def bytes(self):
        s = self.out + "1" * (-len(self.out) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def jpeg(width, height, comps, scans):
    """comps: (id, h, v); scans: (component ids, bytes)."""
    dc = media._dht(0x00, {s: 4 for s in range(12)})
    ac = media._dht(0x10, {s: 8 for s in [0, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 9))]})
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0, 8] + [1] * 63)) + media._segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(comps)]) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in comps)) + media._segment(0xC4, dc) + media._segment(0xC4, ac)
    for ids, data in scans:
        head += media._segment(0xDA, bytes([len(ids)]) + b"".join(bytes([i, 0]) for i in ids) + bytes([0, 63, 0])) + data
    return head + b"\xff\xd9"


def _coder():
    dc = media._dht(0x00, {s: 4 for s in range(12)})
    ac = media._dht(0x10, {s: 8 for s in [0, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 9))]})
    return Bits(dc[1:], ac[1:])


@pytest.mark.parametrize("several_scans", [False, True])
def test_media_subsampled_with_coefficients(several_scans):
    rng = np.random.RandomState(3)
    width, height = 40, 24  # luminance 5 x 3 blocks, in groups of 2 x 2
    luma = rng.randint(-100, 100, (4, 6))
    chroma = rng.randint(-100, 100, (2, 2, 3))
    ac = lambda: [int(x) if rng.randint(4) == 0 else 0 for x in rng.randint(-9, 9, 63)]
    comps = [(1, 2, 2), (2, 1, 1), (3, 1, 1)]
    if several_scans:
        scans = []
        for ids, plane in (([2], chroma[0]), ([1], luma[:3, :5]), ([3], chroma[1])):
            b, last = _coder(), 0
            for x in plane.ravel().tolist():
                b.block(x - last, ac())
                last = x
            scans.append((ids, b.bytes()))
    else:
        b, last = _coder(), [0, 0, 0]
        for my in range(2):
            for mx in range(3):
                for y in range(2):
                    for x in range(2):
                        v = int(luma[2 * my + y, 2 * mx + x])
                        b.block(v - last[0], ac())
                        last[0] = v
                for k in range(2):
                    v = int(chroma[k, my, mx])
                    b.block(v - last[k + 1], ac())
                    last[k + 1] = v
        scans = [([1, 2, 3], b.bytes())]
    (got,) = media.thumbnails([jpeg(width, height, comps, scans)])
    assert not isinstance(got, str), got
    assert got[:2] == (40, 24) and (got[2] == luma[:3, :5] + 128).all()


def test_quality(spark, docs, empty):
    good = [(i, " ".join(f"word{(i * k) % 17}." for k in range(1, 40)), "en", "a", 1) for i in range(200)]
    bad = [(1000 + i, "!! $$$ ### %%% " * (5 + i % 7), "en", "a", 1) for i in range(60)]
    d = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1) for r in good[::2]] + [(r[0], 0) for r in bad[::2]] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(d, labels)
    s = {r["doc_id"]: r["score"] for r in quality.score(d, model).collect()}
    assert min(s[r[0]] for r in good) >= 0.7 > max(s[r[0]] for r in bad)
    got = quality.score(docs, model, keep_text=True)
    assert got.count() == len(AWKWARD) and got.filter("score is null or score < 0 or score > 1").count() == 0
    nothing = quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(empty, nothing).count() == 0 and quality.score(docs, nothing).count() == len(AWKWARD)
    assert 0.3 < quality.estimated_prior(np.linspace(0.5, 1, 500), np.concatenate([np.linspace(0.5, 1, 250), np.linspace(0, 0.3, 250)])) < 0.6


def test_packing(docs, empty):
    got = packing.packed(docs).collect()
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, *_ in AWKWARD:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : a + 1024 if a else first]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.packed(empty).count() == 0


def test_packing_program():
    rng = np.random.RandomState(0)
    cases = [{int(k): int(v) for k, v in zip(rng.randint(1, 1025, 60), rng.randint(1, 400, 60))} for _ in range(3)]
    cases += [{300: 500, 400: 700, 500: 900, 600: 400, 700: 300}, {1024: 3}, {700: 5}, {1: 1}, dict(collections.Counter(rng.randint(340, 701, 800).tolist()))]
    for h in cases:
        plan = packing.plan(h)
        used = collections.Counter()
        for config, n in plan.entries:
            assert n > 0 and sum(a * b for a, b in config) <= 1024
            for a, b in config:
                used[a] += b * n
        assert used == h
        least = sum(n for _, n in packing.best_fit({k: n for k, n in h.items() if k < 1024}, 1024)) + h.get(1024, 0)
        assert plan.bound <= plan.sequences + 1e-6 and plan.sequences == sum(n for _, n in plan.entries) <= least
    # many lengths: the program's value is its bound, nearly, and its configurations place nearly everything
    h = dict(collections.Counter(np.clip(rng.gamma(2, 150, 40_000).astype(int), 1, 1023).tolist()))
    plan = packing.plan(h)
    assert plan.value <= 1.03 * plan.bound and plan.program >= 0.85 * plan.tokens and plan.sequences <= plan.bound + 12
    # what best fit can't do: sequences of 700 + 300 and 500 + 500, not 700 alone
    assert packing.plan({300: 500, 400: 700, 500: 900, 600: 400, 700: 300}).sequences < 1367


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("width", [32, 0])
def test_exact(docs, empty, largest, width):
    # a digest of no bytes puts all texts in one group: the byte verification must tell them apart
    got = collections.Counter(tuple(r) for r in exact.groups(docs, largest, digest_bytes=width).collect())
    by = collections.defaultdict(list)
    for i, t, *_ in AWKWARD:
        by[t or ""].append(i)
    want = collections.Counter()
    for t, ids in by.items():
        some = [i for i in ids if i is not None]
        keep = (max(some) if largest else min(some)) if some else None
        kept = False
        for i in ids:
            want[i, keep, len(ids), i == keep and not kept, hashlib.sha256(t.encode()).hexdigest()] += 1
            kept |= i == keep
    assert got == want
    assert exact.groups(empty, largest, digest_bytes=width).count() == 0
    left = exact.dedup(docs, largest, digest_bytes=width)
    assert left.columns == docs.columns and sorted(r["text"] or "" for r in left.collect()) == sorted(by)


@pytest.mark.parametrize("width", [32, 0])
def test_exact_batches(spark, monkeypatch, width):
    monkeypatch.setattr(exact, "FANOUT", 2)
    monkeypatch.setattr(exact, "LARGE_GROUPS", 10)
    rng = np.random.RandomState(4)
    batches = [[(int(i), f"t{rng.randint(40)}" if rng.randint(3) else "") for i in rng.randint(0, 200, 50)] for _ in range(3)]
    index, seen = exact.Index(digest_bytes=width), []
    for rows in batches:
        got = collections.Counter(tuple(r) for r in index.add(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        want = collections.Counter()
        for t in {t for _, t in rows}:
            old, new = [i for i, x in seen if x == t], sorted(i for i, x in rows if x == t)
            keep = min(old + new)
            kept = keep in old
            for i in new:
                want[i, keep, len(old) + len(new), i == keep and not kept, hashlib.sha256(t.encode()).hexdigest()] += 1
                kept |= i == keep
        assert got == want
        seen += rows
    assert max(r.level for r in index.runs) >= 1 and len(index.runs) < 3


def test_language(spark, docs, empty):
    vocab = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "zwölf boxkämpfer jagen viktor quer".split()}
    rng = np.random.RandomState(0)
    rows = [(i, " ".join(rng.choice(vocab[z], 30)), z, "s", 1) for i, z in enumerate(["aa", "bb"] * 60)]
    d = spark.createDataFrame(rows, SCHEMA)
    model = language.train(d)
    assert all(r["lang"] == r["lang_pred"] for r in language.predict(d, model).collect())
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert len(got[2]) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 10)) and got[11]["lang_pred"] in vocab
    far = spark.createDataFrame([(1, "xxqq wwkk " * 9, "aa", "s", 1)], SCHEMA)
    assert language.predict(far, model, reject=True).first()["lang_pred"] == "und"
    assert language.predict(empty, language.train(empty)).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.train(empty)).collect()} == {"und"}


def brute_near(rows, n):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, owner = {}, collections.defaultdict(list)
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        for x in sets[i]:
            owner[x].append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j, c in collections.Counter(j for x in s for j in owner[x] if j > i).items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near(spark, empty, monkeypatch):
    rng = np.random.RandomState(3)
    base = [[f"v{k}" for k in rng.randint(0, 300, 80)] for _ in range(12)]
    rows = [(100 + i, " ".join(f"V{k}" for k in rng.randint(0, 5000, rng.randint(0, 60)))) for i in range(150)]
    for i in range(240):
        w = list(base[0 if i < 120 else i % 12])
        for _ in range(rng.randint(0, 9)):
            w[rng.randint(80)] = f"x{rng.randint(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(7, "solo"), (9, "SOLO"), (8, ""), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(1))
    want = brute_near(rows, 2)
    monkeypatch.setattr(near, "SMALL", 8)
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "UNIT", 60)  # the longer sets weigh two
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.groups(d, n=2).collect()}
    assert got == want
    assert near.dedup(d, n=2).count() == len({c for _, c in want.values()})


def test_near_shared_lines(spark, monkeypatch):
    # a line that short texts share makes them somewhat alike: their candidates chain, the links don't
    rng = np.random.RandomState(11)
    line = " ".join(f"s{k}" for k in range(13))
    rows = [(i, line + " " + " ".join(f"w{k}" for k in rng.randint(0, 10**6, rng.randint(16, 24)))) for i in range(480)]
    rows += [(1000 + i, t + " end") for i, t in rows[:96]]
    monkeypatch.setattr(near, "SMALL", 8)
    monkeypatch.setattr(near, "BLOCK", 16)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.groups(d, n=2).collect()}
    assert got == brute_near(rows, 2) and got[1000][1] == 0


def test_near_levels(spark, monkeypatch):
    # a level of the trees writes its pivots, what it compares with them and what branches; all else is written once
    rng = np.random.RandomState(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in rng.choice(60, rng.randint(2, 16), replace=False):
            w[k] = f"x{rng.randint(10**6)}"
        rows.append((i, " ".join(w)))
    names, keep = [], near.stored
    monkeypatch.setattr(near, "SMALL", 8)
    monkeypatch.setattr(near, "stored", lambda df, name: names.append(name) or keep(df, name))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.groups(d, n=2).collect()}
    assert got == brute_near(rows, 2) and len({c for _, c in got.values()}) > 1
    deep = collections.Counter(names)
    assert deep["pivots"] > 3 and deep["near"] == 1 and set(names) & {"met", "kin"} == set()


def test_near_across():
    # places of different kin groups meet once, however the pairs are cut
    for grp in ([1], [4, 4, 4], [1, 1, 2, 5, 5, 5, 9]):
        got = [(i, j) for x, y in near._across(np.array(grp)) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert got == [(i, j) for i in range(len(grp)) for j in range(i + 1, len(grp)) if grp[i] != grp[j]]


def test_near_one_large_group(spark, monkeypatch):
    # near copies that hang together branch no more: rows grow with the group, not with its levels or pairs
    rng = np.random.RandomState(8)
    base = [f"b{k}" for k in range(60)]
    rows = [(1000 + i, " ".join(f"z{k}" for k in rng.randint(0, 10**6, 30))) for i in range(40)]
    for i in range(300):
        w = list(base)
        for k in rng.choice(60, rng.randint(1, 7), replace=False):
            w[k] = f"x{rng.randint(10**6)}"
        rows.append((i, " ".join(w)))
    made, keep = [], near.stored

    def counted(df, name):
        out = keep(df, name)
        if name == "branched":
            made.append(out.count())
        return out

    monkeypatch.setattr(near, "SMALL", 8)
    monkeypatch.setattr(near, "stored", counted)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.groups(d, n=2).collect()}
    assert got == brute_near(rows, 2)
    assert made and sum(made) < 2 * 16 * 300


def test_near_one_id(spark, monkeypatch):
    # rows of one id are one vertex: a large node may have no pairs at all, or few
    monkeypatch.setattr(near, "SMALL", 8)
    rows = [(5, " ".join(f"b{k}" for k in range(60)) + f" x{i}") for i in range(40)]
    for more in ([], [(9, rows[0][1] + " y"), (3, "other")]):
        got = {(r["doc_id"], r["component_id"]) for r in near.groups(spark.createDataFrame(rows + more, "doc_id long, text string"), n=2).collect()}
        assert got == ({(5, 5), (9, 5), (3, 3)} if more else {(5, 5)})


def test_near_awkward(docs, empty):
    got = near.groups(docs, n=2).collect()
    assert len(got) == len(AWKWARD)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert by[4] == by[5] == {4} and by[7] == by[6] == {6} and by[2] == {2} and by[None] == {None}
    assert near.groups(empty, n=2).count() == 0 and near.dedup(docs, n=5).columns == docs.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (5, 5)] + [(1000, k) for k in range(1001, 1200)]
    got = {r["v"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == 100 and got[1199] == 1000


def test_components_either_way(spark, monkeypatch):
    # a graph that may be broadcast takes one task, a larger one rounds; both say the same
    rng = np.random.RandomState(2)
    pairs = rng.permutation(400)[rng.randint(0, 400, (300, 2))].tolist()
    d, names, keep = spark.createDataFrame(pairs, "a long, b long"), [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or keep(df, name))
    one = {(r["v"], r["component"]) for r in graph.components(d).collect()}
    assert names == ["edges", "components"]
    monkeypatch.setattr(common, "MAX_BROADCAST", 0)
    assert one == {(r["v"], r["component"]) for r in graph.components(d).collect()} and "hooks" in names


def brute_substring(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted((i, t or "") for i, t in rows):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g))
    return out


def test_substring(spark, docs, empty):
    rng = np.random.RandomState(5)
    pool = [[f"t{k}" for k in rng.randint(0, 900, rng.randint(15, 70))] for _ in range(8)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = pool[rng.randint(8)]
            a = rng.randint(0, len(p) // 2)
            w += [f"u{k}" for k in rng.randint(0, 10**6, rng.randint(0, 9))] + p[a : a + rng.randint(10, 60)] * rng.randint(1, 3)
        rows.append((i, "  ".join(w)))
    rows += [(500, "same " * 70), (501, "same " * 45), (502, None), (503, LONG)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring.remove(d).collect()}
    assert got == brute_substring(rows)
    out = substring.remove(docs).collect()
    assert len(out) == len(AWKWARD) and {r["doc_id"]: r["n_removed"] for r in out}[9] == 60
    assert substring.remove(empty).count() == 0


def test_mixing(spark, docs, empty):
    rng = np.random.RandomState(2)
    rows = [(i, "w " * int(rng.randint(0, 60)), "en", [None, "a", "b", "c"][i % 4 if i % 3 else 1], 1) for i in range(4000)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = [r.asDict() for r in mixing.mix(d).collect()]
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(7)).collect()}
    assert {r["doc_id"]: r["taken"] for r in got} == again and len(got) == 4000
    size = collections.Counter()
    for i, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t))
    # by hand: a, b, c, null weigh 3, 1, 2, 3 of 150 %; what is over twice a source's size goes to the others by weight
    weigh, want, open_ = {"a": 3, "b": 1, "c": 2, None: 3}, {}, {"a", "b", "c", None}
    for _ in range(4):
        rest = 1.5 * sum(size.values()) - sum(want.values())
        share = {s: rest * weigh[s] / sum(weigh[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        want |= {s: 2.0 * size[s] for s in over}
        open_ -= set(over)
        if not over:
            want |= share
            break
    target = mixing.targets(dict(size), mixing.cyclic_weights(list(size)), 1.5, 2.0)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in size)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 and all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    taken = collections.Counter()
    for r, (_, t, _, s, _) in zip(sorted(got, key=lambda r: r["doc_id"]), rows):
        assert r["size"] == len(WORD.findall(t)) and 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert mixing.mix(docs).count() == len(AWKWARD) and mixing.mix(empty).count() == 0
    assert mixing.repeated(mixing.mix(d), d.columns).columns == d.columns
    # documents of ten times the odds are taken more often, and the target is met all the same
    heavy = d.withColumn("odds", F.when(F.col("doc_id") % 2 == 0, 10.0).otherwise(1.0))
    rows = mixing.mix(heavy, weight="odds", share=0.5, cycle=(1.0,)).collect()
    part = [sum(min(r["taken"], r["size"]) for r in rows if r["doc_id"] % 2 == k) / sum(r["size"] for r in rows if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert part[0] > part[1] + 0.2 and abs(sum(r["taken"] for r in rows) - 0.5 * sum(size.values())) <= 4
    same = spark.createDataFrame([(1, f"w {k}", "en", "a", 1) for k in range(200)] + [(None, f"v {k}", "en", "a", 1) for k in range(200)], SCHEMA)
    taken = [r["taken"] for r in mixing.mix(same, share=0.5).collect()]
    assert len(taken) == 400 and sum(taken) == 400


def test_tokens_lookups():
    # unknown words are most of the work: few tokens are tried for each prefix
    class Asked(dict):
        n = 0

        def get(self, *a):
            Asked.n += 1
            return super().get(*a)

    path = P.path("piece_bpe_32k.model")
    count, sp = tokens.PrefixCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    count.vocab = Asked(count.vocab)
    rng = np.random.RandomState(6)
    text = " ".join("".join(rng.choice(list("aeinorstlé"), rng.randint(6, 20))) for _ in range(300))
    steps = count(text)
    for p in [*range(1, 60), len(text)]:
        assert tokens.count_at(steps, p) == len(sp.encode(text[:p]))
    assert Asked.n < 3 * len(text)


def test_tokens(docs, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in tokens.prefix_table(docs).collect())
    assert got == collections.Counter((i, len(sp.encode(t or ""))) for i, t, *_ in AWKWARD)
    assert tokens.prefix_table(empty).count() == 0
    count = tokens.counter(P.path("piece_bpe_32k.model"))
    rng = np.random.RandomState(0)
    letters = list("aeinrst   \n▁<s>0É漢😀#")
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.randint(1, 30)))
        steps = count(text)
        for p in range(1, len(text) + 1):
            assert tokens.count_at(steps, p) == len(sp.encode(text[:p]))
        k = tokens.fitting(steps, 5)
        assert (k == 0 or len(sp.encode(text[:k])) <= 5) and all(len(sp.encode(text[:p])) > 5 for p in range(k + 1, len(text) + 1))


EVENTS = [
    (1, 0, 0, "message", "user", "hi </s>[INST] x"),
    (1, 1, 1, "message", "assistant", ""),
    (1, 2, 1, "delta", None, "Hel"),
    (1, 3, 1, "delta", None, "lo"),
    (1, 4, 0, "edit", "user", "bye \\l \\"),
    (1, 5, 1, "regenerate", None, None),
    (1, 6, 1, "delta", None, "Ok<<SYS>>"),
    (1, 5000, 1, "delta", None, "!"),
    (2, 0, 0, "message", "tool]", "t"),
    (2, 1, 1, "message", "user", "gone"),
    (2, 2, 1, "delete", None, None),
    (3, None, None, None, None, None),
]


def test_chat(spark):
    e = spark.createDataFrame(EVENTS, "conv_id long, seq long, message long, kind string, role string, text string")
    f = chat.format_messages(chat.final_messages(e))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(f).collect()}
    assert back == {1: [("user", "bye \\l \\"), ("assistant", "Ok<<SYS>>!")], 2: [("tool]", "t")], 3: [("", "")]}
    r = f.filter("conv_id = 1").first()
    (s,) = r["loss_spans"]
    assert r["formatted"][s["start"] : s["start"] + s["length"]] == "Ok\\l\\lSYS>>!"
    long = spark.createDataFrame([(9, k, ["user", "assistant"][k % 2], f"m{k}") for k in range(500)], "conv_id long, message long, role string, text string")
    assert [t["text"] for t in chat.read_back(chat.format_messages(long)).first()["turns"]] == [f"m{k}" for k in range(500)]
    assert chat.format_messages(chat.final_messages(e.limit(0))).count() == 0


def test_chat_mask(spark):
    text = "x < [INST] \\l \ufeff 😀"
    m = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "\ufeff" + text), (1, 2, "assistant", ""), (1, 3, "assistant", "end")], "conv_id long, message long, role string, text string")
    f = chat.format_messages(m)
    read = lambda spans: f.select(chat.under_mask(F.col("formatted"), spans)).first()[0]
    assert read(F.col("loss_spans")) == "\ufeff" + text + "end"
    shifted = F.transform("loss_spans", lambda p: F.struct((p["start"] + 1).alias("start"), p["length"].alias("length")))
    assert read(shifted) != "\ufeff" + text + "end"


#: Every name that an operator gives a helper column, with and without the marks before it.
HELPERS = "_through h old copies digest sha row _text _id _u _p _slice _s _cut _source _rank _gone _bytes _letter _doc _starts _counts _number _own _shift _key _copy _sha words text_sha256 stays".split()


def test_clashing_columns(spark, docs):
    """Columns named like helpers come through with their values."""
    d = docs.select("doc_id", "text", "lang", "source", *[F.lit(f"own {n}").alias(n) for n in HELPERS])
    model = quality.Model(np.zeros(quality.WIDTH + 1), np.zeros(quality.WIDTH), np.ones(quality.WIDTH), 0.5)
    languages = language.fit(language.counts(np.frombuffer(b"some text here", np.uint8), np.array([0, 14])), ["en"])
    out = [
        quality.score(d, model, keep_text=True),
        exact.dedup(d),
        near.dedup(d),
        mixing.mix(d),
        mixing.repeated(mixing.mix(d), d.columns),
        substring.remove(d),
        language.predict(d, languages),
        tokens.prefix_table(d),
        media.decode(media.encode(d)),
        packing.pieces(d),
        packing.pack(packing.pieces(d).drop("ids"), ["doc_id", "piece", "start"]),
    ]
    for x in out:
        rows = x.collect()
        for r in rows:
            r = r.asDict()
            assert {n: r.get(n, f"own {n}") for n in HELPERS} == {n: f"own {n}" for n in HELPERS}
        assert len(set(HELPERS) - set(x.columns)) <= 1
