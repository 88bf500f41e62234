"""Hard negatives, sharding and divergence against brute force, with nulls, ties, repeats, empty and extra rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import divergence, hard_negatives, sharding

from .helpers import awkward_texts, documents, prose

# 11 --------------------------------------------------------------------------------------------


def slow_negatives(rows):
    taken = []
    for at, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        taken.append((at, vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for at, vec_id, label, v in taken:
        if vec_id is None or vec_id % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), i, k, other) for k, i, other, w in taken if k != at]
        for score, pos, _, _ in sorted((x for x in scored if x[3] == label), key=order)[:5]:
            band = sorted((x for x in scored if x[3] != label and 50 * score <= 100 * x[0] <= 95 * score), key=order)[:3]
            out += [(vec_id, pos, r + 1, neg, score, s) for r, (s, neg, _, _) in enumerate(band)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, row long, key string")
    return sorted((tuple(r) for r in hard_negatives.mine(df.repartition(5)).collect()), key=str)


def clustered(rng, n, width=12, noise=0.3):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [[c + rng.gauss(0, noise) for c in centres[rng.randrange(6)]] for _ in range(n)]


@pytest.mark.parametrize("block", [None, 400])
def test_hard_negatives(spark, monkeypatch, block):
    if block:  # some anchors at once, few rows and pairs at once
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    rng = random.Random(11)
    rows = [(i, v, rng.randrange(4)) for i, v in enumerate(clustered(rng, 420))]
    same = rows[50][1]
    rows += [(5000 + i, same, i % 2) for i in range(40)]  # one vector under two labels, anchors among them
    rows += [(9, rows[9][1], rows[9][2]), (100, rows[100][1], rows[100][2]), (None, rows[0][1], 1), (None, None, 1), (7000, None, 2), (7050, [1.0, None], 2), (7100, [math.nan] * 12, 1), (7150, [math.inf] * 12, 1)]
    rows += [(7200, [], 1), (7250, [0.5, -0.25], 2), (7300, [0.0] * 12, 3), (7350, rows[3][1], None), (-50, rows[7][1], 3), (7400, [x * 1000 for x in same], 2)]
    want = slow_negatives(rows)
    assert len(want) > 60 and mined(spark, rows) == want


def test_hard_negatives_of_few_rows(spark):
    for rows in ([], [(50, [1.0, 2.0], 1)], [(1, [1.0], 1), (2, [1.0], 1)], [(50, [1.0], 1), (51, [0.9], 1), (52, [0.8], 2), (53, [], 2)], [(50, None, 1)]):
        assert mined(spark, rows) == slow_negatives(rows)


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        mined(spark, [(50, [1e8, 1e8], 1), (51, [1e8, 1e8], 1)])


def test_bounds_turn_no_pair_away():
    rng = np.random.default_rng(4)
    for spread in (np.ones(24), 0.7 ** np.arange(24)):
        ints = np.floor(256 * rng.normal(size=(300, 24)) * spread).astype(np.int64)
        turn = np.linalg.qr(rng.normal(size=(24, 24)))[0]
        p = hard_negatives.Points(ints, turn, [3, 9, 24])
        score = ints[:40] @ ints.T
        for low, high in ((-1e18, 1e18), (50_000, 1e18), (30_000, 60_000), (1e17, 1e18)):
            i, j, s = hard_negatives.surviving(p, p, np.arange(40), np.arange(300), np.full(40, float(low)), np.full(40, float(high)), None, [3, 9, 24])
            assert (s == score[i, j]).all() and {*zip(*np.nonzero((score >= low) & (score <= high)))} <= {*zip(i, j)}
    # bounds of decaying components leave few pairs to score
    assert len(hard_negatives.surviving(p, p, np.arange(40), np.arange(300), np.full(40, 150_000.0), np.full(40, np.inf), None, [3, 9, 24])[0]) < 40 * 300 / 10


# 12 --------------------------------------------------------------------------------------------


def slow_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    rng = random.Random(2)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(2, 60), *(rng.randrange(-(2**63), 2**63) for _ in range(200))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 9, 100, 5000):
        got = [r[0] for r in df.select(sharding.jump_hash(df["k"], shards)).collect()]
        assert got == [slow_jump(k, shards) for k in keys]
    moved = [(slow_jump(k, 8), slow_jump(k, 9)) for k in range(9000)]
    assert all(a == b or b == 8 for a, b in moved) and 800 < sum(a != b for a, b in moved) < 1200
    for bad in (0, True, 2.0):
        with pytest.raises(ValueError):
            sharding.jump_hash(df["k"], bad)


def test_places(spark):
    texts = [*awkward_texts(), "same", "same", None]
    ids = [*range(len(texts) - 6), None, None, 3, 3, 3, -5]
    rows = sorted(zip(ids, texts, strict=True), key=str)
    got = [tuple(r) for r in sharding.places(documents(spark, [t for _, t in rows], [i for i, _ in rows])).collect()]
    facts = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted((g[:3] for g in got), key=str) == sorted(facts, key=str)
    for doc_id, _, _, law, shard, _, grown in got:
        assert (law, shard, grown) == ("key", slow_jump(doc_id or 0, 8), slow_jump(doc_id or 0, 9))
    for shard in range(8):
        own = sorted((g for g in got if g[4] == shard), key=lambda g: g[5])
        assert [g[5] for g in own] == list(range(len(own)))
        order = [(g[0] is not None, g[0] or 0, g[2], g[1]) for g in own]
        assert order == sorted(order)
    assert sharding.places(documents(spark, [])).count() == 0


def test_shards_grow_by_the_rows_that_move(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    docs = documents(spark, [f"text {i}" for i in range(400)] + ["a", "b"], [*range(400), None, 7])
    sharding.write(docs, path, 4, files=5)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("shards/shard=*/*.parquet")}
    sharding.grow(spark, path, 4, 6, files=3)
    assert all(p.stat().st_mtime_ns == at for p, at in before.items())
    with pytest.raises(ValueError):
        sharding.grow(spark, path, 4, 6)
    now = sharding.read(spark, path, 6)
    assert sorted(r["text"] for r in now.collect()) == sorted(r["text"] for r in docs.collect()) and set(now.columns) == {*docs.columns, "shard"}
    assert all(r["shard"] == slow_jump(r["doc_id"] or 0, 6) for r in now.collect())
    copied = spark.read.parquet(path).where("shard >= 4").count()
    assert copied == sum(slow_jump(r["doc_id"] or 0, 6) >= 4 for r in docs.collect())
    named = spark.createDataFrame([("x", 1), ("x", 2), (None, 3)], "name string, n int")
    assert named.select(sharding.shard(named, 1000, "name")).distinct().count() == 2


# 13 --------------------------------------------------------------------------------------------


def slow_audit(docs, least_docs, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    groups, seen, counts = {d[:2] for d in docs}, defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        own = {s: counts[lang, s] for x, s in groups if x == lang}
        every = sum(own.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))

        for source, c in own.items():
            pairs = sorted((-sum(abs(share(c, t) - share(d, t)) for t in kept), s) for s, d in own.items() if s != source)
            terms = sorted((share(every, t) - share(c, t), t.encode(), t) for t in kept if c[t] and share(c, t) > share(every, t))
            out += [(lang, source, "pair", s, -v, r + 1) for r, (v, s) in enumerate(pairs)] + [(lang, source, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(terms[:top])]
    return sorted(out)


def audited(spark, docs, *args):
    df = spark.createDataFrame([(lang, source, text, 1, "x") for lang, source, text in docs], "lang string, source string, text string, count long, term string")
    return sorted(tuple(r) for r in divergence.audit(df.repartition(3), *args).collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_divergence(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(divergence, "MOST_BROADCAST", 0)
    rng = random.Random(6)
    docs = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None, "ü"]), t) for t in awkward_texts() + [prose(rng, rng.randrange(0, 60)) for _ in range(120)]]
    docs += [("en", "a", "ÉCOLE École don't it_is x2y [a]B`c{d}e~f\x7fg\x00h 日本語 ß"), ("en", "a", "école ÉCOLE")] * 5 + [("de", "x", "nie nie"), ("de", "y", ""), ("de", "y", None), ("it", None, None), ("", "b", "the the of")]
    for least, top in ((5, 50), (5, 3), (1000, 50)):
        assert audited(spark, docs, least, top) == slow_audit(docs, least, top)
    assert audited(spark, []) == []


def test_terms_of_long_texts_in_pieces():
    rng = random.Random(8)
    texts = ["", None, "a", "x" * 50, "tail " * 30, " ".join(rng.choice(["one", "Two", "é", "..", "日本", "z" * 30]) for _ in range(90)), "no end" + "y" * 40, "b"]
    group = np.array([0, 1, 0, 1, 0, 1, 0, 0])
    rows = lambda t: sorted(zip(*(t[c].to_pylist() for c in ("group", "term", "docs", "count")), strict=True))
    want = defaultdict(lambda: [0, 0])
    for g, t in zip(group.tolist(), texts, strict=True):
        for term, n in Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())).items():
            want[g, term][0] += 1
            want[g, term][1] += n
    for limit in (1, 3, 7, 20, 64, 10_000):
        found = pa.concat_tables(divergence.count_terms(pa.array(texts), group, limit)).group_by(["group", "term"]).aggregate([("docs", "sum"), ("count", "sum")])
        assert rows(found.rename_columns(["group", "term", "docs", "count"])) == sorted((*k, *v) for k, v in want.items())


def test_tallies_hold_every_term_once(spark):
    """The combinations of a pair, zeros too, add up to all kept terms."""
    kept = spark.createDataFrame([("l", [("a", 2), ("b", 1)]), ("l", [("a", 2)]), ("l", [("b", 1), ("c", 9)]), ("l", [("c", 1)]), ("l", [("a", 2), ("b", 1)])], "lang string, cells array<struct<source:string,count:bigint>>")
    pairs = spark.createDataFrame([("l", "a", "b", 5), ("l", "a", "c", 5), ("l", "b", "c", 5), ("m", "a", "b", 0)], "lang string, a string, b string, v long")
    got = {tuple(r)[:5]: r["n"] for r in divergence._tally(kept, pairs).collect()}
    assert {k[3:]: n for k, n in got.items() if k[1:3] == ("a", "b")} == {(2, 1): 2, (2, 0): 1, (0, 1): 1, (0, 0): 1}
    assert {k[3:]: n for k, n in got.items() if k[1:3] == ("a", "c")} == {(2, 0): 3, (0, 9): 1, (0, 1): 1}
    assert all(k[0] == "l" for k in got)
