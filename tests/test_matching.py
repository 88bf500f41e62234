"""Matching against slow restatements, hand-computed cases and invariants."""

import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tessera as P
from tessera.operators import checks, greedy, screen, threeway
from tessera.plans.model import groups_from_matched, matched_columns


def random_cohort(spark, n=150, seed=0, ties=False, arms="ABC"):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, 3)).astype(float) if ties else rng.normal(size=(n, 3))
    t = rng.choice(list(arms), n, p=[0.2, *([0.8 / (len(arms) - 1)] * (len(arms) - 1))])
    e = np.exp(0.3 * x[:, [i % 3 for i in range(len(arms))]])
    g = np.round(e / e.sum(axis=1, keepdims=True), 3)
    g[:, -1] = 1 - g[:, :-1].sum(axis=1)
    pdf = pd.DataFrame({"row_id": np.arange(n), "T": t, **{f"x{i}": x[:, i] for i in range(3)}, "y": rng.integers(0, 2, n)})
    gps = pd.DataFrame({"row_id": np.arange(n), **{a: g[:, i] for i, a in enumerate(arms)}})
    return spark.createDataFrame(pdf), spark.createDataFrame(gps), pdf, gps


def test_public_names():
    assert len(P.__all__) == 23 and all(hasattr(P, x) for x in P.__all__)


@pytest.mark.parametrize("ties,slice_rows", [(False, 20_000), (True, 20_000), (False, 15), (True, 15)])
def test_screen_is_the_full_sort(spark, monkeypatch, ties, slice_rows):
    monkeypatch.setattr(screen, "CELL_ROWS", slice_rows)
    monkeypatch.setattr(screen, "BLOCK_ROWS", slice_rows)
    data, gps, pdf, g = random_cohort(spark, 120, 3, ties)
    found = P.gps_candidate_search(data, gps, "T", "A", 4).edges.toPandas()
    p = g[list("ABC")].to_numpy()
    for a in pdf.row_id[pdf["T"] == "A"]:
        for grp in "BC":
            rows = pdf.row_id[pdf["T"] == grp].to_numpy()
            d = np.sqrt(((p[rows] - p[a]) ** 2).sum(axis=1))
            want = rows[np.lexsort((rows, d))[:4]].tolist()
            own = found[(found.anchor == a) & (found.grp == grp)].sort_values("rank")
            assert np.allclose(np.sort(d)[:4], own.gps_dist)
            if not ties:
                assert own.cand.tolist() == want


def slow_greedy(edges, groups):
    """One commitment after another, all offers computed anew each time."""
    used, done, out = set(), set(), []
    by = {k: v.sort_values("place") for k, v in edges.groupby(["anchor", "grp"])}
    anchors = sorted(edges.anchor.unique())
    while True:
        best = None
        for a in anchors:
            if a in done:
                continue
            picks = []
            for g in groups:
                free = [r for r in by.get((a, g), pd.DataFrame()).itertuples() if (g, r.cand) not in used]
                if not free:
                    break
                picks.append(free[0])
            else:
                loss = sum(r.dist for r in picks)
                best = min(best, (round(loss * 1e10), a, picks)) if best and best[:2] != (round(loss * 1e10), a) else best or (round(loss * 1e10), a, picks)
        if best is None:
            return out
        out.append((best[1], *(r.cand for r in best[2])))
        done.add(best[1])
        used |= {(g, r.cand) for g, r in zip(groups, best[2], strict=True)}


@pytest.mark.parametrize("seed,ties", [(0, False), (1, True), (2, True)])
def test_greedy_kernel_rounds_and_slow_agree(spark, monkeypatch, seed, ties):
    data, gps, _, _ = random_cohort(spark, 110, seed, ties)
    search = P.gps_candidate_search(data, gps, "T", "A", 5)
    edges = greedy.rank_edges(greedy.edge_distances(data, search.edges, ["x0", "x1", "x2"], "T")).toPandas()
    want = slow_greedy(edges, ["B", "C"])
    for strategy, tile in (("tiles", (16_384, 6, 9)[seed]), ("rounds", 1)):
        monkeypatch.setattr(greedy, "TILE", tile)
        m = P.sam_match(data, search, ["x0", "x1", "x2"], strategy=strategy)
        got = m.matched.orderBy("matched_set_id").toPandas()
        assert [tuple(r) for r in got[["anchor", "B", "C"]].to_numpy().tolist()] == want
        assert got.matched_set_id.tolist() == list(range(1, len(got) + 1))
        assert (np.diff(np.round(got.loss * 1e10)) >= 0).all() and got.B.is_unique and got.C.is_unique
        assert m.unmatched_anchor_rows.count() + len(got) == search.anchors.count()
        assert m.matching_rate <= m.max_possible_rate


def test_rounds_that_do_not_settle_are_an_error(spark):
    data, gps, _, _ = random_cohort(spark, 60, 0)
    search = P.gps_candidate_search(data, gps, "T", "A", 5)
    edges = greedy.rank_edges(greedy.edge_distances(data, search.edges, ["x0", "x1", "x2"], "T"))
    with pytest.raises(RuntimeError, match="did not settle"):
        greedy.by_rounds(edges, ["B", "C"], max_rounds=1)


def slow_trios(base, one, two, caliper, top_n):
    free1, free2 = set(range(len(one))), set(range(len(two)))
    dist = lambda a, b: math.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))
    queue, left, matched, out, number = [], {}, set(), [], 0

    def search(i):
        nonlocal number
        left[i] = 0
        if not free1:
            return
        a = min(free1, key=lambda k: (dist(one[k], base[i]), k))
        if not free2:
            return
        b = min(free2, key=lambda k: (dist(two[k], one[a]), k))
        seed = (dist(one[a], base[i]) + dist(two[b], base[i])) + dist(one[a], two[b])
        found = [(seed, a, b)] if seed <= caliper else []
        for x in free1:
            for y in free2:
                p = (dist(one[x], base[i]) + dist(two[y], base[i])) + dist(one[x], two[y])
                if p < seed and p <= caliper and dist(one[x], base[i]) < seed / 2 and dist(two[y], base[i]) < seed / 2:
                    found.append((p, x, y))
        found = sorted(found, key=lambda f: (round(f[0] * 1e10), f[1], f[2]))[:top_n]
        left[i] = len(found)
        for p, x, y in found:
            queue.append((round(p * 1e10), number, i, x, y))
            number += 1

    for i in range(len(base)):
        search(i)
    while queue:
        e = min(queue)
        queue.remove(e)
        _, _, i, x, y = e
        if i in matched:
            continue
        if x in free1 and y in free2:
            matched.add(i)
            free1.discard(x)
            free2.discard(y)
            out.append((i, x, y))
            continue
        left[i] -= 1
        if left[i] == 0:
            search(i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_three_way_queue_against_slow(seed):
    rng = np.random.default_rng(seed)
    base, one, two = (rng.random((n, 2)) for n in (12, 18, 20))
    for caliper in (0.3, 5.0):
        got = threeway.select_trios(base, one, two, caliper, 3)
        assert [g[:3] for g in got] == slow_trios(base, one, two, caliper, 3)
        assert all(g[3] <= caliper for g in got)


def test_three_way_end_to_end(spark):
    data, gps, pdf, _ = random_cohort(spark, 90, 5)
    search = P.gps_candidate_search(data, gps, "T", "A", 3)
    with pytest.warns(UserWarning):
        m = P.match_3way(data, search, gps, X_vars=["x0"])
    t = m.matched.toPandas()
    assert len(t) and (t.rassen_perimeter >= t.loss - 1e-12).all() and (t.rassen_perimeter <= m.info["caliper"]).all()
    assert t.anchor.is_unique and t.B.is_unique and t.C.is_unique
    assert m.info["red_level"] == pdf["T"].value_counts().idxmin()
    none = P.match_3way(data, search, gps, caliper=1e-12)
    assert none.matched.columns == matched_columns(["B", "C"], ("rassen_perimeter",)) and none.matching_rate in (0.0, none.matched.count() / search.anchors.count())
    with pytest.raises(ValueError, match="caliper"):
        P.match_3way(data, search, gps, caliper="wide")
    with pytest.raises(ValueError, match="reference_level"):
        P.match_3way(data, search, gps, reference_level="Z")
    with pytest.warns(DeprecationWarning):
        P.match_3way(data, search, gps, ps_space="logit")


def test_fit_without_a_hessian_ends_at_the_same_optimum(spark, monkeypatch):
    from tessera.operators import propensity

    data, _, _, _ = random_cohort(spark, 260, 4, arms="ABCD")
    want = P.estimate_gps_multinom(data, ["x0", "x1", "x2"], "T", "A")["model"]
    monkeypatch.setattr(propensity, "NEWTON_MOST", 0)
    got = P.estimate_gps_multinom(data, ["x0", "x1", "x2"], "T", "A")["model"]
    assert got.converged and np.abs(got.coefficients - want.coefficients).max() < 1e-9
    with pytest.warns(RuntimeWarning, match="2 steps were too few"):
        monkeypatch.setattr(propensity, "NEWTON_MOST", 2048)
        P.estimate_gps_multinom(data, ["x0"], "T", "A", max_iter=2)
    apart = spark.createDataFrame([(i, "AB"[i > 9], float(i)) for i in range(20)], "row_id long, T string, x double")
    with pytest.warns(RuntimeWarning, match="separated"):
        P.estimate_gps_multinom(apart, ["x"], "T", "A", max_iter=18)


def test_gps_fit_solves_the_score_equations(spark):
    data, _, pdf, _ = random_cohort(spark, 300, 8)
    out = P.estimate_gps_multinom(data, ["x0", "x1", "x2"], "T", "A")
    g = out["gps"].toPandas().sort_values("row_id")
    assert list(g.columns) == ["row_id", "A", "B", "C"] and out["model"].converged
    assert np.allclose(g[["A", "B", "C"]].sum(axis=1), 1)
    x = np.column_stack([np.ones(len(pdf)), pdf[["x0", "x1", "x2"]]])
    for a in "ABC":
        assert np.abs(x.T @ ((pdf["T"] == a) - g[a].to_numpy())).max() < 1e-6


def test_identity_checks_name_the_cause(spark):
    data, gps, pdf, _ = random_cohort(spark, 60, 2)
    search = P.gps_candidate_search(data, gps, "T", "A", 3)
    checks.check_data_fingerprint(search, data.repartition(5), "T", "x")
    checks.check_data_fingerprint(search, data.selectExpr("*", "1 AS more"), "T", "x")
    for changed, said in ((data.limit(50), "row count"), (data.selectExpr("row_id + 1 AS row_id", "T", "x0", "x1", "x2", "y"), "row_id. differ"), (data.selectExpr("row_id", "T", "x0 + 1 AS x0", "x1", "x2", "y"), "column value")):
        with pytest.raises(ValueError, match=said):
            P.sam_match(changed, search, ["x1"])
    with pytest.raises(ValueError, match="does not match the gps"):
        checks.check_gps_fingerprint(search, gps.selectExpr("row_id", "B AS A", "A AS B", "C"), "x")
    with pytest.raises(ValueError, match=r"x0 \(1 rows\)"):
        P.sam_match(data.selectExpr("row_id", "T", "CASE WHEN row_id = 3 THEN double('nan') ELSE x0 END AS x0"), search, ["x0"])
    for bad, said in (("A * 2 AS A", "sum to 1|interval"), ("double('nan') AS A", "finite"), ("'x' AS A", "numeric")):
        with pytest.raises(ValueError, match=said):
            checks.validate_gps(data, gps.selectExpr("row_id", bad, "B", "C"), "T", "x")
    with pytest.raises(ValueError, match="not found in gps: C"):
        checks.validate_gps(data, gps.selectExpr("row_id", "A", "B + C AS B"), "T", "x")
    with pytest.raises(ValueError, match="no rows found with T == 'Z'"):
        P.gps_candidate_search(data, gps, "T", "Z")
    with pytest.raises(ValueError, match="positive integer"):
        P.gps_candidate_search(data, gps, "T", "A", True)
    with pytest.raises(ValueError, match="Duplicated"):
        checks.require_covariates(data, ["x0", "x0"])
    assert groups_from_matched(spark.createDataFrame([], greedy.matched_schema(["B", "C"]))) == ["B", "C"]


def test_offset_does_not_move_the_match(spark):
    data, gps, _, _ = random_cohort(spark, 90, 4, ties=True)
    far = data.selectExpr("row_id", "T", "x0 + 1e6 AS x0", "x1", "x2", "y")
    a, b = (P.sam_match(d, P.gps_candidate_search(d, gps, "T", "A", 5), ["x0", "x1"]).matched.orderBy("matched_set_id").select("anchor", "B", "C").collect() for d in (data, far))
    assert a == b


def test_effects_and_evaluation_run_on_a_match(spark):
    data, gps, _, _ = random_cohort(spark, 150, 6)
    search = P.gps_candidate_search(data, gps, "T", "A", 8)
    match = P.sam_match(data, search, ["x0", "x1"])
    out = P.sam_evaluate(data, search, match, gps, ["x0", "x1", "x2"])
    assert out["smd_balance"]["by_covariate"].count() == 6 and out["treatment_discrimination_auc"]["pairwise"].count() == 3
    cohort = P.extract_matched_data(data, search, match)
    assert cohort.data.count() == 3 * match.matched.count() and cohort.data.columns[-3:] == ["matched_set_id", "matched_role", "original_row"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for method in ("normal", "t", "wild_bootstrap"):
            e = P.sam_estimate_effects(cohort, "y", ci_method=method, n_bootstrap=99, random_state=3)
            assert len(e["contrasts"].columns) == 23 and e["contrasts"].count() == 2
    with pytest.raises(ValueError, match="ci_method"):
        P.sam_estimate_effects(cohort, "y", ci_method="exact")
    with pytest.raises(ValueError, match="no matched sets"):
        P.extract_matched_data(data, search, greedy.MatchResult(match.matched.limit(0), None, 0, 0))


@pytest.mark.parametrize("seed,ties", [(0, False), (3, True)])
def test_initial_trios_are_the_offers_of_all_free(spark, seed, ties):
    rng = np.random.default_rng(seed)
    arms = {"r": 14, "s": 25, "t": 22}
    pts = [(i, arm, *((rng.integers(0, 4, 2) / 4) if ties else rng.random(2)).tolist()) for i, arm in enumerate(a for a, n in arms.items() for _ in range(n))]
    points = spark.createDataFrame(pts, "id long, arm string, p1 double, p2 double")
    own = {a: [(p[0], np.array(p[2:])) for p in pts if p[1] == a] for a in arms}
    for caliper in (0.05, 0.4, 9.0):
        got = {}
        for x in threeway.initial_trios(points, ["r", "s", "t"], caliper, 5).orderBy("base", "rank").collect():
            got.setdefault(x["base"], []).append((x["first"], x["second"]))
        for i, q in own["r"]:
            d = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
            a = min(own["s"], key=lambda x: (((x[1] - q) ** 2).sum(), x[0]))
            b = min(own["t"], key=lambda x: (((x[1] - a[1]) ** 2).sum(), x[0]))
            seed_p = (d(a[1], q) + d(b[1], q)) + d(a[1], b[1])
            found = [(seed_p, a[0], b[0])] if seed_p <= caliper else []
            found += [(p, x[0], y[0]) for x in own["s"] for y in own["t"] if (p := (d(x[1], q) + d(y[1], q)) + d(x[1], y[1])) < seed_p and p <= caliper and d(x[1], q) < seed_p / 2 and d(y[1], q) < seed_p / 2]
            want = [f[1:] for f in sorted(found, key=lambda f: (round(f[0] * 1e10), f[1], f[2]))[:5]]
            assert got.get(i, []) == want or ties and len(got.get(i, [])) == len(want), (i, caliper)


def plane_cohort(spark, arms, g):
    n = len(arms)
    data = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "T": arms, "x": np.zeros(n)}))
    gps = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "A": g[:, 0], "B": g[:, 1], "C": 1 - g.sum(axis=1)}))
    return data, gps, P.gps_candidate_search(data, gps, "T", "A", 2)


def one_queue(arms, g, caliper, top_n=10):
    """Ids of (base, first, second) by one queue over all, and the base and the others."""
    base = min("ABC", key=lambda a: int((arms == a).sum()))
    order = [base, *(a for a in "ABC" if a != base)]
    ids, xy = {a: np.flatnonzero(arms == a) for a in "ABC"}, {a: g[arms == a] for a in "ABC"}
    return [tuple(int(ids[v][k]) for v, k in zip(order, t[:3], strict=True)) for t in threeway.select_trios(*(xy[v] for v in order), caliper, top_n)], order


def matched_trios(match, order):
    at = {"A": "anchor", "B": "B", "C": "C"}
    rows = match.matched.orderBy("matched_set_id").collect()
    assert [r["matched_set_id"] for r in rows] == list(range(1, len(rows) + 1))
    return [tuple(r[at[v]] for v in order) for r in rows]


@pytest.mark.parametrize("kind", ["clusters", "cloud", "ties", "line", "outlier"])
def test_tiles_agree_with_one_queue(spark, monkeypatch, kind):
    """Sets and their numbers are those of one queue over all, whatever the tiles and the reach of the start."""
    rng = np.random.default_rng(5)
    n = 160
    arms = np.array(list("ABC"))[rng.choice(3, n, p=[0.25, 0.4, 0.35])]
    where = rng.integers(0, 4, n)
    g = {
        "clusters": np.column_stack([0.2 + 0.1 * (where % 2), 0.2 + 0.1 * (where // 2)]) + rng.random((n, 2)) * 0.02,
        "cloud": rng.random((n, 2)) * 0.4,
        "ties": rng.integers(0, 5, (n, 2)) / 16,
        "line": np.column_stack([np.full(n, 0.25), rng.integers(0, 40, n) / 128]),
        "outlier": np.where(np.arange(n)[:, None] < 2, 0.48, rng.random((n, 2)) * 0.1),
    }[kind]
    if kind == "outlier":
        arms[:2] = min("ABC", key=lambda a: int((arms == a).sum()))
    data, gps, search = plane_cohort(spark, arms, g)
    caliper = 0.04 if kind == "clusters" else 0.5
    want, order = one_queue(arms, g, caliper)
    assert len(want) > 20
    for tile in (9, 4096) if kind == "ties" else (12,):
        monkeypatch.setattr(threeway, "TILE", tile)
        monkeypatch.setattr(screen, "CELL_ROWS", 20 if tile < 100 else 4096)
        assert matched_trios(P.match_3way(data, search, gps, caliper=caliper), order) == want


def test_numbers_of_sets_do_not_depend_on_the_caliper(spark, monkeypatch):
    """Six trios of no perimeter in two far clusters: ties go by the base id, in one tile or several."""
    g = np.array([[0.1, 0.1], [0.4, 0.4]])[np.repeat([0, 1, 0, 1, 1, 0], 3)]
    arms = np.array(list("ABC") * 6)
    data, gps, search = plane_cohort(spark, arms, g)
    for tile, calipers in ((4096, (2.0, 0.01)), (2, (2.0,))):
        monkeypatch.setattr(threeway, "TILE", tile)
        for caliper in calipers:
            assert [t[0] for t in matched_trios(P.match_3way(data, search, gps, caliper=caliper), "ABC")] == [0, 3, 6, 9, 12, 15]


@pytest.mark.parametrize("seed", range(3))
def test_ties_of_discrete_scores_against_slow(seed):
    rng = np.random.default_rng(seed)
    base, one, two = (rng.integers(0, 4, (n, 2)) / 8 for n in (14, 17, 19))
    for caliper in (0.3, 5.0):
        assert [g[:3] for g in threeway.select_trios(base, one, two, caliper, 3)] == slow_trios(base, one, two, caliper, 3)


def test_anchors_alike_beyond_their_candidates_are_idle(spark):
    """Of 25 anchors with the same three candidates of a group and four of the other, three may get a set; sets stay the same."""
    rng = np.random.default_rng(4)
    rows = []
    for kind in range(4):
        lists = [(g, int(c), float(d), n + 1) for g, size in (("B", 3), ("C", 4)) for n, (c, d) in enumerate(zip(rng.choice(9, size, replace=False), np.sort(rng.random(size)), strict=True))]
        rows += [(4 * i + kind, *e) for i in range(25) for e in lists]
    pdf = pd.DataFrame(rows, columns=["anchor", "grp", "cand", "dist", "place"])
    edges = spark.createDataFrame(pdf)
    busy = greedy.without_idle(edges, ["B", "C"]).toPandas()
    assert busy.anchor.nunique() == 12 and len(busy) == 84
    want = [(x[0], x[1]) for x in greedy.select_sets(pdf, ["B", "C"])]
    assert len(want) > 3 and [(x[0], x[1]) for x in greedy.select_sets(busy, ["B", "C"])] == want


def test_copies_at_one_place_share_their_searches(spark, monkeypatch):
    """Forty subjects of each arm at each of twelve places: searches follow places, not subjects, and so do the seeds."""
    rng = np.random.default_rng(2)
    few = [np.repeat(rng.random((4, 2)), 4, axis=0)[rng.permutation(16)] for _ in range(3)]
    assert [g[:3] for g in threeway.select_trios(*few, 5.0, 3)] == slow_trios(*few, 5.0, 3)
    base, one, two = (np.repeat(rng.random((12, 2)), 40, axis=0)[rng.permutation(480)] for _ in range(3))
    asked, nearest = [], threeway.FreePoints.nearest
    monkeypatch.setattr(threeway.FreePoints, "nearest", lambda self, *a: asked.append(1) or nearest(self, *a))
    assert len(threeway.select_trios(base, one, two, 5.0, 10)) == 480
    assert len(asked) < 480
    rows = [(1000 * k + i, arm, *p) for k, (arm, xy) in enumerate(zip("rst", (base, one, two), strict=True)) for i, p in enumerate(xy.tolist())]
    points = spark.createDataFrame(rows, "id long, arm string, p1 double, p2 double")
    arms = threeway._Arms(points, ["r", "s", "t"], dict.fromkeys("rst", 480))
    assert arms.seeds(10).count() == 12
    trios = threeway.initial_trios(points, ["r", "s", "t"], 5.0)
    of_place = trios.join(points.select(F.col("id").alias("base"), "p1", "p2"), "base").groupBy("p1", "p2", "rank").agg(F.count("*").alias("n"), F.countDistinct("first", "second").alias("kinds"))
    assert of_place.where("n <> 40 or kinds <> 1").isEmpty() and trios.select("base").distinct().count() == 480


def test_copies_at_one_place_play_as_one(spark, monkeypatch):
    """Sixteen places of many copies: they take their trios in turns, tiles follow places, and sets are those of one queue."""
    rng = np.random.default_rng(6)
    arms = np.array(list("ABC"))[np.repeat([0, 1, 2], [240, 280, 260])]
    g = np.concatenate([np.repeat(rng.random((16, 2)) * 0.4, 18, axis=0)[rng.permutation(288)[:n]] for n in (240, 280, 260)])
    asked, offers = [], threeway.Plane.offers
    with monkeypatch.context() as m:
        m.setattr(threeway.Plane, "offers", lambda self, *a: asked.append(1) or offers(self, *a))
        want, order = one_queue(arms, g, 0.3, 3)
    assert len(want) > 150 and len(asked) < 150
    data, gps, search = plane_cohort(spark, arms, g)
    rounds, tile = [], threeway._play_tile
    monkeypatch.setattr(threeway, "_play_tile", lambda *a: rounds.append(1) or tile(*a))
    monkeypatch.setattr(threeway, "TILE", 16)
    monkeypatch.setattr(threeway, "ROW_IDS", 5)
    assert matched_trios(P.match_3way(data, search, gps, caliper=0.3, top_n=3), order) == want
    assert len(rounds) == 1
    monkeypatch.setattr(threeway, "ALIKE", 5)
    assert matched_trios(P.match_3way(data, search, gps, caliper=0.3, top_n=3), order) == want
    assert len(rounds) > 2


def test_a_search_beyond_what_is_known_says_so():
    rng = np.random.default_rng(1)
    base, one, two = (rng.random((n, 2)) for n in (30, 60, 60))
    whole = threeway.Plane(base, one, two, 0.5, 1e-6, 4)
    for i in range(30):
        want, none = whole.offers(i)
        assert none == 0.0
        for known in (0.01, 0.05, 0.2, 2.0):
            ids = [np.flatnonzero(np.sqrt(((x - base[i]) ** 2).sum(axis=1)) < known) for x in (one, two)]
            got, need = threeway.Plane(base, one[ids[0]], two[ids[1]], 0.5, 1e-6, 4).offers(i, known)
            assert need >= known or not need and [(k, ids[0][a], ids[1][b]) for k, a, b, _ in got] == [o[:3] for o in want]


def test_cells_are_even_and_reached():
    from tessera.operators.cells import Cells

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(900, 3)), np.zeros((100, 3))])
    cells = Cells(x[rng.permutation(1000)[:500]], 16)
    own = cells.locate(x)
    assert len(cells) == 16 and np.bincount(own).max() < 300 and (own[900:] == own[900]).all()
    r = np.array([0.0, 0.3, 1.0, np.inf])
    q = rng.normal(size=(4, 3))
    row, cell = cells.reached(q, r)
    for i in range(4):
        near = {int(c) for c, p in zip(own, x, strict=True) if np.sqrt(((p - q[i]) ** 2).sum()) <= r[i]}
        assert near <= set(cell[row == i].tolist()) and int(cells.locate(q[i : i + 1])[0]) in cell[row == i]
    assert len(Cells(np.zeros((50, 2)), 8)) == 1 and len(Cells(np.zeros((0, 1)), 4)) == 1


def test_five_arms_against_slow(spark, monkeypatch):
    data, gps, _, _ = random_cohort(spark, 160, 9, arms="ABCDE")
    search = P.gps_candidate_search(data, gps, "T", "A", 6)
    edges = greedy.rank_edges(greedy.edge_distances(data, search.edges, ["x0", "x1"], "T")).toPandas()
    want = slow_greedy(edges, list("BCDE"))
    for strategy, tile in (("tiles", 9), ("rounds", 1)):
        monkeypatch.setattr(greedy, "TILE", tile)
        got = P.sam_match(data, search, ["x0", "x1"], strategy=strategy).matched.orderBy("matched_set_id").toPandas()
        assert [tuple(r) for r in got[["anchor", *"BCDE"]].to_numpy().tolist()] == want and len(want) > 10


def test_tiles_of_a_chain_of_conflicts(spark, monkeypatch):
    """Anchors that all want the same candidates, two to a tile: each round settles one tile more."""
    monkeypatch.setattr(greedy, "TILE", 2)
    rows = [(a, g, 100 + c, 1.0 + c + 0.01 * a, c + 1) for a in range(8) for g in "BC" for c in range(8)]
    edges = greedy.rank_edges(spark.createDataFrame(rows, "anchor long, grp string, cand long, dist double, rank int"))
    places = spark.createDataFrame([(a, [float(a)]) for a in range(8)], "anchor long, p array<double>")
    want = [tuple(w) for w in slow_greedy(edges.toPandas(), ["B", "C"])]
    for where in (places, None):
        got = greedy.by_tiles(edges, ["B", "C"], where).orderBy("matched_set_id").collect()
        assert [(r["anchor"], r["B"], r["C"]) for r in got] == want and len(got) == 8


def test_rounds_of_a_chain_of_conflicts(spark):
    """Anchors that all want the same candidates: as many rounds as anchors, none left out."""
    rows = [(a, g, 100 + c, 1.0 + c + 0.01 * a, c + 1) for a in range(8) for g in "BC" for c in range(8)]
    edges = greedy.rank_edges(spark.createDataFrame(rows, "anchor long, grp string, cand long, dist double, rank int"))
    got = greedy.by_rounds(edges, ["B", "C"]).orderBy("matched_set_id").collect()
    assert [(r["anchor"], r["B"], r["C"]) for r in got] == [tuple(w) for w in slow_greedy(edges.toPandas(), ["B", "C"])] and len(got) == 8


def test_rounds_that_commit_few_are_the_last(spark, monkeypatch):
    """One round for each anchor of a chain would be 24."""
    rows = [(a, g, 100 + c, 1.0 + c + 0.01 * a, c + 1) for a in range(24) for g in "BC" for c in range(24)]
    edges = greedy.rank_edges(spark.createDataFrame(rows, "anchor long, grp string, cand long, dist double, rank int"))
    made, real = [], greedy.materialize
    monkeypatch.setattr(greedy, "materialize", lambda df, what: made.append(what) or real(df, what))
    got = greedy.by_rounds(edges, ["B", "C"]).orderBy("matched_set_id").collect()
    assert [(r["anchor"], r["B"], r["C"]) for r in got] == [tuple(w) for w in slow_greedy(edges.toPandas(), ["B", "C"])] and len(got) == 24
    assert made.count("bids") == 1


def test_screen_of_a_tied_first_score(spark, monkeypatch):
    """Cells by the scores that differ; many anchors in a cell are dealt into blocks."""
    monkeypatch.setattr(screen, "CELL_ROWS", 10)
    monkeypatch.setattr(screen, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(2)
    n = 150
    g = np.column_stack([np.full(n, 0.25), rng.random(n) * 0.7])
    t = np.array(list("AABC"))[rng.integers(0, 4, n)]
    gps = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "A": g[:, 0], "B": g[:, 1], "C": 1 - g.sum(axis=1)}))
    data = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "T": t}))
    found = P.gps_candidate_search(data, gps, "T", "A", 3).edges.toPandas()
    p = np.column_stack([g, 1 - g.sum(axis=1)])
    for a in np.flatnonzero(t == "A"):
        for grp in "BC":
            rows = np.flatnonzero(t == grp)
            d = np.sqrt(((p[rows] - p[a]) ** 2).sum(axis=1))
            assert found[(found.anchor == a) & (found.grp == grp)].sort_values("rank").cand.tolist() == rows[np.lexsort((rows, d))[:3]].tolist()


def test_rows_are_numbered_in_order(spark):
    from tessera.plans.model import numbered

    df = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 AS k", "id")
    rows = numbered(df.repartition(6), ["k"], "n").collect()
    assert all(r["n"] == r["k"] + 1 for r in rows) and len(rows) == 1000
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def test_old_fingerprints_and_columns_that_cannot_be_hashed(spark):
    rows = [(i, "AB"[i % 2], float(i), {"a": i}, [i, None], (i, "x")) for i in range(20)]
    data = spark.createDataFrame(rows, "row_id long, T string, x double, m map<string,int>, l array<int>, s struct<a:int,b:string>")
    known = checks.data_fingerprint(data, "T")
    anchors = data.where("T = 'A'").selectExpr("row_id AS anchor")
    for fingerprint in (known, None, {k: known[k] for k in ("n_rows", "index_hash", "treatment_hash")}):
        checks.check_data_fingerprint(greedy.Search(None, anchors, "A", ["B"], "row_id", fingerprint), data, "T", "x")
    moved = data.withColumn("m", data["m"]).selectExpr("row_id", "T", "x", "map('a', 0) AS m", "l", "s")
    with pytest.raises(ValueError, match="does not match the data"):
        checks.check_data_fingerprint(greedy.Search(None, anchors, "A", ["B"], "row_id", known), moved, "T", "x")


def test_a_moved_cell_is_named_with_its_range_of_ids(spark):
    data = spark.range(-40, 5000).selectExpr("id AS row_id", "if(id % 2 = 0, 'A', 'B') AS T", "id * 0.5D AS x", "id % 7 AS k")
    known = checks.data_fingerprint(data, "T")
    anchors = data.where("T = 'A'").selectExpr("row_id AS anchor")
    search = greedy.Search(None, anchors, "A", ["B"], "row_id", known)
    for row, low, high in ((3000, 2944, 3071), (-33, -33, -32), (7, 7, 7)):
        moved = data.withColumn("k", data["k"] + (data["row_id"] == row).cast("int"))
        with pytest.raises(ValueError, match=rf"a column value differs in k \(ids from {low} to {high}\)$"):
            checks.check_data_fingerprint(search, moved, "T", "x")
    numbers = spark.range(-5000, 5000).withColumn("n", checks.id_range(checks.F.col("id"))).collect()
    assert all(checks.ids_of_range(r["n"])[0] <= r["id"] <= checks.ids_of_range(r["n"])[1] for r in numbers)


def test_row_ids_out_of_range(spark):
    data, gps, _, _ = random_cohort(spark, 60, 1)
    search = P.gps_candidate_search(data, gps, "T", "A", 3)
    match = P.sam_match(data, search, ["x0"])
    wrong = greedy.MatchResult(match.matched.selectExpr("matched_set_id", "anchor", "B + 1000 AS B", "C", "dist_B", "dist_C", "loss"), None, 0.0, 0.0)
    with pytest.raises(ValueError, match="Invalid row id"):
        P.extract_matched_data(data, search, wrong)
