"""Scalars, balance, weighting and effects against hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera as P
from tessera.functions.scalars import normal_quantile, order_key, t_quantile
from tessera.operators import linalg
from tessera.operators.balance import distance_summary
from tessera.sources.cohorts import compare_timings, make_data, timeit, write_tables, write_timings


def test_scalars(spark):
    assert P.expit(0.0) == 0.5 and P.expit(800.0) == 1.0 and P.expit(-800.0) == 0.0
    assert P.logit(0.0) == -math.inf and P.logit(1.0) == math.inf and P.logit(0.0, 1e-6) == pytest.approx(math.log(1e-6 / (1 - 1e-6)))
    row = spark.createDataFrame([(0.0, 1.0, 0.25)], "a double, b double, c double").select(P.logit(F.col("a")), P.logit(F.col("b")), P.expit(P.logit(F.col("c"))), order_key(F.lit(2.5e-10)), order_key(F.lit(3.5e-10))).first()
    assert row[0] == -math.inf and row[1] == math.inf and row[2] == pytest.approx(0.25) and row[3:] == (2.0, 4.0)


@pytest.mark.parametrize("p,df,want", [(0.975, 1, 12.7062047364), (0.975, 5, 2.5705818366), (0.95, 10, 1.8124611228), (0.995, 30, 2.7499956536), (0.025, 5, -2.5705818366)])
def test_t_quantile(p, df, want):
    assert t_quantile(p, df) == pytest.approx(want, abs=1e-8)
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054)


def test_auc_with_ties(spark):
    s, y = [1.0, 2.0, 2.0, 3.0, 0.5], [0, 1, 0, 1, 0]
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, i in zip(s, y) if i for b, j in zip(s, y) if not j])
    assert P.auc_mannwhitney(s, y) == pytest.approx(want) and math.isnan(P.auc_mannwhitney(s, [1] * 5))
    assert P.auc_mannwhitney(spark.createDataFrame(list(zip(s, y)), "score double, label int")).first()["auc"] == pytest.approx(want)


def test_smd_by_hand_and_single_set(spark):
    data = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0), (2, 4.0, 5.0), (3, 6.0, 5.0)], "row_id long, x double, c double")
    m = spark.createDataFrame([(1, 0, 2, 0.0, 0.0), (2, 1, 3, 0.0, 0.0)], "matched_set_id long, anchor long, B long, dist_B double, loss double")
    rows = {r["covariate"]: r for r in P.compute_smd_balance(data, m, ["x", "c"])["by_covariate"].collect()}
    assert rows["x"]["smd"] == pytest.approx(-3 / math.sqrt(2)) and rows["x"]["smd_defined"] and rows["c"]["smd"] == 0.0 and not rows["c"]["smd_defined"]
    one = P.compute_smd_balance(data, m.limit(1), ["x", "c"])
    assert [r["smd_defined"] for r in one["by_covariate"].collect()] == [False, False] and one["summary"].first()["n_undefined"] == 2
    none = P.compute_smd_balance(data, m.limit(0), ["x"])
    assert none["by_covariate"].count() == 0 and none["summary"].columns == ["group", "mean_abs_smd", "max_abs_smd", "n_undefined"]
    assert all(math.isnan(v) for v in distance_summary(m.limit(0), "loss").first())


def _two_arms(spark):
    data = spark.createDataFrame([(i, "A" if i < 3 else "B", float(i)) for i in range(6)], "row_id long, T string, x double")
    gps = spark.createDataFrame([(i, (i + 1) / 10, 1 - (i + 1) / 10) for i in range(6)], "row_id long, A double, B double")
    return data, gps


def test_weights(spark):
    data, gps = _two_arms(spark)
    g = np.array([[(i + 1) / 10, 1 - (i + 1) / 10] for i in range(6)])
    own = np.where(np.arange(6) < 3, g[:, 0], g[:, 1])
    for method, h in (("iptw", np.ones(6)), ("overlap", 1 / (1 / g).sum(axis=1)), ("matching", g.min(axis=1))):
        out = P.compute_balancing_weights(data, method, gps, stabilize=False, trim=0)
        w = out["weights"].orderBy("row_id").toPandas()
        assert np.allclose(w.weight, h / own) and np.allclose(w.h, h) and out["n_trimmed"] == 0
    assert P.compute_balancing_weights(data, "iptw", gps, trim=0.25)["n_trimmed"] == 2
    zero = spark.createDataFrame([(i, 0.0 if i == 0 else 0.5, 1.0 if i == 0 else 0.5) for i in range(6)], "row_id long, A double, B double")
    assert P.compute_balancing_weights(data, "iptw", zero, stabilize=False, trim=0)["weights"].where("row_id = 0").first()["weight"] == math.inf
    for bad in (1, True, -0.1, float("nan"), "x"):
        with pytest.raises(ValueError, match="trim"):
            P.compute_balancing_weights(data, "iptw", gps, trim=bad)
    with pytest.raises(ValueError, match="method"):
        P.compute_balancing_weights(data, "none", gps)


def test_weighted_balance_and_ess(spark):
    data, gps = _two_arms(spark)
    w = spark.createDataFrame([(i, float(v)) for i, v in enumerate((1, 1, 2, 1, 2, 1))], "row_id long, weight double")
    got = P.compute_weighted_balance(data, w, ["x"])["by_covariate"].first()
    ma, mb = (0 + 1 + 4) / 4, (3 + 8 + 5) / 4
    va, vb = ((ma - 0) ** 2 + (ma - 1) ** 2 + 2 * (ma - 2) ** 2) / 4, ((3 - mb) ** 2 + 2 * (4 - mb) ** 2 + (5 - mb) ** 2) / 4
    assert got["smd"] == pytest.approx((ma - mb) / math.sqrt((va + vb) / 2))
    assert P.compute_effective_sample_size(w.where("row_id < 3")) == pytest.approx(16 / 6)
    assert math.isnan(P.compute_effective_sample_size(w.selectExpr("0D AS weight")))
    for change, said in (("-weight", "non-negative"), ("double('nan')", "finite"), ("CASE WHEN row_id < 3 THEN 0D ELSE 1D END", "anchor-group"), ("CASE WHEN row_id < 3 THEN 1D ELSE 0D END", "zero total weight in: B")):
        with pytest.raises(ValueError, match=said):
            P.compute_weighted_balance(data, w.selectExpr("row_id", f"{change} AS weight"), ["x"])
    with pytest.raises(ValueError, match="same number"):
        P.compute_weighted_balance(data, w.limit(3), ["x"])
    report = P.evaluate_comparator_weighting(data, "overlap", gps, ["x"])
    assert set(report) == {"method", "weights", "gps", "n_trimmed", "balance", "ess"} and report["ess"].count() == 2


def test_distances_and_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    t = ["A"] * 15 + ["B"] * 25
    data = spark.createDataFrame([(i, t[i], float(x[i, 0]), float(x[i, 1])) for i in range(40)], "row_id long, T string, u double, v double")
    dev = np.vstack([x[:15] - x[:15].mean(axis=0), x[15:] - x[15:].mean(axis=0)])
    got = P.get_pooled_covariance(data, ["u", "v"])
    assert np.allclose(got["S"], dev.T @ dev / 38) and np.allclose(got["S_inv"], np.linalg.inv(got["S"]))
    anchors = spark.createDataFrame([(0,), (3,)], "anchor long")
    d = P.build_group_distance_matrices(data, ["u", "v"], "T", anchors, ["B"])["D"].toPandas()
    assert len(d) == 50
    for r in d.itertuples():
        z = x[r.anchor] - x[r.cand]
        assert r.dist == pytest.approx(math.sqrt(z @ got["S_inv"] @ z))
    with pytest.warns(RuntimeWarning, match="singular"):
        P.get_pooled_covariance(data.withColumn("w", F.lit(1.0)), ["u", "w"])
    m = P.mahalanobis_distance_matrix(data.limit(2), data.limit(3), ["u", "v"], got["S_inv"])
    assert m.count() == 6 and m.where("query = reference").agg(F.max("dist")).first()[0] == 0


@pytest.mark.parametrize("rows", [7, 1000])
def test_summaries_of_all_pairs(spark, monkeypatch, rows):
    """Blocks, and points that many rows share, against the distances themselves; no step makes a row for each pair."""
    monkeypatch.setattr(linalg, "PAIR_ROWS", rows)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, size=(90, 2)) / 4.0
    t = np.array(["A"] * 30 + ["B"] * 40 + ["C"] * 20)
    data = spark.createDataFrame([(i, str(t[i]), *map(float, x[i])) for i in range(90)], "row_id long, T string, u double, v double")
    anchors = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "anchor long")
    s_inv = P.get_pooled_covariance(data, ["u", "v"])["S_inv"]
    off = x[:, None] - x[None]
    dist = np.sqrt(np.einsum("abi,ij,abj->ab", off, s_inv, off))
    made = linalg.group_distance_summaries(data, ["u", "v"], "T", anchors, ["B", "C"])
    assert "Cartesian" not in made._jdf.queryExecution().toString() and "NestedLoop" not in made._jdf.queryExecution().toString()
    got = {(r["anchor"], r["grp"]): r for r in made.collect()}
    assert set(got) == {(i, g) for i in range(0, 30, 2) for g in "BC"}
    for (i, g), r in got.items():
        d = dist[i, t == g]
        assert r["n"] == len(d) and (r["least"], r["mean"], r["most"]) == pytest.approx((d.min(), d.mean(), d.max()))
    pairs = linalg.mahalanobis_summaries(data.where("T = 'A'"), data.where("T = 'B'"), ["u", "v"], s_inv).collect()
    assert len(pairs) == 30
    for r in pairs:
        d = dist[r["query"], t == "B"]
        assert r["n"] == 40 and (r["least"], r["mean"], r["most"]) == pytest.approx((d.min(), d.mean(), d.max()))
    assert linalg.mahalanobis_summaries(data.where("T = 'A'"), data.where("T = 'Z'"), ["u", "v"], s_inv).count() == 0


def test_separated_arm_is_flagged(spark):
    rows = [(s, a, int(a == "B" and s % 3 == 0)) for s in range(12) for a in "AB"]
    data = spark.createDataFrame(rows, "matched_set_id long, T string, y int")
    with pytest.warns(RuntimeWarning, match="0/12 events"):
        out = P.sam_estimate_effects(data, "y", anchor_level="A")
    c = out["contrasts"].first()
    assert c["separation"] and c["log_or"] == math.inf and c["RD"] == pytest.approx(1 / 3)
    for bad, said in (({"conf_level": 1.0}, "conf_level"), ({"ci_method": "wild_bootstrap", "n_bootstrap": 0}, "n_bootstrap"), ({"anchor_level": None}, "anchor_level"), ({"anchor_level": "Z"}, "not present")):
        with pytest.raises(ValueError, match=said):
            P.sam_estimate_effects(data, "y", **({"anchor_level": "A"} | bad))
    with pytest.raises(ValueError, match="binary"):
        P.sam_estimate_effects(data.withColumn("y", F.col("y") * 2), "y", anchor_level="A")
    with pytest.raises(ValueError, match="incomplete"):
        P.sam_estimate_effects(data.where("not (matched_set_id = 0 and T = 'B')"), "y", anchor_level="A")
    # a set with a null goes as a whole
    with pytest.warns(RuntimeWarning):
        gone = P.sam_estimate_effects(data.withColumn("y", F.expr("CASE WHEN matched_set_id = 1 AND T = 'A' THEN NULL ELSE y END")), "y", anchor_level="A")
    assert gone["analysis_summary"].first()["n_matched_sets"] == 11


def test_sources_and_timings(spark, tmp_path):
    d = make_data(spark, 500, 3, 1)
    assert d.count() == 500 and {r[0] for r in d.select("treatment").distinct().collect()} <= set("ABC")
    csv = tmp_path / "s.csv"
    csv.write_text("synthetic_id,treatment,mortality_28d,age,charlson_comorbidity_index,lactate_pre,mbp_pre,creatinine_pre,wbc_pre,male,vasopressor_preindex,invasive_vent_preindex,concurrent_vancomycin\n2,a,0,1,1,1,1,1,1,1,1,1,1\n1,b,1,1,1,1,1,1,1,0,0,0,0\n")
    assert [(r["row_id"], r["treatment"]) for r in P.load_sample_3group(spark, str(csv)).orderBy("row_id").collect()] == [(0, "b"), (1, "a")]
    assert P.load_sample_4group(spark, str(csv)).count() == 2
    write_tables({"d": d, "e": d.limit(0)}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "d")).count() == 500 and spark.read.parquet(str(tmp_path / "t" / "e")).columns == d.columns
    for n, sec in (("a", 2.0), ("b", 1.0)):
        write_timings(str(tmp_path / n), [{"name": "q", "sec": sec}])
    assert compare_timings(str(tmp_path / "a"), str(tmp_path / "b")) == [("q", 2.0, 1.0, 0.5)] and timeit(lambda: None) >= 0


def test_t_and_bootstrap_intervals(spark):
    rng = np.random.default_rng(3)
    rows = [(s, a, int(rng.random() < p)) for s in range(40) for a, p in (("A", 0.4), ("B", 0.6))]
    data = spark.createDataFrame(rows, "matched_set_id long, T string, y int")
    run = lambda d=data, **kw: P.sam_estimate_effects(d, "y", anchor_level="A", **kw)["contrasts"].first()
    normal, t = run(), run(ci_method="t")
    assert t["RD_ci_high"] == pytest.approx(t["RD"] + t_quantile(0.975, 39) * t["se_RD"]) and t["RD_ci_high"] > normal["RD_ci_high"]
    assert t["OR_ci_low"] == pytest.approx(math.exp(t["log_or"] - t_quantile(0.975, 39) * t["se_log_or"])) and t["se_RD"] == normal["se_RD"]
    one = run(ci_method="wild_bootstrap", n_bootstrap=999, random_state=5)
    two = run(data.repartition(7), ci_method="wild_bootstrap", n_bootstrap=999, random_state=5)
    assert all(one[c] == pytest.approx(two[c], abs=1e-12) for c in ("RD_ci_low", "OR_ci_high", "RR_ci_low"))
    assert one["RD_ci_low"] == pytest.approx(normal["RD_ci_low"], abs=0.05) and one["RD_ci_low"] < one["RD"] < one["RD_ci_high"]
    other = run(ci_method="wild_bootstrap", n_bootstrap=999, random_state=np.random.default_rng(1))
    assert other["RD_ci_low"] != one["RD_ci_low"]
    with pytest.warns(RuntimeWarning, match="degrees of freedom"):
        P.sam_estimate_effects(spark.createDataFrame([(1, "A", 0), (1, "B", 1)], "matched_set_id long, T string, y int"), "y", anchor_level="A", ci_method="t")


def test_pooled_covariance_of_three_hundred_covariates(spark):
    """Blocks of rows in tasks: the plan does not grow with the square of the covariates."""
    rng = np.random.default_rng(8)
    x, arm = rng.normal(size=(400, 300)) + 1e6, np.array(list("ABC"))[rng.integers(0, 3, 400)]
    names = [f"c{j}" for j in range(300)]
    data = spark.createDataFrame([(i, a, *v) for i, (a, v) in enumerate(zip(arm.tolist(), x.tolist(), strict=True))], ["row_id", "T", *names]).repartition(7)
    off = x - np.array([x[arm == a].mean(axis=0) for a in arm])
    got = P.get_pooled_covariance(data, names)["S"]
    assert np.allclose(got, off.T @ off / 397, rtol=1e-9, atol=1e-9)


def test_weights_of_other_or_repeated_ids_are_refused(spark):
    data = spark.createDataFrame([(i, "AB"[i % 2], float(i * i)) for i in range(6)], "row_id long, T string, x double")
    good = [(i, 1.0 + i) for i in range(6)]
    for bad in ([(i + 1, w) for i, w in good], [*good[:5], (4, 1.0)], [*good, (5, 1.0)], good[:5], [*good, (9, 1.0)]):
        with pytest.raises(ValueError, match="same number of observations"):
            P.compute_weighted_balance(data, spark.createDataFrame(bad, "row_id long, weight double"), ["x"])


@pytest.mark.parametrize("held", [100_000, 7])
def test_quantiles_are_those_of_all_values(spark, monkeypatch, held):
    """Few values are looked at, many are bracketed: hot values, ties at the ends, infinities and wide spans too."""
    from tessera.operators import ranks

    monkeypatch.setattr(ranks, "HELD", held)
    rng = np.random.default_rng(4)
    for x in ([3.0], [1.0, 2.0], rng.normal(size=300), np.round(rng.normal(size=200), 1), np.concatenate([np.zeros(180), rng.random(20)]), np.concatenate([rng.random(15), np.full(200, 5.0)]), 10.0 ** rng.integers(-200, 200, 60)):
        got = ranks.quantiles(spark.createDataFrame([(float(v),) for v in x], "x double"), (0.0, 0.5, 0.95, 1.0), len(x))
        assert got == pytest.approx(np.quantile(np.asarray(x, float), [0, 0.5, 0.95, 1]).tolist(), rel=1e-12)


def test_quantiles_of_a_million_values(spark):
    """More distinct values than are held: the bracket that is looked at holds a few thousand."""
    from tessera.operators import ranks

    values = spark.range(1_000_000).selectExpr("(id * 7919 % 1000003) / 8.0D AS x")
    want = np.quantile(np.arange(1_000_000) * 7919 % 1000003 / 8.0, [0.5, 0.95])
    assert ranks.quantiles(values, (0.5, 0.95), 1_000_000) == pytest.approx(want.tolist(), rel=1e-12)


@pytest.mark.parametrize("rows", [1_000_000, 60])
def test_auc_over_many_ranges(spark, monkeypatch, rows):
    from tessera.operators import ranks

    monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
    rng = np.random.default_rng(6)
    s, y, k = np.round(rng.normal(size=3000), 2), rng.integers(0, 2, 3000), rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(s, y, k)], "score double, label int, k int")
    for r in P.auc_mannwhitney(df, by=("k",)).collect():
        assert r["auc"] == pytest.approx(P.auc_mannwhitney(s[k == r["k"]], y[k == r["k"]]))


def test_evaluation_broadcasts_no_table_of_subjects(spark, tmp_path):
    """All parts of the report, while a table of more than 2 MB cannot be broadcast."""
    import __spark_entry__
    from tessera.plans import queries

    n = 90_000
    spark.range(n).selectExpr("id AS c_custkey", "element_at(array('BUILDING', 'FURNITURE', 'HOUSEHOLD'), CAST(id % 3 AS INT) + 1) AS c_mktsegment", "CAST(id * 7919 % 10007 AS DOUBLE) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2 * n).selectExpr(f"id % {n} AS o_custkey", "IF(id % 5 < 2, 'F', 'O') AS o_orderstatus", "CAST(id * 31 % 50021 AS DOUBLE) AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    queries._cohort(spark, str(tmp_path))
    spark.conf.set("spark.sql.maxBroadcastTableSize", 2 << 20)
    try:
        rows = __spark_entry__.queries()["evaluation"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    found = {(r["part"], r["name"]): r["value"] for r in rows}
    sets = np.arange(n).reshape(-1, 3) * 7919 % 10007
    loss = (np.abs(sets[:, 0] - sets[:, 1]) + np.abs(sets[:, 0] - sets[:, 2])) / 1000
    assert found["matching_rate", ""] == 1.0
    assert found["loss", "mean"] == pytest.approx(loss.mean(), abs=2e-6) and found["loss", "median"] == pytest.approx(np.median(loss), abs=2e-6)
    smd = (sets[:, 0].mean() - sets[:, 1].mean()) / np.sqrt((sets[:, 0].var(ddof=1) + sets[:, 1].var(ddof=1)) / 2)
    assert found["smd", "FURNITURE:x1"] == pytest.approx(smd, abs=2e-6)
