"""Diagnostics of a match: standardized differences, discrimination AUC, distance summaries.

Subjects are met by merge joins: as both sides grow with the input, a broadcast would pass one whole through the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log_ratio
from ..plans.model import ROW_ID, MatchResult, Search, groups_from_matched, materialize, quoted
from .checks import check_data_fingerprint, check_gps_fingerprint, covariate_columns, data_facts, default_covariates, infer_anchor_level, scores_facts, validate_gps
from .ranks import quantiles, running_totals


def _members(matched: DataFrame, groups: Sequence[str], anchor: str) -> DataFrame:
    """(matched_set_id, role, id): each set's subjects, one row each."""
    roles = F.array(F.struct(F.lit(anchor).alias("role"), F.col("anchor").alias("id")), *(F.struct(F.lit(g).alias("role"), F.col(quoted(g)).alias("id")) for g in groups))
    set_id = F.col("matched_set_id") if "matched_set_id" in matched.columns else F.lit(None).cast("long")
    return matched.select(set_id.alias("matched_set_id"), F.explode(roles).alias("m")).select("matched_set_id", "m.role", "m.id")


def _smd(mean_a: Column, mean_g: Column, var_a: Column, var_g: Column) -> tuple[Column, Column]:
    """(smd, defined). Null and NaN variances are not positive, though Spark ranks NaN highest."""
    sd = F.sqrt((var_a + var_g) / 2)
    defined = F.coalesce(sd > 0, F.lit(False)) & ~F.coalesce(F.isnan(sd), F.lit(True))
    return F.when(defined, (mean_a - mean_g) / sd).otherwise(F.lit(0.0)), defined


def _side_by_side(stats: DataFrame, arm: str, x_vars: Sequence[str], groups: Sequence[str], anchor: str) -> DataFrame:
    """(grp_pos, group, cov_pos, covariate, smd, smd_defined) from one row of m0.., v0.. per arm."""
    long = stats.select(F.col(arm).alias("arm"), F.posexplode(F.array(*(F.struct(F.lit(x).alias("covariate"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i, x in enumerate(x_vars)))).alias("cov_pos", "s")).select("arm", "cov_pos", "s.*")
    base = long.where(F.col("arm") == anchor).select("cov_pos", F.col("m").alias("ma"), F.col("v").alias("va"))
    position = F.array_position(F.array(*map(F.lit, groups)), F.col("arm"))
    both = long.where(F.col("arm").isin(list(groups))).join(F.broadcast(base), "cov_pos")  # one row per covariate
    smd, defined = _smd(F.col("ma"), F.col("m"), F.col("va"), F.col("v"))
    return both.select(position.alias("grp_pos"), F.col("arm").alias("group"), "cov_pos", "covariate", smd.alias("smd"), defined.alias("smd_defined"))


def smd_summary(by_covariate: DataFrame) -> DataFrame:
    defined = F.when(F.col("smd_defined"), F.abs("smd"))
    return by_covariate.groupBy("group").agg(F.avg(defined).alias("mean_abs_smd"), F.max(defined).alias("max_abs_smd"), F.count_if(~F.col("smd_defined")).cast("long").alias("n_undefined"))


def compute_smd_balance(data: DataFrame, matched: DataFrame, X_vars: Sequence[str] | None = None, groups: Sequence[str] | None = None, id_col: str = ROW_ID) -> dict[str, DataFrame]:
    """{"by_covariate", "summary"} of matched subjects, anchor against each group; no sets give no rows."""
    x_vars = default_covariates(X_vars)
    groups = groups_from_matched(matched) if groups is None else list(groups)
    columns = covariate_columns(data, x_vars)
    # A group may bear any name, so the anchors' role is one that no column can have
    members = _members(matched, groups, "")
    subjects = data.select(F.col(quoted(id_col)).cast("long").alias("id"), *(c.alias(f"x{i}") for i, c in enumerate(columns)))
    stats = members.join(subjects.hint("merge"), "id").groupBy("role").agg(*(f(f"x{i}").alias(f"{n}{i}") for i in range(len(columns)) for f, n in ((F.avg, "m"), (F.var_samp, "v"))))
    stats = materialize(stats, "stats")  # one row per arm, read by both results
    by = _side_by_side(stats, "role", x_vars, groups, "")
    return {"by_covariate": by.orderBy("grp_pos", "cov_pos").select("group", "covariate", "smd", "smd_defined"), "summary": smd_summary(by)}


def auc_mannwhitney(score, label=None, by: Sequence[str] = ()):
    """Rank AUC with average ranks. Of two arrays a number; of a DataFrame (score, label 0/1) one row per
    key in `by`, column auc; NaN if a class is absent."""
    if not isinstance(score, DataFrame):
        s, y = np.asarray(score, float), np.asarray(label) == 1
        n1, n0 = int(y.sum()), int((~y).sum())
        if not n1 or not n0:
            return float("nan")
        u, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
        return float((rank[y].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
    # Counts by distinct score: ties are one row, and so is a hot score.
    counted = materialize(score.groupBy(*by, "score").agg(F.sum(F.col("label").cast("long")).alias("ones"), F.count("*").alias("n")), "scores")
    ranked = running_totals(counted, by, "score", "n", "below").withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("ones") * F.col("rank")).alias("r"), F.sum("ones").cast("double").alias("n1"), F.sum(F.col("n") - F.col("ones")).cast("double").alias("n0"))
    auc = F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0"))).otherwise(F.lit(float("nan")))
    return sums.select(*by, auc.alias("auc"))


def compute_pairwise_treatment_auc(gps: DataFrame, matched: DataFrame, groups: Sequence[str] | None = None, anchor_level=None, id_col: str = ROW_ID) -> dict:
    """{"pairwise": DataFrame(group_1, group_2, auc), "mean_auc": float}; the mean folds each to max(auc, 1 - auc)."""
    groups = groups_from_matched(matched) if groups is None else list(groups)
    if anchor_level is None:
        raise ValueError("`anchor_level` is required")
    levels = [str(anchor_level), *groups]
    pairs = list(itertools.combinations(range(len(levels)), 2))
    members = _members(matched, groups, levels[0]).join(gps.select(F.col(id_col).cast("long").alias("id"), F.array(*(F.col(quoted(v)).cast("double") for v in levels)).alias("p")).hint("merge"), "id")
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(levels[i]).alias("group_1"), F.lit(levels[j]).alias("group_2"), log_ratio(F.col("p")[i], F.col("p")[j]).alias("score")) for i, j in pairs))
    scored = members.select("role", F.explode(rows).alias("s")).select("role", "s.*").where((F.col("role") == F.col("group_1")) | (F.col("role") == F.col("group_2")))
    pairwise = auc_mannwhitney(scored.withColumn("label", (F.col("role") == F.col("group_1")).cast("int")), by=("i", "j", "group_1", "group_2")).orderBy("i", "j").select("group_1", "group_2", "auc")
    mean = pairwise.agg(F.avg(F.greatest(F.col("auc"), 1.0 - F.col("auc")))).first()[0]
    return {"pairwise": pairwise, "mean_auc": float("nan") if mean is None else mean}


def distance_summary(values: DataFrame, column: str) -> DataFrame:
    """One row: mean, median, sd, p95 (interpolated), max; all NaN without rows."""
    own = values.select(F.col(quoted(column)).cast("double").alias("x")).where("x is not null")
    n, mean, sd, most = own.agg(F.count("*"), F.avg("x"), F.stddev_samp("x"), F.max("x")).first()
    median, p95 = quantiles(own, (0.5, 0.95), n)
    row = tuple(math.nan if v is None else float(v) for v in (mean, median, sd, p95, most))
    return values.sparkSession.createDataFrame([row], "mean double, median double, sd double, p95 double, max double")


def with_dispersion(matched: DataFrame, groups: Sequence[str]) -> DataFrame:
    return matched.withColumn("dispersion", sum((F.col(quoted(f"dist_{g}")) * F.col(quoted(f"dist_{g}")) for g in groups), F.lit(0.0)))


def sam_evaluate(data: DataFrame, search: Search, match_result: MatchResult, gps: DataFrame, X_vars: Sequence[str] | None = None, treatment_var: str = "T") -> dict:
    """loss_distribution, dispersion_distribution, smd_balance, treatment_discrimination_auc, matching_rate."""
    facts = check_data_fingerprint(search, data, treatment_var, "sam_evaluate") or data_facts(data, treatment_var, search.id_col)
    of_gps = scores_facts(gps, search.id_col, "sam_evaluate")
    validate_gps(data, gps, treatment_var, "sam_evaluate", search.id_col, (facts, of_gps))
    check_gps_fingerprint(search, gps, "sam_evaluate", of_gps)
    anchor = infer_anchor_level(data, search.anchors, treatment_var, search.id_col)
    matched = match_result.matched
    return {
        "loss_distribution": distance_summary(matched, "loss"),
        "dispersion_distribution": distance_summary(with_dispersion(matched, search.groups), "dispersion"),
        "smd_balance": compute_smd_balance(data, matched, X_vars, search.groups, search.id_col),
        "treatment_discrimination_auc": compute_pairwise_treatment_auc(gps, matched, search.groups, anchor, search.id_col),
        "matching_rate": match_result.matching_rate,
    }
