"""Balancing weights from propensity scores, weighted balance and effective sample size."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import ROW_ID, quoted
from .balance import _side_by_side, smd_summary
from .checks import arm_counts, complete, default_covariates, label, numeric_columns, refuse_unusable, require_rows, treatment_level, unusable, validate_gps
from .propensity import estimate_gps_multinom

METHODS = ("iptw", "overlap", "matching")
_INF = float("inf")


def _over(a, b):
    """a / b with the infinities that Spark's division refuses."""
    return F.when(b == 0, F.lit(_INF)).otherwise(a / b)


def weights_from_scores(data: DataFrame, gps: DataFrame, arms: Sequence[str], method: str, treatment_var: str, stabilize: bool, trim: float, counts: dict[str, int], id_col: str) -> DataFrame:
    """(id, arm, h, weight, trimmed): trimmed marks rows with a score under trim."""
    scores = gps.select(F.col(quoted(id_col)).alias(id_col), F.array(*(F.col(quoted(c)).cast("double") for c in arms)).alias("e"))
    rows = data.select(F.col(quoted(id_col)).alias(id_col), label(data, treatment_var).alias("arm")).join(scores, id_col)
    rows = rows.withColumn("trimmed", F.exists("e", lambda x: x < trim) if trim > 0 else F.lit(False))
    if trim > 0 and gps.where(F.least(*(F.col(quoted(c)) for c in arms)) < trim if len(arms) > 1 else F.col(quoted(arms[0])) < trim).limit(1).count():
        # one low score has all rows bounded and scaled anew
        bounded = F.transform("e", lambda x: F.greatest(x, F.lit(trim)))
        rows = rows.withColumn("e", bounded)
        total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
        rows = rows.withColumn("s", total).withColumn("e", F.transform("e", lambda x: x / F.col("s"))).drop("s")
    own = F.element_at(F.map_from_arrays(F.array(*map(F.lit, arms)), F.col("e")), F.col("arm"))
    if method == "iptw":
        h = F.lit(1.0)
    elif method == "overlap":
        h = 1.0 / F.aggregate("e", F.lit(0.0), lambda s, x: s + _over(F.lit(1.0), x))
    else:
        h = F.array_min("e")
    rows = rows.withColumn("h", h).withColumn("own", own)
    # 0/0, of a subject without any chance of its own arm under a method that gives it no say
    weight = F.when((F.col("own") == 0) & (F.col("h") == 0), F.lit(math.nan)).otherwise(_over(F.col("h"), F.col("own")))
    if method == "iptw" and stabilize:
        n = sum(counts.values())
        weight = weight * F.element_at(F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*(F.lit(c / n) for c in counts.values()))), F.col("arm"))
    return rows.select(id_col, "arm", "h", weight.alias("weight"), "trimmed")


def compute_balancing_weights(data: DataFrame, method: str = "iptw", gps: DataFrame | None = None, X_vars: Sequence[str] | None = None, treatment_var: str = "T", anchor_level="A", stabilize: bool = True, trim: float = 1e-3, id_col: str = ROW_ID) -> dict:
    """{"weights": DataFrame(id, arm, h, weight), "method", "gps", "n_trimmed"}."""
    if method not in METHODS:
        raise ValueError('method must be "iptw", "overlap", or "matching"')
    if isinstance(trim, bool) or not isinstance(trim, (int, float, np.integer, np.floating)) or not math.isfinite(trim) or not 0 <= trim < 1:
        raise ValueError("trim must be in [0, 1)")
    if gps is None:
        gps = estimate_gps_multinom(data, X_vars, treatment_var, anchor_level, id_col)["gps"]
    arms = validate_gps(data, gps, treatment_var, "compute_balancing_weights", id_col)
    rows = weights_from_scores(data, gps, arms, method, treatment_var, stabilize, float(trim), arm_counts(data, treatment_var), id_col)
    return {"weights": rows.drop("trimmed"), "method": method, "gps": gps, "n_trimmed": rows.where("trimmed").count()}


def compute_weighted_balance(data: DataFrame, weights: DataFrame, X_vars: Sequence[str] | None = None, treatment_var: str = "T", anchor_level="A", id_col: str = ROW_ID) -> dict[str, DataFrame]:
    """{"by_covariate", "summary"} with weighted means and population variances; weights(id, weight)."""
    x_vars, anchor = default_covariates(X_vars), treatment_level(anchor_level)
    columns, w = numeric_columns(data, x_vars), F.col("weight")
    k = range(len(columns))
    # Rows of one id are put together where the join needs them anyway, so a repeated id shows without a pass of its own.
    once = weights.groupBy(id_col).agg(F.first("weight").alias("weight"), F.count("*").alias("times"))
    own = data.select(F.col(quoted(id_col)).alias(id_col), label(data, treatment_var).alias("arm"), F.lit(True).alias("there"), *(c.alias(f"x{i}") for i, c in enumerate(columns)))
    both = own.join(once, id_col, "full")
    told = both.groupBy("arm", "there").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.col("times"), F.lit(0)) != 1).alias("odd"), F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == _INF)).alias("bad"), F.count_if(w < 0).alias("negative"), F.min(id_col).alias("first"),
        F.sum(w).alias("w"), *(F.count_if(unusable(F.col(f"x{i}"))).alias(f"b{i}") for i in k), *(F.sum(F.col(f"x{i}") * w).alias(f"s{i}") for i in k),
    ).collect()  # a row for each arm, and one for weights of nobody
    rows = [r for r in told if r["there"]]
    if len(rows) < len(told) or any(r["odd"] for r in rows):
        raise ValueError("weights and data must contain the same number of observations")
    if any(r["bad"] for r in rows):
        raise ValueError("weights must all be finite")
    if any(r["negative"] for r in rows):
        raise ValueError("weights must be non-negative")
    counts = complete({r["arm"]: r["n"] for r in rows}, treatment_var)
    require_rows(counts.get(anchor, 0), anchor, treatment_var)
    refuse_unusable(x_vars, [sum(r[f"b{i}"] for r in rows) for i in k])
    groups = [r["arm"] for r in sorted(rows, key=lambda r: (r["first"], r["arm"])) if r["arm"] != anchor]
    total = {r["arm"]: r["w"] for r in rows}
    empty = {g for g, x in total.items() if not x > 0}
    if anchor in empty:
        raise ValueError("anchor-group weights must have a positive sum")
    if empty:
        raise ValueError("Weights must have a positive sum in every treatment group; zero total weight in: " + ", ".join(g for g in groups if g in empty))
    means = {r["arm"]: [r[f"s{i}"] / r["w"] for i in k] for r in rows}
    arms = F.array(*map(F.lit, means))
    off = [F.col(f"x{i}") - F.element_at(F.map_from_arrays(arms, F.array(*(F.lit(float(m[i])) for m in means.values()))), F.col("arm")) for i in k]
    squares = own.join(once, id_col).groupBy("arm").agg(*(F.sum(w * off[i] * off[i]).alias(f"q{i}") for i in k)).collect()  # one row per arm
    made = [(r["arm"], *means[r["arm"]], *(r[f"q{i}"] / total[r["arm"]] for i in k)) for r in squares]
    stats = data.sparkSession.createDataFrame(made, ", ".join(["arm string", *(f"m{i} double" for i in k), *(f"v{i} double" for i in k)]))
    by = _side_by_side(stats, "arm", x_vars, groups, anchor)
    return {"by_covariate": by.orderBy("grp_pos", "cov_pos").select("group", "covariate", "smd", "smd_defined"), "summary": smd_summary(by)}


def compute_effective_sample_size(weights: DataFrame, treatment: str | None = None, id_col: str = ROW_ID):
    """Kish's effective size of weights(weight): a number, or per group of the column named by treatment."""
    w = F.col("weight")
    ess = F.when(F.sum(w * w) == 0, F.lit(math.nan)).otherwise(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)))
    if treatment is None:
        out = weights.agg(ess.alias("ess")).first()[0]
        return math.nan if out is None else out
    first = F.min(id_col) if id_col in weights.columns else F.lit(0)
    return weights.groupBy(F.col(quoted(treatment)).cast("string").alias("group")).agg(F.count("*").alias("n"), ess.alias("ess"), first.alias("first")).orderBy("first", "group").drop("first")


def evaluate_comparator_weighting(data: DataFrame, method: str = "iptw", gps: DataFrame | None = None, X_vars: Sequence[str] | None = None, treatment_var: str = "T", anchor_level="A", stabilize: bool = True, trim: float = 1e-3, id_col: str = ROW_ID) -> dict:
    """Weights, weighted balance, effective sizes and the count of trimmed rows."""
    made = compute_balancing_weights(data, method, gps, X_vars, treatment_var, anchor_level, stabilize, trim, id_col)
    return {
        "method": method, "weights": made["weights"], "gps": made["gps"], "n_trimmed": made["n_trimmed"],
        "balance": compute_weighted_balance(data, made["weights"], X_vars, treatment_var, anchor_level, id_col),
        "ess": compute_effective_sample_size(made["weights"], "arm", id_col),
    }
