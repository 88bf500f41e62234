"""Generalized propensity scores: unregularised multinomial logit.

Each step takes one pass, and the tasks' sums meet in two steps. With m = (K-1)(p+1) coefficients up to NEWTON_MOST, steps
are Newton's: every task sums gradient and Hessian of its rows, m numbers and their square. With more, steps
are those of limited-memory BFGS, for which a task sums m numbers only; what it starts from is the inverse of a bound of the
Hessian, 1/2 (I - 11'/K) x X'X, which takes the covariates' own products alone. Both end at the same optimum.
Scores are then plain column expressions.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import ROW_ID, materialize, quoted
from .checks import default_covariates, label, profile, require_rows, treatment_level


@dataclass
class GpsModel:
    """levels[0] is the anchor; coefficients: one row per level, intercept first, on the covariates' own scale."""

    levels: list[str]
    x_vars: list[str]
    coefficients: np.ndarray
    iterations: int
    converged: bool


#: Coefficients up to which a task holds a Hessian (32 MB); steps that the other way remembers; coefficients of standardized
#: covariates beyond which scores are 0 or 1 to the last bit.
NEWTON_MOST, MEMORY, APART = 2048, 12, 25.0


def _sums(rows: DataFrame, theta: np.ndarray, center: np.ndarray, scale: np.ndarray, hessian: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, gradient, Hessian) at theta (levels - 1 rows); without a Hessian, X'X in its place."""
    k, p = theta.shape
    size = k * p if hessian else p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k * p + size**2)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy()
            x = np.column_stack([np.ones(len(y)), *((batch.column(j + 1).to_numpy() - center[j]) / scale[j] for j in range(p - 1))])
            eta = np.column_stack([np.zeros(len(y)), x @ theta.T])
            eta -= eta.max(axis=1, keepdims=True)
            prob = np.exp(eta)
            prob /= prob.sum(axis=1, keepdims=True)
            total[0] += np.log(np.maximum(prob[np.arange(len(y)), y], 1e-300)).sum()
            q = prob[:, 1:]
            total[1 : 1 + k * p] += (((y[:, None] == np.arange(1, k + 1)) - q).T @ x).ravel()
            if not hessian:
                total[1 + k * p :] += (x.T @ x).ravel()
                continue
            hess = np.empty((k, p, k, p))
            for a in range(k):
                for b in range(k):
                    hess[a, :, b, :] = (x * (q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ x
            total[1 + k * p :] += hess.ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["salt", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"salt": [0], "sums": [np.sum([np.frombuffer(x, float) for x in pdf["sums"]], axis=0).tobytes()]})

    parts = rows.mapInArrow(run, "salt int, sums binary").groupBy("salt").applyInPandas(add, "salt int, sums binary").collect()  # 32 rows at most
    total = np.sum([np.frombuffer(r["sums"], float) for r in parts], axis=0)
    return total[0], total[1 : 1 + k * p], total[1 + k * p :].reshape(size, size)


def _remembered(grad: np.ndarray, products: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The step of limited-memory BFGS from the last steps and what the gradient fell by."""
    g, held = grad.copy(), []
    for s, y in reversed(past):
        a = (s @ g) / (s @ y)
        g -= a * y
        held.append((a, s, y))
    levels = g.reshape(-1, len(products))
    g = (2 * (levels + levels.sum(axis=0)) @ np.linalg.pinv(products)).ravel()
    for a, s, y in reversed(held):
        g += s * (a - (y @ g) / (s @ y))
    return g


def estimate_gps_multinom(data: DataFrame, X_vars: Sequence[str] | None = None, treatment_var: str = "T", anchor_level="A", id_col: str = ROW_ID, max_iter: int = 100, tol: float = 1e-10) -> dict:
    """{"model": GpsModel, "gps": DataFrame(id, one column per arm)}, the anchor's column first, then sorted arms."""
    x_vars, anchor = default_covariates(X_vars), treatment_level(anchor_level)
    known = profile(data, x_vars, treatment_var)
    counts, columns = known.counts, known.columns
    require_rows(counts.get(anchor, 0), anchor, treatment_var)
    levels = [anchor, *sorted(set(counts) - {anchor})]
    arm = label(data, treatment_var)
    code = F.coalesce(*(F.when(arm == v, F.lit(i)) for i, v in enumerate(levels))).cast("int")
    # codes and covariates: every Newton step reads these alone
    rows = materialize(data.select(code.alias("y"), *(c.alias(f"x{j}") for j, c in enumerate(columns))), "rows")
    if columns:
        center = known.center
        scale = np.array(rows.agg(*(F.stddev_pop(f"x{j}") for j in range(len(columns)))).first(), float)
        scale[~(scale > 0)] = 1.0
    else:
        center = scale = np.zeros(0)
    theta = np.zeros((len(levels) - 1, len(columns) + 1))
    converged, it = len(levels) == 1, 0
    if not converged:
        newton = theta.size <= NEWTON_MOST
        past: list[tuple[np.ndarray, np.ndarray]] = []
        ll, grad, second = _sums(rows, theta, center, scale, newton)
        for it in range(1, (max_iter if newton else 10 * max_iter) + 1):
            step = (np.linalg.pinv(second) @ grad if newton else _remembered(grad, second, past)).reshape(theta.shape)
            for half in range(30):  # a full step almost always raises the likelihood
                trial = theta + step / 2**half
                new = _sums(rows, trial, center, scale, newton)
                if new[0] >= ll - 1e-9 * abs(ll):
                    break
            moved = np.abs(trial - theta).max()
            past = [*past[1 - MEMORY :], ((trial - theta).ravel(), grad - new[1])] if not newton and (trial - theta).ravel() @ (grad - new[1]) > 0 else past
            theta, (ll, grad, second) = trial, new
            if moved < tol:
                converged = True
                break
        if not converged:
            apart = np.abs(theta).max() > APART or -ll < 1e-3  # or all scores of their own arms are 1
            warnings.warn("The multinomial model did not reach its tolerance; " + ("arms are separated by the covariates." if apart else f"{it} steps were too few."), RuntimeWarning, stacklevel=2)
    full = np.vstack([np.zeros(theta.shape[1]), theta])
    if len(columns):
        full[:, 1:] /= scale
        full[:, 0] -= full[:, 1:] @ center
    model = GpsModel(levels, x_vars, full, it, converged)
    return {"model": model, "gps": predict_gps(model, data, id_col)}


def predict_gps(model: GpsModel, data: DataFrame, id_col: str = ROW_ID) -> DataFrame:
    """Softmax of the linear predictors, as expressions."""
    xs = [F.col(quoted(x)).cast("double") for x in model.x_vars]
    eta = [sum((F.lit(float(b)) * x for b, x in zip(row[1:], xs, strict=True)), F.lit(float(row[0]))) for row in model.coefficients]
    names = [f"__e{i}" for i in range(len(eta))]
    wide = data.select(F.col(quoted(id_col)).cast("long").alias(id_col), *(e.alias(n) for e, n in zip(eta, names, strict=True)))
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    wide = wide.select(id_col, *(F.exp(F.col(n) - top).alias(n) for n in names))
    total = sum((F.col(n) for n in names), F.lit(0.0))
    return wide.select(id_col, *((F.col(n) / total).alias(v) for n, v in zip(names, model.levels, strict=True)))
