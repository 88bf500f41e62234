"""Sources: sample tables, generated cohorts, and a cohort from the customer and orders tables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import numbered

#: Columns of the sample tables, in order.
SAMPLE_COLUMNS = (
    "synthetic_id", "treatment", "mortality_28d", "age", "charlson_comorbidity_index", "lactate_pre", "mbp_pre", "creatinine_pre", "wbc_pre", "male", "vasopressor_preindex", "invasive_vent_preindex", "concurrent_vancomycin",
)


def _load_sample(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sample with row_id numbered in the order of synthetic_id."""
    kinds = {"synthetic_id": "long", "treatment": "string", "mortality_28d": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in SAMPLE_COLUMNS)
    rows = spark.read.csv(path, header=True, schema=schema)
    return numbered(rows, ["synthetic_id"], "row_id").withColumn("row_id", F.col("row_id") - 1)


def load_sample_3group(spark: SparkSession, path: str) -> DataFrame:
    """The three-arm sample; the file is the caller's, none is packaged."""
    return _load_sample(spark, path)


def load_sample_4group(spark: SparkSession, path: str) -> DataFrame:
    """The four-arm sample; the file is the caller's, none is packaged."""
    return _load_sample(spark, path)


def make_data(spark: SparkSession, n: int, k_groups: int = 4, seed: int = 0) -> DataFrame:
    """row_id, x0..x7 standard normal, treatment A.., y: arms and outcome depend on the covariates.

    An arm is the first whose own uniform number lies below its probability, else A.
    """
    base = spark.range(n).withColumnRenamed("id", "row_id")
    base = base.select("row_id", *(F.randn(seed * 100 + j).alias(f"x{j}") for j in range(8)), *(F.rand(seed * 100 + 50 + k).alias(f"u{k}") for k in range(k_groups)), F.rand(seed * 100 + 90).alias("uy"))
    lift = [F.exp(F.lit(0.0)) if k == 0 else F.exp(0.4 * F.col(f"x{k % 8}") - 0.3 * F.col(f"x{(k + 1) % 8}")) for k in range(k_groups)]
    total = sum(lift, F.lit(0.0))
    arm = F.coalesce(*(F.when(F.col(f"u{k}") < lift[k] / total, F.lit(chr(65 + k))) for k in range(k_groups)), F.lit("A"))
    risk = 1.0 / (1.0 + F.exp(-(-1.0 + 0.5 * F.col("x0") - 0.25 * F.col("x1"))))
    return base.select("row_id", *(f"x{j}" for j in range(8)), arm.alias("treatment"), (F.col("uy") < risk).cast("int").alias("y"))


def customer_cohort(spark: SparkSession, sf_dir: str, arms: tuple[str, ...] | None = None) -> DataFrame:
    """row_id, T (market segment), x1 (balance), x2 (orders), x3 (mean price, from whole cents), y (mostly filled)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderstatus", "o_totalprice")
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal")
    if arms:
        customers = customers.where(F.col("c_mktsegment").isin(list(arms)))
    n = F.coalesce("n", F.lit(0))
    return customers.join(per, customers["c_custkey"] == per["o_custkey"], "left").select(
        F.col("c_custkey").cast("long").alias("row_id"), F.col("c_mktsegment").alias("T"), F.col("c_acctbal").cast("double").alias("x1"), n.cast("double").alias("x2"),
        F.when(n > 0, F.col("cents").cast("double") / n / 100).otherwise(F.lit(0.0)).alias("x3"),
        F.when(F.coalesce("filled", F.lit(0)) * 2 > n, 1).otherwise(0).alias("y"),
    )


ARMS = ("BUILDING", "FURNITURE", "HOUSEHOLD")


def rational_gps(cohort: DataFrame) -> DataFrame:
    """Fixed scores of the three arms, rational in the covariates, so that any engine agrees to the bit."""
    s = [F.lit(1.0), 0.5 + (F.col("x1") + 1000) / 11000.0, 0.5 + F.col("x2") / 20.0]
    wide = cohort.select("row_id", *(c.alias(f"s{i}") for i, c in enumerate(s))).withColumn("t", F.col("s0") + F.col("s1") + F.col("s2"))
    return wide.select("row_id", *((F.col(f"s{i}") / F.col("t")).alias(a) for i, a in enumerate(ARMS)))


def timeit(f: Callable[[], object], reps: int = 3) -> float:
    """Median wall time."""
    took = []
    for _ in range(reps):
        t = time.perf_counter()
        f()
        took.append(time.perf_counter() - t)
    return sorted(took)[len(took) // 2]


def write_timings(path: str, rows: list[dict]) -> None:
    Path(path).write_text(json.dumps(rows, indent=1))


def compare_timings(old: str, new: str) -> list[tuple[str, float, float, float]]:
    """(name, old, new, new/old) of two files' common rows, by their `name`."""
    a, b = ({r["name"]: r["sec"] for r in json.loads(Path(p).read_text())} for p in (old, new))
    return [(k, a[k], b[k], b[k] / a[k]) for k in a if k in b]


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per name: results kept as fixtures."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
