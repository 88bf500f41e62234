"""The data model: what one stage hands to the next."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "row_id"
RESERVED = ("matched_set_id", "anchor", "loss", "rassen_perimeter")


@dataclass
class Search:
    """Candidates of each anchor subject: edges (anchor, grp, cand, gps_dist, rank), nearest first."""

    edges: DataFrame
    anchors: DataFrame
    anchor_level: str
    groups: list[str]
    id_col: str
    data_fingerprint: dict | None = None
    gps_fingerprint: dict | None = None
    places: DataFrame | None = None
    """(anchor, p): the scores of each anchor, if the search keeps them."""


@dataclass
class MatchResult:
    matched: DataFrame
    unmatched_anchor_rows: DataFrame
    matching_rate: float
    max_possible_rate: float
    info: dict = field(default_factory=dict)


@dataclass
class Cohort:
    """Matched subjects, and what the effects need to know of the match."""

    data: DataFrame
    anchor_level: str
    groups: list[str]

    @property
    def k(self) -> int:
        return 1 + len(self.groups)


def matched_columns(groups: list[str], extra: tuple[str, ...] = ()) -> list[str]:
    return ["matched_set_id", "anchor", *groups, *(f"dist_{g}" for g in groups), "loss", *extra]


def matched_schema(groups: list[str], extra: tuple[str, ...] = ()) -> T.StructType:
    """The same whether or not there are sets."""
    ids = {"matched_set_id", "anchor", *groups}
    return T.StructType([T.StructField(c, T.LongType() if c in ids else T.DoubleType(), False) for c in matched_columns(groups, extra)])


def groups_from_matched(matched: DataFrame) -> list[str]:
    return [c for c in matched.columns if c not in RESERVED and not c.startswith("dist_")]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset and all of Spark is on one machine, as in
    tests, a temporary folder; elsewhere executors would each write to their own, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    if not _made:
        atexit.register(_remove_made)
    path = f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


def _remove_made() -> None:
    with contextlib.suppress(Exception):  # the program ends, its JVM may be gone
        for path, spark in list(_made.items()):
            remove(spark, path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write to the cluster's shared folder and read again: the lineage ends, and lost executors lose nothing."""
    spark: SparkSession = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows' numbers in the given order, from 1, as a long column. Rows are sorted over ranges, and a
    number is the place within the range plus the counts of the ranges before: no task sees all rows."""
    rows = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # one row per range
    starts, total = [], 0
    for r in counts:
        starts.append((r["_part"], total))
        total += r["count"]
    before = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")
