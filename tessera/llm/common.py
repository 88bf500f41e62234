"""Shared plumbing: table access, shared folders, Arrow batches, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Documents may be long, so batches hold few of them.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Bytes of text handled at once by the numpy kernels.
CHUNK_BYTES = 2 << 20
#: A key is heavy if more than one in so many rows have it, and more rows than these.
HEAVY, HEAVY_ROWS = 1000, 16
SPREAD = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Readers and Python workers get few rows at a time, and workers fewer still where texts are long: these are settings of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)  # four thousand texts at once fill a heap


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset and all of Spark is on one machine, as in
    tests, a temporary folder; elsewhere executors would each write to their own, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_scopes: list[list[str]] = []
_left: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder. It goes with the innermost own_scratch(), or when the program ends."""
    path = f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    else:
        if not _left:
            atexit.register(_remove_left)
        _left[path] = spark
    return path


@contextlib.contextmanager
def own_scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is removed at the end: results that read it have to be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_left() -> None:
    with contextlib.suppress(Exception):  # the program ends, its JVM may be gone
        for path, spark in _left.items():
            remove(spark, path)


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        remove(df.sparkSession, path)
        _left.pop(path, None)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def few(found: DataFrame) -> DataFrame:
    """A table of fewer than HEAVY rows as a local one, with its rows counted."""
    rows = found.collect()
    out = found.sparkSession.createDataFrame(rows, found.schema)
    out._rows, out._values = len(rows), [r[0] for r in rows]
    return out


def heavy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that more than one in HEAVY of all rows have, so fewer than HEAVY; a local table."""
    return heavy_of(df.groupBy(*keys).agg(F.count("*").alias("n")), df.count(), keys)


def heavy_of(counted: DataFrame, rows: int, keys: Sequence[str]) -> DataFrame:
    """The same from counts n by key, of so many rows in all."""
    return few(counted.where(F.col("n") > max(HEAVY_ROWS, rows // HEAVY)).select(*keys))


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left.join(right, keys, how), where right has one row a key at most. left's heavy keys (fewer than HEAVY, found
    by counting) are dealt over SPREAD parts by the whole row, and right's rows of them stand in each part: so no
    key gathers in a task, and each side is read once."""
    keys = list(keys)
    hot = heavy(left, keys) if hot is None else hot
    if not hot._rows:
        return left.join(right, keys, how)
    if len(keys) == 1:  # so few values need no join
        mark = lambda df: df.withColumn("_hot", F.col(keys[0]).isin(*map(F.lit, hot._values)))
    else:
        marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
        mark = lambda df: df.join(marked, keys, "left")
    parts = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")
    dealt = mark(left).withColumn("_part", parts).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    copied = mark(right).withColumn("_part", F.explode(every)).drop("_hot")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")


class Bloom:
    """A filter of keys known by F.xxhash64: 64-bit words, PROBES bits of one word a key. Its size follows the count
    of the keys up to MOST_WORDS (32 MB); beyond it lets more pass, but it never turns away a key."""

    PROBES, BITS, MOST_WORDS = 4, 16, 1 << 22

    def __init__(self, hashed: DataFrame):
        """hashed: one column of hashes, without nulls."""
        n = hashed.count()
        words = 1
        while words * 64 < n * self.BITS and words < self.MOST_WORDS:
            words *= 2
        keys = hashed.toDF("h")
        mask = F.lit(0).cast("long")
        for p in range(self.PROBES):
            mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * p + 32}) & 63 AS int))"))
        found = keys.select(F.pmod("h", F.lit(words)).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
        self.words = np.zeros(words, np.uint64)
        self.words[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)

    def maybe(self, hashed: np.ndarray) -> np.ndarray:
        """Whether keys of these hashes (longs) may be in the filter."""
        word = self.words[hashed & np.int64(len(self.words) - 1)]
        h, mask = hashed.view(np.uint64), np.zeros(len(hashed), np.uint64)
        for p in range(self.PROBES):
            mask |= np.uint64(1) << ((h >> np.uint64(6 * p + 32)) & np.uint64(63))
        return word & mask == mask


def maybe_in(spark: SparkSession, hashed: DataFrame):
    """A function of hashes, true for all of `hashed` and for few others, as a column."""
    shared = spark.sparkContext.broadcast(Bloom(hashed))  # at most 32 MB

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.maybe(h.to_numpy(np.int64)))

    return maybe


def without(docs: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """docs less the rows whose keys, null for null, are in gone's columns of these names. Rows that a filter turns
    away stay where they are; only the others meet `gone`, which is read several times."""
    names = list(keys)
    known = gone.select(*names).distinct()
    columns = docs.columns
    marked = docs.withColumns({f"_key_{k}": c for k, c in keys.items()})
    hit = maybe_in(docs.sparkSession, known.select(F.xxhash64(*names)))(F.xxhash64(*(f"_key_{k}" for k in names)))
    equal = [F.col(f"_key_{k}").eqNullSafe(F.col(f"_gone_{k}")) for k in names]
    met = marked.where(hit).join(known.toDF(*(f"_gone_{k}" for k in names)), equal, "left_anti")
    return marked.where(~hit).select(*columns).unionByName(met.select(*columns))


def lean(task):
    """Workers live long and take turns at many tasks: after a task what numpy and Arrow have freed goes back to the machine."""

    @functools.wraps(task)
    def run(*args):
        try:
            yield from task(*args)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a libc without it keeps its ways
                ctypes.CDLL(None).malloc_trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of equal key from batches that are sorted by it; holds one batch and one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0].as_py() != part.column(key)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The same batches as tables of whole groups of equal key, many at a time; holds one batch and one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[0].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(k, k[-1]))  # where the last group begins
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes in edges (a, b); component is the smallest node reachable.

    Every round each node goes over to one of itself and its neighbours, the least in even rounds, that with the least
    hash of the round in odd ones; edges within one node go, equal ones become one. An odd round leaves a part of
    the nodes whatever the graph, and groups whose members know their least one are done after an even one. At the end the rounds' moves are put together, the last and
    smallest first. Nodes with very many edges, or that very many others go over to, are joined apart from the
    rest. What a round needs is written to the shared folder. An empty input gives an empty result.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    for k in range(max_rounds):
        mark = lambda c: F.struct((F.xxhash64(c, F.lit(k)) if k % 2 else F.lit(0).cast("long")).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        ends = left.select("a", mark("b").alias("m"), "b").unionByName(left.select(F.col("b").alias("a"), mark("a").alias("m"), F.col("a").alias("b")))
        move = ends.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.min("m").alias("m"))
        move = materialize(move.select("node", "n", F.least("m", mark("node"))["to"].alias("to")), "moves")
        rows = move.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not rows:
            break
        hubs = heavy_of(move, rows, ["node"])
        moves.append(move)
        side = lambda c, to: (move.select(F.col("node").alias(c), F.col("to").alias(to)), hubs.withColumnRenamed("node", c))  # noqa: B023, E731
        after = left
        for c in ("a", "b"):
            to, hot = side(c, f"{c}_")
            hot._rows, hot._values = hubs._rows, hubs._values
            after = skew_join(after, to, [c], hot=hot)
        after = after.where("a_ <> b_").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct()
        before, left = left, materialize(after, "edges")
        discard(before)
    else:
        raise RuntimeError("connected components did not settle")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = moves[-1].select("node", "to")
    for move in reversed(moves[:-1]):
        on = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
        ends = materialize(skew_join(move.select("node", "to"), on, ["to"], "left").select("node", F.coalesce("end", "to").alias("to")), "moves")
    least = materialize(ends.groupBy("to").agg(F.min("node").alias("component")), "least")
    return materialize(skew_join(ends, least, ["to"]).select("node", "component"), "labels")
