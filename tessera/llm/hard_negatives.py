"""Hard-negative mining by an orthogonal PCA rotation: partial products, bounds, exact integer checks.

For each anchor: its POSITIVES best rows of the same label, and for each of these the best NEGATIVES rows of another
label whose score is between half and 95 hundredths of the positive's. A score is the inner product of two vectors of
integers, each floor(256 x).

Rotating all vectors by their principal components keeps inner products and gathers most of them in the leading
components. A pair's product over the leading components, more or less the product of the two norms of what
is left, bounds its score; a slack covers the rounding of the rotation. Pairs that the bounds rule out go; the others get
further components until few are left, and those are scored by integers. So the rotation decides how much is
done, never what is found.

Every row meets every anchor; anchors are the stated query set, one row in EVERY. They go out in blocks of
BLOCK_BYTES, each as a broadcast of that size, and a block reads the rows once for positives and once for negatives. Tasks are
splits of the table: a hot label makes none of them larger. Equal vectors of one label share their score, and only the
least ids among them can be found, so such a group stands for itself with its POSITIVES + 1 least ids and is
searched for once, whatever its size; its anchors then take what was found, each without itself.

Rows with a null label, a null vector, or a component that is null or not finite take no part. Where vec_id is
divisible by 7 the label is first replaced by (label + 1) % 10. Higher scores come first, ties by smaller vec_id. A
null vec_id is no anchor and comes after all others; rows of one vec_id are rows of their own. Vectors that are
shorter than the longest count as filled up with zeros, an empty one is all zeros. Scores beyond the range of a long
are an error. Other columns are ignored; an empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import numbered
from .common import lean, materialize, scratch, skew_join

# Fixed values of the task: anchors, labels, and the band of a negative's score in hundredths of the positive's.
EVERY, CHANGED, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95
#: Bytes of the anchors that are searched for at once, pairs in one matrix, and rows that a task holds at once.
BLOCK_BYTES, PAIRS, ROWS = 16 << 20, 2 << 20, 8192
#: Shares of the variance at which partial products are compared with the bounds.
CUTS = (0.5, 0.8, 0.95)
#: Rounding of rotation and partial products, in parts of the product of two norms.
SLACK = 1e-9
_LAST = np.iinfo(np.int64).max


def _matrix(column: pa.Array, width: int, kind: pa.DataType) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), kind.to_pandas_dtype())
    out[np.arange(width) < lengths[:, None]] = column.flatten().cast(kind).to_numpy(zero_copy_only=False)
    return out


@lean
def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch["vector"].flatten()
        bad = pc.fill_null(pc.invert(pc.is_finite(values)), True)
        parent = pc.list_parent_indices(batch["vector"]).to_numpy(zero_copy_only=False)
        own = np.ones(batch.num_rows, bool)
        own[parent[bad.to_numpy(zero_copy_only=False)]] = False
        batch = batch.filter(pa.array(own))
        x = np.floor(256 * batch["vector"].flatten().to_numpy(zero_copy_only=False))
        if len(x) and np.abs(x).max() >= 2.0**62:
            raise OverflowError("scores of these vectors do not fit a long")
        x = x.astype(np.int64)
        ends = np.cumsum(np.concatenate([[0], pc.list_value_length(batch["vector"]).to_numpy(zero_copy_only=False)])).astype(np.int64)
        # zeros at the end make no difference to a score, so none to a key
        key = [hashlib.blake2b(np.trim_zeros(x[a:b], "b").tobytes() + int(k).to_bytes(8, "little", signed=True), digest_size=16).digest() for a, b, k in zip(ends[:-1], ends[1:], batch["label"].to_pylist(), strict=True)]
        vector = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
        yield pa.RecordBatch.from_arrays([batch["row"], batch["vec_id"], batch["label"], pa.array(key, pa.binary()), vector], ["row", "vec_id", "label", "key", "vector"])


class Points:
    """Vectors of integers and their rotation, with the norms of what each cut leaves over."""

    def __init__(self, ints: np.ndarray, rotation: np.ndarray, cuts: list[int]):
        self.ints, self.turned = ints, ints.astype(float) @ rotation
        self.norm = np.sqrt((self.turned * self.turned).sum(axis=1)) * (1 + 1e-9)
        self.rest = [np.sqrt((self.turned[:, m:] ** 2).sum(axis=1)) * (1 + 1e-9) for m in cuts]


def surviving(a: Points, b: Points, rows: np.ndarray, others: np.ndarray, least: np.ndarray, most: np.ndarray, allowed: np.ndarray | None, cuts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of pairs of a[rows] and b[others] whose score may be between least and most of the former; i and
    j are indices of a and b. allowed: a matrix of the pairs that count."""
    x, y = a.turned[rows], b.turned[others]
    slack = SLACK * np.outer(a.norm[rows], b.norm[others])
    product, done, left = np.zeros((len(rows), len(others))), 0, allowed
    i = j = None
    for k, m in enumerate(cuts):
        if i is None:
            product += x[:, done:m] @ y[:, done:m].T
            reach = np.outer(a.rest[k][rows], b.rest[k][others]) + slack
            fits = (product + reach >= least[:, None]) & (product - reach <= most[:, None])
            left = fits if left is None else left & fits
            if left.sum() <= left.size // 16:  # few: from here on pair by pair
                i, j = np.nonzero(left)
                some = product[i, j]
        else:
            some += np.einsum("ij,ij->i", x[i, done:m], y[j, done:m])
            reach = a.rest[k][rows[i]] * b.rest[k][others[j]] + slack[i, j]
            fits = (some + reach >= least[i]) & (some - reach <= most[i])
            i, j, some = i[fits], j[fits], some[fits]
        done = m
    if i is None:
        i, j = np.nonzero(left) if left is not None else (v.ravel() for v in np.indices(product.shape))
    i, j = rows[i], others[j]
    score = np.concatenate([np.einsum("ij,ij->i", a.ints[i[s : s + 65536]], b.ints[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
    return i, j, score


def _best(group: np.ndarray, score: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The indices of each group's first `most` by (score descending, order), by group."""
    by = np.lexsort((order, -score, group))
    g = group[by]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return by[place < most]


class Ranking:
    """The best few rows of each group so far, as (row, vec_id, score)."""

    def __init__(self, groups: int, most: int):
        self.most, self.groups = most, groups
        self.group, self.row, self.id, self.score = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        own = [np.concatenate(x) for x in ((self.group, group), (self.row, row), (self.id, ids), (self.score, score))]
        kept = _best(own[0], own[3], own[2], self.most)
        self.group, self.row, self.id, self.score = (x[kept] for x in own)
        counts = np.bincount(self.group, minlength=self.groups)
        last = np.cumsum(counts) - 1
        full = counts == self.most
        self.least[full] = self.score[last[full]]


def _held(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, vec_id, label, vectors) of ROWS rows at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield _columns(held, width)
            held, n = [], 0
    if n:
        yield _columns(held, width)


def _columns(held: list[pa.RecordBatch], width: int) -> tuple[np.ndarray, ...]:
    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return (*(t[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "vec_id", "label")), _matrix(t["vector"], width, pa.int64()))


def _pieces(n: int, others: int) -> Iterator[np.ndarray]:
    step = max(1, PAIRS // max(others, 1))
    for s in range(0, n, step):
        yield np.arange(s, min(s + step, n))


def positives(anchors: dict, batches: Iterator[pa.RecordBatch]) -> Ranking:
    """The best rows of each anchor's label among the batches, the anchor's own among them."""
    a, label, cuts = anchors["points"], anchors["label"], anchors["cuts"]
    best = Ranking(len(label), POSITIVES + 1)
    for row, ids, labels, ints in _held(batches, anchors["width"]):
        b = Points(ints, anchors["rotation"], cuts)
        for k in np.intersect1d(label, labels):
            mine, theirs = np.flatnonzero(label == k), np.flatnonzero(labels == k)
            for piece in _pieces(len(mine), len(theirs)):
                rows = mine[piece]
                fresh = rows[np.isneginf(best.least[rows])]
                if len(fresh) and len(theirs) > best.most:  # the likely best give a bound for the others
                    near = np.argpartition(-(a.turned[fresh, : cuts[0]] @ b.turned[theirs, : cuts[0]].T), best.most, axis=1)[:, : best.most]
                    score = np.einsum("ij,ikj->ik", a.ints[fresh], b.ints[theirs[near]]) if near.size * ints.shape[1] <= 4 * PAIRS else np.array([b.ints[theirs[n]] @ v for n, v in zip(near, a.ints[fresh], strict=True)])
                    best.least[fresh] = score.min(axis=1)
                i, j, score = surviving(a, b, rows, theirs, best.least[rows], np.full(len(rows), np.inf), None, cuts)
                best.add(i, row[j], ids[j], score)
    return best


def negatives(anchors: dict, bands: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Ranking:
    """The best rows of other labels for each anchor and band of scores: groups are anchor * bands + band. bands:
    least and most scores by anchor and band, an empty band being one whose least is above its most."""
    a, label, cuts = anchors["points"], anchors["label"], anchors["cuts"]
    low, high = bands
    n, width = low.shape
    best = Ranking(n * width, NEGATIVES)
    some = np.flatnonzero((low <= high).any(axis=1))
    for row, ids, labels, ints in _held(batches, anchors["width"]):
        b = Points(ints, anchors["rotation"], cuts)
        every = np.arange(len(row))
        for piece in _pieces(len(some), len(row)):
            rows = some[piece]
            need = np.maximum(np.where(low[rows] <= high[rows], low[rows], np.inf), best.least.reshape(n, width)[rows]).min(axis=1)
            i, j, score = surviving(a, b, rows, every, need, np.where(low[rows] <= high[rows], high[rows], -np.inf).max(axis=1), label[rows, None] != labels[None, :], cuts)
            at, band = np.nonzero((low[i] <= score[:, None]) & (score[:, None] <= high[i]))
            best.add(i[at] * width + band, row[j[at]], ids[j[at]], score[at])
    return best


def _emitted(key: np.ndarray, best: Ranking, band: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    ids = pa.array(best.id, mask=best.id == _LAST)
    columns = [pa.array(key, pa.int64()), pa.array(best.row), ids, pa.array(best.score)]
    names = ["anchor", "row", "vec_id", "score"]
    if band is not None:
        columns, names = [*columns, pa.array(band, pa.int64())], [*names, "band"]
    yield from pa.table(columns, names=names).to_batches(50_000)


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def _rotation(rows: DataFrame, width: int) -> tuple[np.ndarray, list[int]]:
    """Orthonormal principal components as columns, and how many of them reach each of CUTS of the variance."""
    turn, share = np.eye(width), np.full(width, 1.0 / max(width, 1))
    if width > 1:
        filled = F.slice(F.concat("vector", F.array_repeat(F.lit(0).cast("long"), width)), 1, width)
        some = rows.select(array_to_vector(filled.cast("array<double>")).alias("v"))
        if rows.limit(2).count() == 2:
            model = PCA(k=width, inputCol="v", outputCol="w").fit(some)
            turn, share = np.linalg.qr(model.pc.toArray())[0], np.nan_to_num(model.explainedVariance.toArray())
    reached = np.cumsum(share)
    return turn, sorted({min(int(np.searchsorted(reached, c)) + 1, width) for c in CUTS} | {width})


def mine(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = embeddings.sparkSession
    vector = next(c for c in ("embedding", "vector") if c in embeddings.columns)
    changed = F.when(F.col("vec_id") % CHANGED == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    taken = embeddings.where(F.col("label").isNotNull() & F.col(vector).isNotNull())
    taken = taken.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), changed.alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = materialize(taken.mapInArrow(_prepared, "row long, vec_id long, label long, key binary, vector array<long>"), "vectors")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    facts = rows.agg(F.max(F.size("vector")).alias("width"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("square")).first()
    if facts["width"] is None:
        return empty
    if facts["square"] >= 2.0**62:
        raise OverflowError("scores of these vectors do not fit a long")
    width = max(facts["width"], 1)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("vec_id"), "row"))
    candidates = rows.withColumn("place", place).where(F.col("place") <= POSITIVES + 1)
    candidates = materialize(candidates.select("row", F.coalesce("vec_id", F.lit(_LAST)).alias("vec_id"), "label", "vector"), "candidates")
    rotation, cuts = _rotation(candidates, width)

    anchors = rows.where(F.col("vec_id") % EVERY == 0)
    block = max(1, BLOCK_BYTES // (16 * width))
    queries = anchors.groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"))
    queries = materialize(numbered(queries, ["key"], "number").withColumn("block", F.floor((F.col("number") - 1) / block)), "queries")
    path, n = scratch(spark, "negatives"), queries.agg(F.max("number")).first()[0] or 0
    for k in range(-(-n // block)):
        own = queries.where(F.col("block") == k).toArrow().combine_chunks().to_batches()[0]  # at most `block` vectors
        ints = _matrix(own["vector"], width, pa.int64())
        shared = spark.sparkContext.broadcast({"points": Points(ints, rotation, cuts), "label": own["label"].to_numpy(), "cuts": cuts, "rotation": rotation, "width": width})

        @lean
        def find_positives(batches):
            best = positives(shared.value, batches)  # noqa: B023
            yield from _emitted(best.group, best)

        first = _first(candidates.mapInArrow(find_positives, "anchor long, row long, vec_id long, score long"), ["anchor"], POSITIVES + 1).toArrow()  # six of each
        at, rank, score = (first[c].to_numpy() for c in ("anchor", "place", "score"))
        low, high = (f((own.num_rows, POSITIVES + 1), np.int64) for f in (np.ones, np.zeros))
        # the least and the greatest whole score of the band, without products that a long does not hold
        hundreds, units = np.divmod(score, 100)
        low[at, rank - 1], high[at, rank - 1] = LEAST * hundreds - (-LEAST * units // 100), MOST * hundreds + MOST * units // 100
        bands = spark.sparkContext.broadcast((low, high))

        @lean
        def find_negatives(batches):
            best = negatives(shared.value, bands.value, batches)  # noqa: B023
            yield from _emitted(best.group // (POSITIVES + 1), best, best.group % (POSITIVES + 1))

        found = _first(candidates.mapInArrow(find_negatives, "anchor long, row long, vec_id long, score long, band long"), ["anchor", "band"], NEGATIVES)
        listed = found.groupBy("anchor", "band").agg(F.sort_array(F.collect_list(F.struct("place", F.col("vec_id").alias("id"), "score"))).alias("negatives"))  # three of each
        # nothing is bound to the size of the table: a block's anchors have six positives each
        keys = pa.table({"anchor": at, "band": (rank - 1).astype(np.int64), "key": pc.take(own["key"], pa.array(at)), "row": first["row"], "id": first["vec_id"], "score": score})
        met = spark.createDataFrame(keys).join(listed, ["anchor", "band"], "left")
        # copies of the block's vectors take the answers one by one
        answers = met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("band", "row", "id", "score", "negatives"))).alias("positives"))
        answers.write.mode("append").parquet(path)
        shared.unpersist()
        bands.unpersist()
    if not n:
        return empty
    answers = spark.read.parquet(path)
    each = skew_join(anchors.select("key", "row", F.col("vec_id").alias("anchor_id")), answers, ["key"])
    chosen = F.slice(F.filter("positives", lambda p: p["row"] != F.col("row")), 1, POSITIVES)
    each = each.select("anchor_id", F.explode(chosen).alias("p"))
    each = each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode("p.negatives").alias("at", "n"))
    return each.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
