"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

Sketch. A document's set has hashed bins filled in rounds: in round i < BINS every shingle falls into a
hashed bin, in the next BINS rounds all of them go to bin i - BINS, and a bin keeps the least hash of
the first round that reached it. So every bin of every non-empty set is filled, and each agrees
between two sets with a probability of about their similarity, concentrated as with independent hashes.

Candidates. Equal sets are one class and go on as the member with the least id. A band is ROWS
neighbouring bins; classes that agree in a band meet in a bucket. A pair misses all 40 bands of 5 with a
probability of 1.3e-7 at similarity 0.8, of 6.5e-11 at 0.85. Within a bucket, classes whose sketches agree
in at least `threshold - SLACK` of the bins are joined to candidate clusters. Independent bins fall below
that with a probability of 1e-11 at 0.8 and 3e-12 at 0.85, so the bands' loss is the whole.

Verification. Clusters fetch their members' full sets, and exact intersections find the true links and so
the components.

Groups, that is buckets and clusters, are searched breadth-first, and of each connected part the edges to its
least member leave the group. A group beyond a bound is dealt into blocks. First each block is searched
along with a few pivots, the same in all of its blocks, so that what is alike throughout the group becomes one
component by way of them. Then every member that is not in the group's largest component meets
every block, and is compared with all members of other components. So nothing is compared twice that is
known to be joined, a group of n alike members is dealt about once, and no pair is dropped for size.
Members meet their group's bound and component by joins that take heavy keys apart.

Full sets are made of texts that a filter of the clusters' ids lets pass, whatever their number.

A set holds the distinct 5-word shingles of the text with A-Z lower-cased, words being runs of bytes
other than space and 0x09-0x0D; with fewer words the whole sequence is one shingle. Shingles are known by
64-bit hashes, so two different ones of a pair of sets agree with a probability of their number over 2^64. Null and empty texts
have empty sets: they link with nothing and are kept. Null ids stay by themselves and are kept;
repeated rows of one id share its class. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Bloom, chunks, connected_components, heavy_of, lean, materialize, skew_join, small_batches, sorted_groups, utf8, without

SHINGLE_WORDS = 5
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: How far below the threshold an estimate may lie: seven standard deviations of BINS bins.
SLACK = 0.2
#: Bounds of one block: classes of a bucket, shingles of a cluster (and SET_COST for each set).
BUCKET_BLOCK = 250
CLUSTER_BLOCK, SET_COST = 60_000, 200
#: Members of a large group that all of its blocks see.
PIVOTS = 8
#: Shingles sketched at once.
PART = 1 << 20
#: Bytes of a partition that shuffles to as many as there need to be.
TASK_BYTES = 256 << 20


def text_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words, first = W.word_hashes(data, offsets)
    grams, bounds = W.shingles(words, first, k)
    del words
    if len(bounds) == 2 and len(grams):  # one row: sorted where it is
        grams.sort()
        return [grams[np.concatenate([[True], grams[1:] != grams[:-1]])]]
    return [np.unique(grams[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """rows x bins of 16-bit values; rows of empty sets are zero."""
    n = len(sets)
    flat = sets[0] if n == 1 else np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    best = np.full(n * bins, 0xFFFFFFFF, np.uint32)
    filled = np.zeros(n * bins, bool)
    missing = np.full(n, bins)
    for i in range(2 * bins):
        if not len(flat):
            break
        new = np.zeros(n * bins, bool)
        for a in range(0, len(flat), PART):  # of many shingles, some at a time
            h, of = W.mix(flat[a : a + PART], 1000 + i), row[a : a + PART].astype(np.int64)
            slot = of * bins + ((h & np.uint64(0xFFFFFFFF)) % np.uint64(bins)).astype(np.int64) if i < bins else of * bins + (i - bins)
            free = ~filled[slot]
            slot = slot[free]
            np.minimum.at(best, slot, (h[free] >> np.uint64(32)).astype(np.uint32))
            new[slot] = True
        filled |= new
        missing -= np.bincount(np.flatnonzero(new) // bins, minlength=n)
        if not missing.any():
            break
        open_ = missing[row] > 0
        flat, row = flat[open_], row[open_]
    # mixed again: the least of many values has few high bits left
    return np.where(filled, W.mix(best.astype(np.uint64), 3) & np.uint64(0xFFFF), np.uint64(0)).astype(np.uint16).reshape(n, bins)


def _set_digest(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    n = np.uint64(len(s))
    a, b = W.mix(s, 11), W.mix(s, 12)
    return np.array([a.sum(dtype=np.uint64) + n, np.bitwise_xor.reduce(b) ^ W.mix(np.array([n]), 5)[0] if len(s) else 0], np.uint64).tobytes()


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set and, where it is not empty, sketch."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                sets = text_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_digest(s) for s in sets], pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(rows, sets, strict=True)], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary")


def _forest(n: int, near) -> list[np.ndarray]:
    """Connected parts of two members or more of a graph whose edges near(i, candidates) tells, breadth first."""
    left = np.arange(n)
    out = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        part = list(queue)
        while queue and len(left):
            hit = near(queue.pop(), left)
            found = left[hit].tolist()
            part += found
            queue += found
            left = left[~hit]
        if len(part) > 1:
            out.append(np.array(part))
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def _within(nearness):
    """A task over groups sorted by `task`: edges of a forest of each."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for group in sorted_groups(batches, "task"):
            if group.num_rows > 1:
                ids = group.column("doc_id").to_numpy()
                for part in _forest(len(ids), nearness(group.column("payload").to_pylist())):
                    own = np.unique(ids[part]).tolist()  # joined to the least: equal parts of other groups give equal edges
                    pairs += [(own[0], x) for x in own[1:]]
            if len(pairs) >= 10_000:
                yield _edges(pairs)
                pairs = []
        yield _edges(pairs)

    return run


def _across(nearness):
    """A task over groups sorted by `task`: edges from each member that is `odd` to one member of every other label
    that it is near to."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "task"):
            ids, odd, label = (group.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "odd", "label"))
            near, pairs = nearness(group.column("payload").to_pylist()), []
            for i in np.flatnonzero(odd).tolist():
                others = np.flatnonzero(label != label[i])
                hit = others[near(i, others)] if len(others) else others
                pairs += [(int(ids[i]), int(ids[hit[k]])) for k in np.unique(label[hit], return_index=True)[1].tolist()]
            yield _edges(pairs)

    return run


def links(members: DataFrame, limit: int, unit: int, nearness, payload) -> DataFrame:
    """Edges (a, b) that join what is near within groups of members(doc_id, group, weight): a forest of each.
    payload(ids) gives (doc_id, payload) of the ids (doc_id), of about `unit` bytes for each unit of weight, and
    nearness(payloads) a function (i, candidates)."""
    sizes = materialize(members.groupBy("group").agg(F.count("*").alias("n"), F.sum("weight").alias("total")).where("n > 1"), "sizes")
    rows, weight = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-weight * unit // TASK_BYTES))
    hot = heavy_of(sizes, rows, ["group"])
    sized = skew_join(members.select("doc_id", "group", "weight"), sizes.select("group", F.ceil(F.col("total") / limit).cast("int").alias("blocks")), ["group"], hot=hot)
    sized = materialize(sized.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")), "members")
    large = sized.where("blocks > 1")
    pivots = large.groupBy("group", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PIVOTS)).alias("p")).agg(F.min("doc_id").alias("doc_id"), F.first("blocks").alias("blocks"))
    dealt = sized.select("doc_id", "group", "block").unionByName(pivots.select("doc_id", "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    dealt = dealt.select("doc_id", F.xxhash64("group", "block").alias("task"))
    found = _dealt(dealt, sized, payload, tasks).mapInArrow(_within(nearness), "a long, b long").distinct()
    if large.isEmpty():
        return found
    found = materialize(found, "links")
    joined = connected_components(found).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    named = materialize(large.join(joined, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "named")
    counts = named.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    most = counts.groupBy("group").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("w").alias("w"), F.max(F.struct("n", "label", "w"))["w"].alias("of_top"))
    # groups with members outside their largest component, and into how many blocks those fall
    most = most.where("w > of_top").select("group", F.col("top.label").alias("top"), F.ceil((F.col("w") - F.col("of_top")) / limit).cast("int").alias("odd_blocks"))
    most = materialize(most, "most")
    if most.isEmpty():
        return found
    named = skew_join(named, most, ["group"], hot=hot)
    own = F.pmod(F.xxhash64("doc_id", F.lit(9)), "odd_blocks").cast("int")
    odd = named.where("label <> top").withColumn("odd_block", own).select("doc_id", "group", "label", "odd_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("odd"))
    every = named.select("doc_id", "group", "label", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)).alias("odd_block"), "block", F.lit(False).alias("odd"))
    met = materialize(odd.unionByName(every).select("doc_id", "label", "odd", F.xxhash64("group", "odd_block", "block").alias("task")), "met")
    return found.unionByName(_dealt(met, met, payload, tasks).mapInArrow(_across(nearness), "a long, b long"))


def _dealt(dealt: DataFrame, ids: DataFrame, payload, tasks: int) -> DataFrame:
    """dealt(doc_id, task) with payloads, one task's rows together."""
    return dealt.join(payload(ids.select("doc_id").distinct()), "doc_id").repartition(tasks, "task").sortWithinPartitions("task", "doc_id")


def candidate_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """Forest edges (a, b) within buckets of classes(doc_id, sketch) whose sketches agree enough."""
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sketch", b * 2 * ROWS + 1, F.lit(2 * ROWS)))))
    members = classes.select("doc_id", bands.alias("group"), F.lit(1).alias("weight"))
    need = int(np.ceil((threshold - SLACK) * BINS))

    def nearness(payloads: list[bytes]):
        s = np.frombuffer(b"".join(payloads), np.uint16).reshape(-1, BINS)
        return lambda i, c: (s[c] == s[i]).sum(axis=1) >= need

    return links(members, BUCKET_BLOCK, 2 * BINS, nearness, lambda ids: classes.select("doc_id", F.col("sketch").alias("payload")))


def exact_nearness(threshold: float):
    percent = round(threshold * 1000)

    def nearness(payloads: list[bytes]):
        own = [np.frombuffer(x, np.uint64) for x in payloads]
        lengths = np.array([len(x) for x in own])
        flat = np.unique(np.concatenate(own), return_inverse=True)[1].astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        mark = np.zeros(flat.max(initial=0) + 2, bool)

        def near(i: int, c: np.ndarray) -> np.ndarray:
            fits = 1000 * np.minimum(lengths[c], lengths[i]) >= percent * np.maximum(lengths[c], lengths[i])
            out = np.zeros(len(c), bool)
            if not fits.any():
                return out
            mine = flat[bounds[i] : bounds[i + 1]]
            mark[mine] = True
            some = c[fits]
            at = np.repeat(bounds[some], lengths[some]) + np.arange(lengths[some].sum()) - np.repeat(np.cumsum(lengths[some]) - lengths[some], lengths[some])
            both = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(lengths[some]) - lengths[some])
            mark[mine] = False
            out[fits] = 1000 * both >= percent * (lengths[some] + lengths[i] - both)
            return out

        return near

    return nearness


def verified_links(docs: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) of exactly verified links within clusters(doc_id, cluster, n_shingles)."""
    spark = docs.sparkSession

    def sets(ids: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(Bloom(ids.select(F.xxhash64("doc_id"))))  # at most 32 MB

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = shared.value.maybe(batch.column("h").to_numpy())
                if not hit.any():
                    continue
                batch = batch.filter(pa.array(hit))
                data, offsets = utf8(batch.column("text"))
                for i, j in chunks(offsets):
                    own = text_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    rows = pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array([s.tobytes() for s in own], pa.binary())], ["doc_id", "payload"])
                    yield rows.filter(pa.array([len(s) > 0 for s in own]))  # an id's other row may be empty

        return docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "doc_id long, payload binary")

    members = clusters.select("doc_id", F.col("cluster").alias("group"), (F.col("n_shingles") + SET_COST).alias("weight"))
    return links(members, CLUSTER_BLOCK, 8, exact_nearness(threshold), sets)


def components(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_shingles, component_id (the least id reachable), kept."""
    small_batches(docs.sparkSession)
    described = materialize(describe(docs), "sketches")
    # Equal sets meet at once; the sketch is the same for all of them.
    classes = materialize(
        described.where("sketch is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")), "classes"
    )
    near = connected_components(candidate_pairs(classes, threshold))
    clusters = near.join(classes.select(F.col("doc_id").alias("node"), "n_shingles"), "node").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "n_shingles")
    linked = connected_components(verified_links(docs, materialize(clusters, "clusters"), threshold))
    of_class = classes.join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    # A set that very many documents share is joined apart from the others.
    found = skew_join(described.select("doc_id", "n_shingles", "digest"), of_class, ["digest"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, with all columns, whose document is the one of its group that stays. A document is
    an id with a text: of rows with one id and one text one stays, rows of one id with different texts
    are judged apart, the least text's digest first. Rows without an id stay."""
    own = docs.where("doc_id is not null")
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = materialize(components(docs, threshold).where("not kept").select("doc_id"), "gone")
        return without(docs, gone, doc_id=F.col("doc_id"))
    # Each pair of id and text gets a number of its own, in order of the ids.
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))
    numbered = own.groupBy(F.col("doc_id").alias("_id"), digest.alias("_digest")).agg(F.count("*").alias("_rows")).orderBy("_id", "_digest").withColumn("_node", F.monotonically_increasing_id())
    numbered = materialize(numbered, "nodes")
    named = materialize(docs.join(numbered, (F.col("doc_id") == F.col("_id")) & (digest == F.col("_digest")), "left").select(*(docs[c] for c in docs.columns), "_node", "_rows"), "named")
    gone = materialize(components(named.select(F.col("_node").alias("doc_id"), "text"), threshold).where("not kept").select(F.col("doc_id").alias("_node")), "gone")
    left = without(named, gone, _node=F.col("_node"))
    once = left.where("_rows > 1").dropDuplicates(["_node"])
    return left.where("_rows is null or _rows = 1").unionByName(once).select(*docs.columns)
