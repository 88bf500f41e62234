"""Repeated byte strings: Burrows-Wheeler transforms over anchored contexts, with threshold-bounded
interval expansion.

A byte goes if it lies in a string of `length` bytes that also starts elsewhere, in the same or another
document; strings are judged on the input.

Anchors. Every window of `length` bytes has an anchor, the leftmost of its least-hashed GRAM-byte
strings. Equal windows have equal anchors at equal offsets, so windows are compared within an anchor
only. Neighbouring windows with the same anchor make a run, whose bytes are the anchor's context.
Anchors that occur once hold no repeats and go first; only their hashes are counted. Equal contexts
are summed up before they meet, so a passage that very many documents share is one row per task.

Comparison. The distinct contexts of many anchors are concatenated and their Burrows-Wheeler transform is
taken. The sort doubles the bytes it tells apart, so it yields the intervals of all strings of its last length within
`length` (128 of 200). Starting from these, breadth-first backward extension visits the intervals of strings by
increasing length and sets each common-prefix value the first time an interval ends there; it stops at
`length`. What is still unset then is a common prefix of `length` or more, so exactly the neighbours in
suffix order whose windows are equal. Anchors with more than BLOCK contexts are dealt over blocks; the
distinct windows of those blocks then meet by their 128-bit digests, which are counted map-side. Anchors and
contexts with very many places are joined apart from the rest, so none of them gathers in a task.

Texts that hold a repeated anchor are the only ones that move; a filter of their digests finds them, whatever
their number. Long texts are hashed in segments.

Null and empty texts have no bytes. Copies of a whole text of at least `length` bytes lose everything;
the text is handled once. Repeated rows are such copies, and ids play no part. Extra columns are ignored;
an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import HEAVY, HEAVY_ROWS, chunks, heavy_of, lean, materialize, maybe_in, skew_join, small_batches, utf8, whole_groups

LENGTH = 200
GRAM = 64
#: Bytes of concatenated contexts in one transform, and contexts of an anchor in one block.
BUNDLE_BYTES = 1 << 20
BLOCK = 4000
#: Window starts of a text hashed at once, and bits that hold a place among them.
SEGMENT, PLACE_BITS = 2 << 20, 24
#: Bytes of short texts hashed together: few, so that their numbers stay in the processor's cache.
TEXTS_BYTES = 32 << 10
#: Rows of one batch that a text may give; bytes of a partition that shuffles to as many as there need to be.
ROWS, TASK_BYTES = 50_000, 256 << 20
_SEPARATOR = 0xFF  # never a byte of UTF-8
_ODD = 0x9E3779B97F4A7C15  # parts the places of a text


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k-byte string."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    W._grow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * W._powers[: len(data)], out=sums[1:])
    return W.mix((sums[k:] - sums[:-k]) * W._inverse[:n], 21)


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i, by minima over twice as many each time."""
    h = 1
    while 2 * h <= w:
        x = np.minimum(x[:-h], x[h:])
        h *= 2
    return np.minimum(x[: len(x) - (w - h)], x[w - h :])


def anchor_runs(data: np.ndarray, length: int = LENGTH, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash, first window start) of each run of windows; the runs follow each other. A run that comes to one of
    `begins` begins there anew."""
    hashes, starts, last = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], -1
    bits, windows = np.uint64(PLACE_BITS), len(data) - length + 1
    for a in range(0, windows, SEGMENT):
        h = gram_hashes(data[a : min(windows, a + SEGMENT) + length - 1], GRAM)
        # the hash's high bits, then the place: the least is the leftmost of the least
        at = (_sliding_least((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        new = np.concatenate([[at[0] + a != last], at[1:] != at[:-1]])
        if begins is not None:
            new[begins[(begins >= a) & (begins < a + len(at))] - a] = True
        first = np.flatnonzero(new)
        hashes.append(h[at[first]])
        starts.append(first + a)
        last = int(at[-1]) + a
    return np.concatenate(hashes), np.concatenate(starts)


def text_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, first and last window start in the row) of the runs of several texts, hashed together."""
    found = []
    for i, j in chunks(offsets, TEXTS_BYTES):
        begins, ends = offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
        h, s = anchor_runs(data[offsets[i] : offsets[j]], length, begins[ends - begins >= length])
        row = np.searchsorted(begins, s, side="right") - 1
        own = s + length <= ends[row]  # other windows lie in two texts
        row, h, s = row[own], h[own], s[own]
        to = np.append(s[1:], 0) - 1
        final = np.append(row[1:] != row[:-1], True)[: len(row)]
        to[: len(row)][final] = ends[row[final]] - length
        found.append((row + i, h, s - begins[row], to[: len(row)] - begins[row]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64))


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """t, and the runs as an array of anchor, first, to: the starts of their first and last windows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h, first, to = text_runs(*utf8(batch.column("text")), length)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(first), pa.array(to)], ["anchor", "first", "to"])
            yield pa.RecordBatch.from_arrays([batch.column("t").cast(pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), runs)], ["t", "runs"])

    return docs.where(F.octet_length("text") >= length).mapInArrow(run, "t binary, runs array<struct<anchor: long, first: long, to: long>>")


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def transform(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(suffixes in the order of more than their first `length` bytes, the byte before each), cyclic, and what the
    sort has told apart on its way: (the ranks at which strings of `known` bytes begin, known), known at most `length`."""
    n = len(text)
    wide = np.concatenate([text, text[:8]]) if n >= 8 else np.resize(text, n + 8)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | wide[j : j + n]
    order, h = np.argsort(key), 8
    rank = np.empty(n, np.int64)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])  # where a new rank starts in order
    first = np.flatnonzero(head)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    begins, known = np.zeros(1, np.int64), 0
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
    while True:
        if h <= length:
            begins, known = np.flatnonzero(head), h
        if h > length or not len(open_):
            break
        # only suffixes that share their rank are sorted on, each class within its own places
        these = order[open_]
        pair = rank[these] * n + rank[(these + h) % n]
        by = np.argsort(pair)
        these, pair = these[by], pair[by]
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        order[open_], head[open_] = these, fresh
        first = np.flatnonzero(fresh)
        sizes = np.diff(first, append=len(fresh))
        rank[these] = np.repeat(open_[first], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order, text[order - 1], begins, known


def bounded_prefixes(bwt: np.ndarray, length: int, begins: np.ndarray, known: int) -> np.ndarray:
    """True at i where the suffixes of rank i-1 and i share `length` bytes or more.

    Common prefixes are set by increasing value: the interval of a string of l + 1 bytes that ends
    before rank i, and is the first to do so, says that the common prefix at i is l. The intervals of all strings
    of `known` bytes, which begin at these ranks, are where it starts.
    """
    n = len(bwt)
    kind = np.int32 if n < 1 << 31 else np.int64
    back = np.empty(n, kind)  # where the suffix one byte longer ranks
    back[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=kind)
    unset = np.ones(n + 1, bool)
    unset[n] = False
    unset[begins] = False
    low, high = begins.astype(kind), (np.append(begins[1:], n) - 1).astype(kind)
    for _ in range(known, length):
        if not len(low):
            break
        sizes = high - low + 1
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1])
        place = np.arange(total, dtype=kind) + np.repeat((low - (ends - sizes)).astype(kind), sizes)
        owner = np.repeat(np.arange(len(low), dtype=kind), sizes)
        # ranks ascend with their places among suffixes after one byte, so sorting by that byte sorts them
        before = bwt[place]
        order = np.argsort(before, kind="stable")
        at, owner, before = back[place[order]], owner[order], before[order]
        cut = at[1:] != at[:-1] + 1
        cut |= owner[1:] != owner[:-1]
        cut |= before[1:] != before[:-1]
        where = np.flatnonzero(cut)
        low, high = at[np.concatenate([[0], where + 1])], at[np.concatenate([where, [total - 1]])]
        fresh = unset[high + 1]
        low, high = low[fresh], high[fresh]
        unset[high + 1] = False
    return unset[:n]


def repeated_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of all contexts, in their order: the context, the offset in it, whether repeated, and whether
    it is the first of its equals. Contexts are parted by a byte of their own."""
    text = np.append(np.insert(data, offsets[1:-1], _SEPARATOR), np.uint8(_SEPARATOR))
    sizes = np.diff(offsets)
    begins = offsets[:-1] + np.arange(len(sizes))
    order, bwt, *classes = transform(text, length)
    same = bounded_prefixes(bwt, length, *classes)
    again = same.copy()
    again[:-1] |= same[1:]
    by_place = np.zeros((2, len(text)), bool)
    by_place[0, order], by_place[1, order] = again, ~same
    windows = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(sizes)), windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    return which, offset, *by_place[:, begins[which] + offset]


_FOUND = "anchor long, digest binary, first int, last int, open boolean, window binary"


@lean
def compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeats of contexts sorted by group: rows (anchor, digest, first, last); with open, a window of an
    anchor in several blocks, to be looked for in the others."""
    bundle: list[pa.Table] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(bundle).combine_chunks()
        bundle.clear()
        data, offsets = utf8(rows.column("context"))
        which, offset, again, leads = repeated_windows(data, offsets, length)
        several, hot = rows.column("several").to_numpy(), rows.column("blocks").to_numpy() > 1
        own = np.flatnonzero(again & ~several[which])
        if len(own):
            cut = np.flatnonzero((np.diff(which[own]) != 0) | (np.diff(offset[own]) != 1))
            a, b = own[np.concatenate([[0], cut + 1])], own[np.concatenate([cut, [len(own) - 1]])]
            yield _found(rows, which[a], offset[a], offset[b])
        # one of equal windows stands for all of its block; sure repeats only show others theirs
        shown = np.flatnonzero(leads & hot[which])
        for k in range(0, len(shown), ROWS):
            w, x = which[shown[k : k + ROWS]], offset[shown[k : k + ROWS]]
            yield _found(rows, w, x, x, [_digest(data[i : i + length]) for i in (offsets[w] + x).tolist()])

    for rows in whole_groups(batches, "group"):
        several = np.flatnonzero(rows.column("several").to_numpy())
        sizes = pc.binary_length(rows.column("context")).to_numpy().astype(np.int64)
        if len(several):  # equal contexts in several places: all windows repeat
            yield _found(rows, several, np.zeros(len(several), np.int64), sizes[several] - length)
        # A context of one place may repeat parts of its group's others; those of several places have nothing to learn.
        group, blocks = rows.column("group").to_numpy(), rows.column("blocks").to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        counts = np.diff(begins, append=len(group))
        single = np.add.reduceat((~rows.column("several").to_numpy()).astype(np.int64), begins)
        met = np.flatnonzero(np.repeat((counts > 1) & (single > 0), counts) | (blocks > 1))
        if len(met):
            bundle.append(rows.take(pa.array(met)))
            size += int(sizes[met].sum())
        if size >= BUNDLE_BYTES:
            yield from flush()
            size = 0
    if bundle:
        yield from flush()


def _found(rows: pa.Table, which: np.ndarray, first: np.ndarray, last: np.ndarray, windows: list[bytes] | None = None) -> pa.RecordBatch:
    n, which = len(which), pa.array(which)
    columns = [rows.column(c).combine_chunks().take(which) for c in ("anchor", "digest")]
    columns += [pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array([windows is not None] * n, pa.bool_()), pa.array(windows or [None] * n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _FOUND.split(", ")])


def _texts_and_runs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, Iterator[tuple[int, int, int]]]]:
    """(t, text, its runs (first, to, anchor)) of each row."""
    data, offsets = utf8(batch.column("text"))
    runs = batch.column("runs")
    bounds = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy())]).tolist()
    first, to, anchor = (runs.flatten().field(c).to_pylist() for c in ("first", "to", "anchor"))
    for i, t in enumerate(batch.column("t").to_pylist()):
        own = slice(bounds[i], bounds[i + 1])
        yield t, data[offsets[i] : offsets[i + 1]].tobytes(), zip(first[own], to[own], anchor[own], strict=True)


def spans(covers: pa.ListArray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the maximal runs of bytes that each row's hits cover, by place in the data of all rows."""
    places = covers.flatten()
    hits = places.field("hits")
    lengths, each = hits.value_lengths().to_numpy(), hits.flatten()
    row = np.repeat(np.repeat(np.arange(len(covers)), covers.value_lengths().to_numpy()), lengths)
    at = np.repeat(places.field("at").to_numpy(), lengths) + offsets[row] + row  # a byte between rows keeps their runs apart
    a, b = at + each.field("first").to_numpy(), at + each.field("last").to_numpy() + length
    order = np.argsort(a, kind="stable")
    row, a, b = row[order], a[order], np.maximum.accumulate(b[order])
    fresh = np.concatenate([[True], a[1:] > b[:-1]])[: len(a)]
    row, a, b = row[fresh], a[fresh], b[np.append(fresh[1:], True)[: len(a)]]
    return row, a - row, b - row


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    keyed = keyed.withColumn("t", F.substring(F.unhex("sha"), 1, 16))
    described = materialize(keyed.select("doc_id", "t", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    runs = materialize(anchors(keyed.select("t", "text"), length), "anchors")
    each = runs.select("t", F.inline("runs"))
    # Copies of a whole text have equal t: an anchor counts if it has two places in distinct texts.
    place = F.xxhash64("t", "first")
    again = materialize(each.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b").select("anchor", "n"), "again")
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    flagged = skew_join(each, again.select("anchor"), ["anchor"], "left_semi", hot=heavy_of(again, total, ["anchor"]))
    flagged = materialize(flagged.groupBy("t").agg(F.collect_set(F.struct("first", "to", "anchor")).alias("runs")), "flagged")
    maybe = maybe_in(spark, flagged.select(F.xxhash64("t")))
    wanted = keyed.select("t", "text").where(maybe(F.xxhash64("t")))
    texts = materialize(wanted.groupBy("t").agg(F.first("text").alias("text")).join(flagged, "t"), "wanted")

    @lean
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list] = {}  # equal contexts have equal anchors
            for t, raw, own in _texts_and_runs(batch):
                salt = int.from_bytes(t[:8], "little")
                for first, to, anchor in own:
                    c = raw[first : to + length]
                    here = ((salt + first * _ODD) & (1 << 64) - 1) - (1 << 63)
                    x = seen.get(d := _digest(c))
                    if x is None:
                        seen[d] = [anchor, c, here, here, 1]
                    else:
                        x[2], x[3], x[4] = min(x[2], here), max(x[3], here), x[4] + 1
                    if len(seen) >= ROWS:
                        yield _contexts(seen)
                        seen = {}
            yield _contexts(seen)

    def _contexts(seen: dict[bytes, list]) -> pa.RecordBatch:
        anchor, context, a, b, n = zip(*seen.values(), strict=True) if seen else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, ty) for c, ty in ((anchor, pa.int64()), (list(seen), pa.binary()), (context, pa.binary()), (a, pa.int64()), (b, pa.int64()), (n, pa.int64()))], ["anchor", "digest", "context", "a", "b", "n"]
        )

    distinct = texts.mapInArrow(contexts, "anchor long, digest binary, context binary, a long, b long, n long").groupBy("anchor", "digest")
    distinct = materialize(distinct.agg(F.first("context").alias("context"), (F.min("a") != F.max("b")).alias("several"), F.sum("n").alias("n")), "contexts")
    n_contexts, n_places, n_bytes = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("context")), F.lit(0))).first()
    often = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > min(BLOCK, max(HEAVY_ROWS, n_contexts // HEAVY))), "often")
    blocks = often.where(F.col("n") > BLOCK).select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = skew_join(distinct.drop("n"), blocks, ["anchor"], "left", hot=heavy_of(often, n_contexts, ["anchor"])).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("group", F.xxhash64("anchor", F.pmod(F.xxhash64("digest"), "blocks")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))
    found = dealt.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(lambda b: compare(b, length), _FOUND)
    found = materialize(found, "found")
    across = found.where("open").groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
    more = found.where("open").join(across, ["anchor", "window"], "left_semi")  # as many rows a key as blocks
    hits = found.where("not open").select("anchor", "digest", "first", "last").unionByName(more.select("anchor", "digest", "first", "last"))
    hits = hits.groupBy("anchor", "digest").agg(F.collect_list(F.struct("first", "last")).alias("hits"))  # of one context

    @lean
    def origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t, raw, own in _texts_and_runs(batch):
                rows += [(t, first, anchor, _digest(raw[first : to + length])) for first, to, anchor in own]
                if len(rows) >= ROWS:
                    yield _origins(rows)
                    rows = []
            yield _origins(rows)

    def _origins(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["t", "at", "anchor", "digest"])

    placed = texts.mapInArrow(origins, "t binary, at long, anchor long, digest binary")
    covers = skew_join(placed, materialize(hits, "hits"), ["anchor", "digest"], hot=heavy_of(distinct, n_places, ["anchor", "digest"]))
    covers = covers.groupBy("t").agg(F.collect_list(F.struct("at", "hits")).alias("covers"))  # of one text

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column("text"))
            row, a, b = spans(batch.column("covers"), offsets, length)
            removed = np.zeros(batch.num_rows, np.int64)
            np.add.at(removed, row, b - a)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            a, b, sums = a.tolist(), b.tolist(), []
            for i, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                kept = hashlib.sha256()
                for k in range(bounds[i], bounds[i + 1]):
                    kept.update(data[at : a[k]])
                    at = b[k]
                kept.update(data[at:end])
                sums.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("t").cast(pa.binary()), pa.array(removed), pa.array(np.diff(bounds)), pa.array(sums, pa.string())], ["t", "removed", "spans", "kept"])

    shortened = texts.select("t", "text").join(covers, "t").mapInArrow(cut, "t binary, removed long, spans long, kept string")
    copies = materialize(described.groupBy("t").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    known = copies.withColumnRenamed("n", "copies").join(shortened, "t", "full").select("t", "copies", "removed", "spans", "kept")
    # A text with very many copies is joined apart from the others.
    final = skew_join(described, known, ["t"], "left", hot=heavy_of(copies, copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], ["t"]))
    whole = (F.col("n_bytes") >= length) & F.col("copies").isNotNull()
    return final.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
