"""Best-fit packing: pattern packing by non-negative least squares over the histogram of lengths.

A document's ids are its text's by a byte-level BPE, then `END`. Documents over `capacity` ids are cut
so that every piece but the first is full. Pieces of equal length are interchangeable, so a packing is
planned on the histogram (at most `capacity` numbers, whatever the corpus):
  1. enumerate patterns of one to three lengths that fill a sequence exactly;
  2. fit their repeat counts to the histogram by non-negative least squares (cyclic coordinate descent);
  3. round a share of them down, never using more pieces than there are;
  4. pack what is left best-fit, longest first, again on counts.
Rounding all of the counts may leave a remainder of awkward lengths, so steps 3 and 4 are done for the SHARES
below, and the plan of fewest sequences is taken; at least half of what was fitted is in it.
The plan says, for each length, which run of its pieces goes to which sequences at which offset. A
piece's place in that order is its rank within its input task plus the counts of the tasks before, so
no window runs over all pieces of a length. Pieces are written once to the shared folder; ranks thus
stay what they were when tasks run again.

Null and empty texts are the lone END. Repeated rows are packed each by itself. Extra columns are
ignored; an empty table gives an empty result. Texts are tokenised whole.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches

CAPACITY = 2048
END = 0
#: Word pieces remembered by one worker.
CACHE_ENTRIES = 600_000
#: Shares of the fitted repeats that are rounded down and kept; the rest is packed best-fit.
SHARES = (1.0, 0.97, 0.93, 0.87, 0.8, 0.7, 0.6, 0.5)
#: Rows (task, length, rank) that may be held by every task, 24 bytes each; more are joined by shuffle.
BROADCAST_ROWS = 500_000

# White space followed by other characters: where one ends, the tokenizer's own pattern also ends a piece.
_UNIT = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
# White space beyond those four, or the special token: such a part goes to the tokenizer as a whole.
_ODD = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]|<\\|endoftext\\|>")


#: Characters of a text that are encoded at once, or some more where it cannot be cut.
PART = 1 << 16
#: After other characters, a blank or a line's end begins a piece of the tokenizer's own pattern, whatever follows. No token
#: that is told apart beforehand has white space in it.
_CUT = re.compile(r"(?<=\S)[ \n]")


def parts_of(text: str) -> Iterator[str]:
    """The text in parts that may be encoded one by one."""
    a = 0
    while len(text) - a > PART:
        found = _CUT.search(text, a + PART)
        if not found:
            break
        yield text[a : found.start()]
        a = found.start()
    yield text[a:]


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes; remembers the pieces it has seen."""

    def __init__(self, tokenizer: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.known: dict[str, bytes] = {}
        self.ordinary = None
        if ranks:  # the same vocabulary in a form that encodes short pieces faster
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def _ids(self, text: str) -> bytes:
        ids = array("I", self.ordinary(text) if self.ordinary else self.whole.encode(text, add_special_tokens=False).ids)
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        return self._part(text) if len(text) <= PART else b"".join(map(self._part, parts_of(text)))

    def _part(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        units, known = _UNIT.findall(text), self.known
        try:
            return b"".join([known[u] for u in units])
        except KeyError:
            for u in units:
                if u not in known:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                        return b"".join([known[x] if x in known else known.setdefault(x, self._ids(x)) for x in units])
                    known[u] = self._ids(u)
            return b"".join([known[u] for u in units])


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(tokenizer: str, ranks: str | None) -> Encoder:
    """One per process and vocabulary."""
    if (tokenizer, ranks) not in _encoders:
        _encoders[tokenizer, ranks] = Encoder(tokenizer, ranks)
    return _encoders[tokenizer, ranks]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first may be shorter."""
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def tokenize(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, the input task, the rank
    among that task's pieces of this length, and with keep_ids the ids themselves."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * keep_ids

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer, ranks), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids_out: list[bytes] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = enc.encode(text.as_py() or "") + end
                for piece, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    own = raw[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), task, seen[length]))
                    seen[length] += 1
                    if keep_ids:
                        ids_out.append(own)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()], strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids_out, pa.binary())] if keep_ids else []), names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + (", ids binary" if keep_ids else ""))


def patterns(capacity: int, step: int) -> list[tuple[int, ...]]:
    """Lengths that fill a sequence: all pairs, and triples with one part a multiple of `step`."""
    out: list[tuple[int, ...]] = [(capacity,)]
    out += [(a, capacity - a) for a in range((capacity + 1) // 2, capacity)]
    for b in range(step, capacity, step):
        rest = capacity - b
        out += [(a, rest - a, b) for a in range((rest + 1) // 2, rest)]
    return list(dict.fromkeys(tuple(sorted(p, reverse=True)) for p in out))


def fit_counts(histogram: np.ndarray, found: list[tuple[int, ...]], sweeps: int = 25) -> np.ndarray:
    """x >= 0 that makes the patterns' lengths come close to the histogram, in least squares."""
    left = histogram.astype(float).tolist()
    uses = [[(k, float(p.count(k))) for k in set(p)] for p in found]
    norms = [sum(c * c for _, c in u) for u in uses]
    x = [0.0] * len(found)
    live = [i for i, u in enumerate(uses) if all(left[k] > 0 for k, _ in u)]
    for _ in range(sweeps):
        moved = 0.0
        for i in live:
            step = max(-x[i], sum(c * left[k] for k, c in uses[i]) / norms[i])
            if step:
                x[i] += step
                moved += abs(step)
                for k, c in uses[i]:
                    left[k] -= c * step
        if moved <= 1e-3 * (1 + histogram.sum()):
            break
    return np.array(x)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): pieces longest first, each into the fullest sequence that takes it, on counts."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms = 0  # bit r: some sequence has r ids free
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        nonlocal rooms
        if not n:
            return
        if room:
            open_[room].append((pattern, n))
            rooms |= 1 << room
        else:
            closed.append((pattern, n))

    for length in range(capacity, 0, -1):
        c = int(left[length])
        while c:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                pattern, n = open_[room].pop()
                if not open_[room]:
                    rooms &= ~(1 << room)
                m = min(c, n)
                put(pattern, n - m, room)
                put((*pattern, length), m, room - length)
                c -= m
            else:
                per = capacity // length
                put((length,) * per, c // per, capacity - per * length)
                put((length,) * (c % per), int(c % per > 0), capacity - c % per * length)
                c = 0
    return closed + [x for group in open_.values() for x in group]


def plan(histogram: np.ndarray, capacity: int = CAPACITY, step: int = 128) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up the histogram (indexed by length) exactly."""
    found = patterns(capacity, step)
    fitted = fit_counts(histogram, found)
    plans = [_rounded(histogram, capacity, found, share * fitted) for share in SHARES]
    return min(plans, key=lambda q: sum(n for _, n in q))


def _rounded(histogram: np.ndarray, capacity: int, found: list[tuple[int, ...]], counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """A plan of the patterns' counts rounded down, and the rest of the histogram packed best-fit."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    whole = np.floor(counts + 1e-9).astype(np.int64)
    for i in np.flatnonzero(whole).tolist():
        p = found[i]
        n = min(int(whole[i]), *(int(left[k]) // p.count(k) for k in p))
        if n > 0:
            for k in p:
                left[k] -= n
            out.append((p, n))
    return out + _best_fit(left, capacity)


def runs(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run (ascending), its first sequence, its offset."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, n in packed:
        offset = 0
        for k in lengths:
            out[k].append((used[k], sequence, offset))
            used[k] += n
            offset += k
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) as pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = materialize(tokenize(docs, tokenizer, ranks, capacity, keep_ids), "pieces")
    by_task = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    where = docs.sparkSession.sparkContext.broadcast(runs(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if by_task.count() <= BROADCAST_ROWS else base.hint("merge")
    ranked = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                mine = length == k
                first, sequences, offsets = where.value[k]
                at = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = sequences[at] + rank[mine] - first[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(sequence), pa.array(offset), *([batch.column("ids")] if keep_ids else [])], names)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if keep_ids else ""))
