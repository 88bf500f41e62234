"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two neighbouring blocks of HALF words. Terms are the lower-cased words of the
benchmark that at most STOP of all blocks hold, and each item's rarest words, weighted by tf-idf with document frequencies counted over
all blocks of all documents.

1. A randomised singular value decomposition of the block-by-term matrix: each task multiplies its blocks
   with a random test matrix and back, the sums give a basis, and a second sweep gives the Gram matrix
   in it, whose eigenvectors are the singular vectors. The benchmark's own items are rows too, with as
   much weight in all as the corpus. Only terms x RANK numbers reach the driver, bounded by the
   benchmark.
2. Every passage of every document is folded in and compared by cosine to every item, and to each
   passage of 2 * HALF words, HALF apart, of a longer item; pairs of at least COSINE are candidates.
3. A candidate's region is read as words: the longest common subsequence with the item has to reach
   LCS_SURE of the item's words, or LCS_LEAST together with ANSWER of the words of the item's answer (what
   follows its last question mark, else its last sentence). Candidates that have fewer than LCS_LEAST of
   the item's words in any order cannot reach it and are left out before; that loses none.

The cosine given is the largest of the item and its passages at the best region.

The benchmark is the stated query set; it is taken in parts of ITEMS, each with its own terms and
decomposition. The documents are read once to count the terms of all parts, once to write down where the rare
ones are, from which every part is decomposed, and once for each GROUP of parts to search, so what a
task holds is bounded.

Items of fewer than MIN_WORDS words are matched by their exact sequence of words, and have no cosine. Null and
empty texts match nothing, nor do items without words. A null id is reported as
null. Repeated rows give repeated results; extra columns are ignored; an empty table on either side gives
an empty result. Texts are read whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, materialize, small_batches, utf8
from .quality_rules import lower_words

HALF = 24
STOP = 0.005
#: Each item keeps so many of its rarest words as terms, however common they are.
RAREST = 8
RANK = 192
ITEMS, GROUP = 1000, 8
COSINE = 0.40
MIN_WORDS = 5
LCS_SURE, LCS_LEAST, ANSWER = 0.75, 0.55, 0.5
_SEED = 7
_TERMS = 256  # in one row of a distributed sum
_WORDS = 1 << 20  # of candidates' regions looked up at once


class Item:
    """A benchmark item as hashed words; the answer's words as bits."""

    def __init__(self, item_id: int, text: str):
        self.item_id = item_id
        at = text.rfind("?")
        if at < 0 or not text[at + 1 :].strip():
            at = max(text.rstrip(" .!?\n").rfind(x) for x in (". ", "! ", "? ", "\n", ".\n"))
        split = text[: at + 1], text[at + 1 :]
        head, tail = (lower_words(*utf8(pa.array([x])))[0] for x in split)
        self.words = np.concatenate([head, tail])
        self.bits: dict[int, int] = {}
        for i, w in enumerate(self.words.tolist()):
            self.bits[w] = self.bits.get(w, 0) | 1 << i
        self.full = (1 << len(self.words)) - 1
        self.answer = self.full & ~((1 << len(head)) - 1)

    def common(self, words: list[int]) -> tuple[float, float]:
        """Shares of the item's and of its answer's words in a longest common subsequence with words."""
        v, bits, full = self.full, self.bits, self.full
        for w in words:
            if m := bits.get(w):
                u = v & m
                v = ((v + u) | (v - u)) & full
        hit = full & ~v
        return hit.bit_count() / max(1, full.bit_count()), (hit & self.answer).bit_count() / max(1, self.answer.bit_count())


class Terms:
    """Sorted term hashes, with a table that turns most other words away at once."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << 20, bool)
        self.table[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of the words that are terms."""
        at = np.flatnonzero(self.table[(words >> np.uint64(44)).astype(np.int64)])
        term = np.searchsorted(self.hashes, words[at])
        ok = term < len(self.hashes)
        ok[ok] = self.hashes[term[ok]] == words[at[ok]]
        return at[ok], term[ok]


def _blocks(first: np.ndarray) -> np.ndarray:
    """Number of blocks before each row (n+1), from the n+1 bounds of its words."""
    return np.concatenate([[0], np.cumsum(-(-np.diff(first) // HALF))])


def _block_of(places: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    row = np.searchsorted(first, places, side="right") - 1
    return before[row] + (places - first[row]) // HALF


def _sum_rows(parts: DataFrame, width: int, rows: int) -> np.ndarray:
    """The sum of arrays that tasks hand over in pieces (at, salt, values); rows x width at the end."""
    schema = "at int, salt int, data binary"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["data"].iloc[0], np.float64).copy()
        for x in pdf["data"].iloc[1:]:
            total += np.frombuffer(x, np.float64)
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "salt": [0], "data": [total.tobytes()]})

    summed = parts.groupBy("at", "salt").applyInPandas(add, schema).groupBy("at").applyInPandas(add, schema)
    out = np.zeros((rows, width))
    for at, _, x in summed.collect():  # bounded by the benchmark's terms
        piece = np.frombuffer(x, np.float64).reshape(-1, width)
        out[at * _TERMS : at * _TERMS + len(piece)] = piece
    return out


def _hand_over(total: np.ndarray) -> pa.RecordBatch:
    pieces = [total[i : i + _TERMS] for i in range(0, len(total), _TERMS)]
    salt = TaskContext.get().partitionId() % 32
    return pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([salt] * len(pieces), pa.int32()), pa.array([np.ascontiguousarray(x, np.float64).tobytes() for x in pieces], pa.binary())], ["at", "salt", "data"])


_PARTS = "at int, salt int, data binary"


def block_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many blocks of all documents each term is, and how many blocks there are."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = Terms(terms), np.zeros((len(terms) + 1, 1))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                words, first = lower_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                before = _blocks(first)
                at, term = found.find(words)
                keys = np.unique(_block_of(at, first, before) * len(terms) + term)
                total[:-1, 0] += np.bincount(keys % len(terms), minlength=len(terms))
                total[-1, 0] += before[-1]
        yield _hand_over(total)

    sums = _sum_rows(docs.select("text").mapInArrow(run, _PARTS), 1, len(terms) + 1)[:, 0]
    return sums[:-1], int(sums[-1])


def term_blocks(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The terms of all documents: per row of many texts, arrays of (block, term), blocks numbered within the row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Terms(terms)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                words, first = lower_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, term = found.find(words)
                block = _block_of(at, first, _blocks(first))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([block.astype(np.int32).tobytes()], pa.binary()), pa.array([term.astype(np.uint32).tobytes()], pa.binary())], ["blocks", "terms"])

    return docs.select("text").mapInArrow(run, "blocks binary, terms binary")


def _fold(block: np.ndarray, term: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks that have terms, their sums of the terms' rows); block ascends."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
    return block[cut], np.add.reduceat(weighted[term], cut, axis=0)


def decompose(blocks: DataFrame, which: np.ndarray, idf: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], n_blocks: int, rank: int = RANK) -> np.ndarray:
    """terms x rank: the leading right singular vectors of the weighted block-by-term matrix. which: the number
    among a part's terms of each term in blocks, -1 if it is none of them."""
    rng = np.random.default_rng(_SEED)
    k = min(rank, len(idf))
    boost = max(1.0, n_blocks / max(1, len(items)))
    # the items' rows of the matrix, sparse
    term = np.concatenate([t for t, _ in items]) if items else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(items)), [len(t) for t, _ in items])
    value = (np.concatenate([c for _, c in items]) if items else np.zeros(0)) * idf[term]

    def of_items(right: np.ndarray) -> np.ndarray:
        out = np.zeros((len(items), right.shape[1]))
        np.add.at(out, row, value[:, None] * right[term])
        return out

    def onto_terms(left: np.ndarray) -> np.ndarray:
        out = np.zeros((len(idf), left.shape[1]))
        np.add.at(out, term, value[:, None] * left[row])
        return out

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for b, t in zip(batch.column("blocks"), batch.column("terms"), strict=True):
                block, term = np.frombuffer(b.as_py(), np.int32), which[np.frombuffer(t.as_py(), np.uint32)]
                own = term >= 0
                block, term = block[own], term[own]
                for i in range(0, len(block), 20_000):  # a block on the seam only counts as two
                    yield block[i : i + 20_000], term[i : i + 20_000]

    def sweep(test: np.ndarray) -> np.ndarray:
        weighted = (idf[:, None] * test).astype(np.float32)

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(test.shape)
            for block, term in entries(batches):
                found, z = _fold(block, term, weighted)
                back = z[np.searchsorted(found, block)]
                order = np.argsort(term, kind="stable")
                cut = np.concatenate([[0], np.flatnonzero(np.diff(term[order])) + 1])
                total[term[order[cut]]] += np.add.reduceat(back[order], cut, axis=0)
            yield _hand_over(total * idf[:, None])

        return _sum_rows(blocks.mapInArrow(run, _PARTS), test.shape[1], len(idf)) + boost * onto_terms(of_items(test))

    def gram(basis: np.ndarray) -> np.ndarray:
        weighted = (idf[:, None] * basis).astype(np.float32)

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((basis.shape[1], basis.shape[1]))
            for block, term in entries(batches):
                z = _fold(block, term, weighted)[1]
                total += z.T @ z
            yield _hand_over(total)

        own = of_items(basis)
        return _sum_rows(blocks.mapInArrow(run, _PARTS), basis.shape[1], basis.shape[1]) + boost * (own.T @ own)

    basis = np.linalg.qr(sweep(rng.standard_normal((len(idf), k))))[0]
    values, vectors = np.linalg.eigh(gram(basis))
    return basis @ vectors[:, np.argsort(-values)]


_FOUND = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
#: With the SHA-256 of the text, as ids may be null or repeated.
_MATCHED = _FOUND + ", digest binary"


def _matched(batch: pa.RecordBatch, rows: list[tuple[int, int, float | None, float, float]]) -> pa.RecordBatch:
    """Rows (row of the batch, item_id, cosine, lcs_share, answer_share) as _MATCHED."""
    data, offsets = utf8(batch.column("text"))
    at = [r for r, *_ in rows]
    digests = {r: hashlib.sha256(data[offsets[r] : offsets[r + 1]].tobytes()).digest() for r in set(at)}
    types = [pa.int64(), *[pa.float64()] * 3]
    columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[1:] if rows else [[]] * 4, types, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns, pa.array([digests[r] for r in at], pa.binary())], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "digest"])


class Bags:
    """The items' words with their counts: bounds a longest common subsequence without looking at the order."""

    def __init__(self, items: list[Item]):
        self.terms = np.unique(np.concatenate([x.words for x in items]))
        self.sizes = np.array([len(x.words) for x in items])
        self.bits = np.zeros((len(self.terms) + 1, -(-len(items) // 8)), np.uint8)  # a last row for other words
        keys, counts = [], []
        for i, item in enumerate(items):
            term, n = np.unique(np.searchsorted(self.terms, item.words), return_counts=True)
            self.bits[term, i // 8] |= 1 << i % 8
            keys.append(i * len(self.terms) + term)
            counts.append(n)
        self.keys, self.counts = np.concatenate(keys), np.concatenate(counts)

    def reachable(self, term: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which regions low:high of words, given as terms, share at least LCS_LEAST of their item's words."""
        out = np.zeros(len(low), bool)
        ends = np.cumsum(high - low)
        least = LCS_LEAST * self.sizes[item] - 1e-6
        a = 0
        while a < len(low):
            base = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + _WORDS, side="right")))
            n = (high - low)[a:b]
            pair = np.repeat(np.arange(b - a), n)
            held = term[np.arange(ends[b - 1] - base) + np.repeat(low[a:b] - (ends[a:b] - n - base), n)]
            own = item[a:b][pair]
            hit = self.bits[held, own >> 3] >> (own & 7) & 1 == 1
            pair, held, own = pair[hit], held[hit], own[hit]
            enough = np.bincount(pair, minlength=b - a) >= least[a:b]
            hit = enough[pair]
            pair, held, own = pair[hit], held[hit], own[hit]
            # No word counts more often than the item has it.
            once, n = np.unique(pair * len(self.terms) + held, return_counts=True)
            pair, held = once // len(self.terms), once % len(self.terms)
            n = np.minimum(n, self.counts[np.searchsorted(self.keys, item[a:b][pair] * len(self.terms) + held)])
            out[a:b] = np.bincount(pair, n, minlength=b - a) >= least[a:b]
            a = b
        return out


def passages(words: np.ndarray) -> list[np.ndarray]:
    """The item's words, and those of its passages if it is longer than one."""
    last = len(words) - 2 * HALF
    return [words] + ([words[i : i + 2 * HALF] for i in (*range(0, last, HALF), last)] if last > 0 else [])


class Part:
    """What a task holds of a part: items, terms, the terms' vectors, the items' and their passages' vectors."""

    def __init__(self, items: list[Item], terms: np.ndarray, idf: np.ndarray, vectors: np.ndarray):
        self.items, self.terms, self.weighted, self.bags = items, terms, (idf[:, None] * vectors).astype(np.float32), Bags(items)
        rows, owners = [], []
        own = Terms(terms)
        for i, item in enumerate(items):
            for part in passages(item.words):
                _, term = own.find(part)
                if len(term):
                    q = self.weighted[term].sum(axis=0)
                    rows.append(q / max(float(np.linalg.norm(q)), 1e-12))
                    owners.append(i)
        self.queries, self.owner = np.array(rows, np.float32).reshape(-1, vectors.shape[1]), np.array(owners, np.int64)


class Finder:
    """Looks a part's items up in chunks of texts."""

    def __init__(self, part: Part, cosine: float):
        self.part, self.cosine = part, cosine
        self.found, self.vocabulary = Terms(part.terms), Terms(part.bags.terms)

    def find(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item) -> (share, answer share, cosine) at the best region, of texts as word hashes and rows' first words."""
        part, bags = self.part, self.part.bags
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        before = _blocks(first)
        at, term = self.found.find(words)
        if not len(at):
            return best
        have, z = _fold(_block_of(at, first, before), term, part.weighted)
        row = np.searchsorted(before, have, side="right") - 1
        named = None
        for a in range(0, len(have), 4096):
            b = min(a + 4096, len(have))
            window = z[a:b].copy()
            last = min(b + 1, len(have))
            joined = (have[a + 1 : last] == have[a : last - 1] + 1) & (row[a + 1 : last] == row[a : last - 1])
            window[: len(joined)][joined] += z[a + 1 : last][joined]
            window /= np.maximum(np.linalg.norm(window, axis=1), 1e-12)[:, None]
            reach = window @ part.queries.T
            w, q = np.nonzero(reach >= self.cosine)
            if not len(w):
                continue
            # owners ascend, so an item's passages at one window are neighbours
            item, measured = part.owner[q], reach[w, q]
            cut = np.concatenate([[0], np.flatnonzero((np.diff(w) != 0) | (np.diff(item) != 0)) + 1])
            w, item, measured = w[cut], item[cut], np.maximum.reduceat(measured, cut)
            if named is None:
                named = np.full(len(words), len(bags.terms))
                place, name = self.vocabulary.find(words)
                named[place] = name
            r = row[a + w]
            start = first[r] + (have[a + w] - before[r]) * HALF
            # the item may reach out of the passage on either side
            low, high = np.maximum(first[r], start - bags.sizes[item]), np.minimum(first[r + 1], start + 2 * HALF + bags.sizes[item])
            for k in np.flatnonzero(bags.reachable(named, low, high, item)).tolist():
                share, answer = part.items[item[k]].common(words[low[k] : high[k]].tolist())
                if share >= LCS_SURE or share >= LCS_LEAST and answer >= ANSWER:
                    key, value = (int(r[k]), int(item[k])), (share, answer, float(measured[k]))
                    best[key] = max(best.get(key, value), value)
        return best


def search(docs: DataFrame, parts: list[Part], cosine: float = COSINE) -> DataFrame:
    """Contaminated pairs of docs(doc_id, text) and the parts' items, with what was measured at the best passage."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # bounded by GROUP * ITEMS

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Finder(p, cosine) for p in shared.value]
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows: list[tuple] = []
            for i, j in chunks(offsets):
                words, first = lower_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for f in finders:
                    rows += [(i + r, f.part.items[q].item_id, c, s, x) for (r, q), (s, x, c) in sorted(f.find(words, first).items())]
            yield _matched(batch, rows)

    return docs.select("doc_id", "text").mapInArrow(run, _MATCHED)


def exact(docs: DataFrame, items: list[Item]) -> DataFrame:
    """Pairs of docs(doc_id, text) and items whose words stand in the text in one piece; the cosine is null."""
    by_first: dict[int, list[int]] = {}
    for i, item in enumerate(items):
        by_first.setdefault(int(item.words[0]), []).append(i)
    shared = docs.sparkSession.sparkContext.broadcast((items, by_first, np.array(sorted(by_first), np.uint64)))  # bounded by ITEMS

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, by_first, starts = shared.value
        found = Terms(starts)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            pairs: list[tuple[int, int]] = []
            for i, j in chunks(offsets):
                words, first = lower_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, term = found.find(words)
                order = np.argsort(term, kind="stable")
                at, term = at[order], term[order]
                cut = np.flatnonzero(np.diff(term, prepend=-1))
                for t, places in zip(term[cut].tolist(), np.split(at, cut[1:]) if len(at) else [], strict=True):
                    row = np.searchsorted(first, places, side="right") - 1
                    for q in by_first[int(starts[t])]:
                        own = items[q].words
                        ok = places + len(own) <= first[row + 1]
                        for k in range(1, len(own)):
                            ok[ok] = words[places[ok] + k] == own[k]
                        pairs += [(i + r, q) for r in np.unique(row[ok]).tolist()]
            yield _matched(batch, [(r, items[q].item_id, None, 1.0, 1.0) for r, q in pairs])

    return docs.select("doc_id", "text").mapInArrow(run, _MATCHED)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id, cosine, lcs_share, answer_share) of documents that hold a benchmark item."""
    return matches(docs, benchmark).drop("digest")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contaminated(), with the digest (SHA-256) of the text that was judged."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = benchmark.where("text is not null").select("item_id", "text").collect()  # the query set
    items = [x for x in (Item(i, t) for i, t in rows) if len(x.words)]
    short, items = [x for x in items if len(x.words) < MIN_WORDS], [x for x in items if len(x.words) >= MIN_WORDS]
    found = [exact(docs, short[i : i + GROUP * ITEMS]) for i in range(0, len(short), GROUP * ITEMS)]
    if items:
        # parts of about equal size, dealt so that they do not depend on the benchmark's order
        items.sort(key=lambda x: (x.words.tobytes(), str(x.item_id)))
        n = -(-len(items) // ITEMS)
        parts = [items[k::n] for k in range(n)]
        every = np.unique(np.concatenate([x.words for x in items]))
        counts, n_blocks = block_frequencies(docs, every)
        own_terms = [_rare(part, every, counts, n_blocks) for part in parts]
        used = np.unique(np.concatenate(own_terms))
        blocks = materialize(term_blocks(docs, every[used]), "terms") if len(used) else None
        ready = []
        for part, own in zip(parts, own_terms, strict=True):
            if not len(own):
                continue
            which = np.full(len(used), -1, np.int64)
            which[np.searchsorted(used, own)] = np.arange(len(own))
            terms, idf = every[own], np.log((n_blocks + len(part) + 1) / (counts[own] + 1))
            held = [np.unique(Terms(terms).find(x.words)[1], return_counts=True) for x in part]
            ready.append(Part(part, terms, idf, decompose(blocks, which, idf, held, n_blocks)))
            if len(ready) == GROUP:
                found.append(search(docs, ready))
                ready = []
        if ready:
            found.append(search(docs, ready))
    if not found:
        return spark.createDataFrame([], _MATCHED)
    return functools.reduce(DataFrame.unionByName, found)


def _rare(items: list[Item], every: np.ndarray, counts: np.ndarray, n_blocks: int) -> np.ndarray:
    """Numbers among `every` of the items' words that are terms: those of few blocks, and each item's rarest."""
    own = np.unique(np.searchsorted(every, np.concatenate([x.words for x in items])))
    # Words of many blocks tell nothing; a corpus of few blocks has no such words.
    keep = counts[own] <= max(STOP * n_blocks, 20)
    for x in items:
        at = np.unique(np.searchsorted(every, x.words))
        keep[np.searchsorted(own, at[np.argsort(counts[at], kind="stable")[:RAREST]])] = True
    return own[keep]
