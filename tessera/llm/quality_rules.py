"""Quality rules: base counts of a text, and its divergence from language references.

Base: words are runs of bytes other than space and 0x09-0x0D. A document fails it with fewer than ten
words, or if over 20 % of its words lie in 5-word windows that its text holds twice or more.

Method: every language of the corpus has two reference distributions, gathered over all of its
documents that pass the base: character classes, and common words (the rest is one bin). A document is
compared to them with the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) and passes
if at least one language is within both limits. Short texts have noisy histograms, so each comparison has a
least length, and shorter texts pass it; the words' limit is the wider the fewer words fall to a common one. Common are
words with a share of at least COMMON_SHARE of their language's words, seen COMMON_COUNT times or more. A
reference whose common words are less than COVER of its words, as of a language with little text, tells
nothing about other texts, so only its own documents are held to it. Documents without a language pass if
no reference covers more.

Common words are found without a full dictionary: mergeable frequent-item summaries of `SUMMARY`
counters keep every word with a share over 1/SUMMARY of a language's words, and a second pass counts
those exactly over all documents. Only these bounded tables reach the driver.

Null and empty texts have no words and fail the base. A null language joins no reference. Repeated
rows are judged one by one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import chunks, lean, small_batches, utf8

SUMMARY = 1000
COMMON_SHARE, COMMON_COUNT, COVER = 1 / 500, 20, 0.1
#: Limits of the Jensen-Shannon distance, and the lengths (characters, words) from which they hold.
CHAR_LIMIT, CHAR_MIN = 0.30, 250
WORD_LIMIT, WORD_MIN = 0.20, 40
#: Added to the words' limit, times the root of common words to the text's words: so noisy is its histogram.
WORD_NOISE = 0.28

_SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "newline", "sentence", "symbol", "beyond_ascii", "control")


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("symbol"), np.uint8)
    t[:32] = CLASSES.index("control")
    t[127] = CLASSES.index("control")
    t[0x80:0xC0] = len(CLASSES)  # continuation bytes: no character of their own
    t[0xC0:] = CLASSES.index("beyond_ascii")
    t[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    t[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    t[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    t[[32, 9]] = CLASSES.index("space")
    t[[10, 11, 12, 13]] = CLASSES.index("newline")
    t[list(b".,;:?'\"()-")] = CLASSES.index("sentence")
    return t


_CLASS = _class_table()
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOLS)] = True
_WORD_CHAR = ~W._SPACE
_WORD_CHAR[0x80:0xC0] = False


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many are true in each row."""
    if len(values) > W.SEGMENT:
        return np.array([np.count_nonzero(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x classes."""
    if len(data) > W.SEGMENT:  # a long row, in parts
        parts = ((data[c : min(b, c + W.SEGMENT)] for c in range(a, b, W.SEGMENT)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        return np.array([sum((np.bincount(_CLASS[x], minlength=len(CLASSES) + 1)[: len(CLASSES)] for x in row), np.zeros(len(CLASSES), np.int64)) for row in parts])
    k, n = len(CLASSES) + 1, len(offsets) - 1
    found = np.bincount(_rows_of(offsets) * k + _CLASS[data], minlength=n * k)
    return found.reshape(n, k)[:, : len(CLASSES)]


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words without the punctuation behind them, and each row's first word."""
    return W.word_hashes(data, offsets, trim=True)


def _prune(hashes: np.ndarray, counts: np.ndarray, k: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """Sum by hash; if over k remain, lower all by the (k+1)-th count, which keeps the summary's error bound."""
    u, inv = np.unique(hashes, return_inverse=True)
    c = np.bincount(inv, weights=counts, minlength=len(u)).astype(np.int64)
    if len(u) > k:
        c = c - np.partition(c, len(c) - k - 1)[len(c) - k - 1]
        u, c = u[c > 0], c[c > 0]
    return u, c


@lean
def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
        data, offsets = utf8(batch.column("text"))
        for i, j in chunks(offsets):
            part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            good = ~base(part, offs)[2]
            h, first = lower_words(part, offs)
            row_lang = np.repeat(np.arange(j - i), np.diff(first))
            for lang in set(langs[i:j]) - {None}:
                mine = h[((langs[i:j] == lang) & good)[row_lang]]
                u, c = np.unique(mine, return_counts=True)
                old = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                held[lang] = _prune(np.concatenate([old[0], u]), np.concatenate([old[1], c]))
    for lang, (u, c) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(c, pa.int64())], ["lang", "word", "n"])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    u, c = _prune(pdf["word"].to_numpy().view(np.uint64), pdf["n"].to_numpy())
    return pd.DataFrame({"lang": pdf["lang"].iloc[0] if len(pdf) else None, "salt": 0, "word": u.view(np.int64), "n": c})


def frequent_words(docs: DataFrame) -> pd.DataFrame:
    """(lang, word): all words with a share over 1/SUMMARY of their language's, and some below it."""
    found = docs.select("lang", "text").mapInArrow(_summaries, "lang string, word long, n long")
    # a task's summary has SUMMARY rows a language at most; they meet in two steps
    salted = found.withColumn("salt", F.spark_partition_id() % 64).groupBy("lang", "salt").applyInPandas(_merge, "lang string, salt int, word long, n long")
    return salted.groupBy("lang").applyInPandas(_merge, "lang string, salt int, word long, n long").select("lang", "word").toPandas()


def language_references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language: common words' hashes (sorted), their shares with that of all other words, class shares."""
    docs = docs.select("lang", "text")
    candidates = frequent_words(docs)
    of = {lang: np.sort(g["word"].to_numpy().view(np.uint64)) for lang, g in candidates.groupby("lang")}

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], np.ndarray] = {}

        def add(key: tuple[str, str], values: np.ndarray) -> None:
            total[key] = total[key] + values if key in total else values

        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                good = ~base(part, offs)[2]
                h, first = lower_words(part, offs)
                classes = class_counts(part, offs)
                row = np.repeat(np.arange(j - i), np.diff(first))
                for lang in set(langs[i:j]) - {None}:
                    mine = (langs[i:j] == lang) & good
                    add((lang, "class"), classes[mine].sum(axis=0))
                    own, known = h[mine[row]], of.get(lang, np.zeros(0, np.uint64))
                    at = np.searchsorted(known, own)
                    hit = at < len(known)
                    hit[hit] = known[at[hit]] == own[hit]
                    add((lang, "word"), np.bincount(np.where(hit, at, len(known)), minlength=len(known) + 1))
        for (lang, kind), values in total.items():
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([kind] * n), pa.array(np.arange(n), pa.int64()), pa.array(values.astype(np.int64))], ["lang", "kind", "at", "n"])

    rows = docs.mapInArrow(count, "lang string, kind string, at long, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for lang, g in rows.groupby("lang"):
        get = lambda kind, size: np.bincount(g.loc[g.kind == kind, "at"].to_numpy(), g.loc[g.kind == kind, "n"].to_numpy(), minlength=size)  # noqa: B023, E731
        known = of.get(lang, np.zeros(0, np.uint64))
        classes, counts = get("class", len(CLASSES)), get("word", len(known) + 1)
        if not counts.sum() or not classes.sum():
            continue
        best = np.flatnonzero((counts[:-1] >= COMMON_COUNT) & (counts[:-1] >= COMMON_SHARE * counts.sum()))
        shares = np.append(counts[:-1][best], counts.sum() - counts[:-1][best].sum()) / counts.sum()
        out[str(lang)] = (known[best], shares, classes / classes.sum())
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of p against q, both distributions; 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _repeat_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row: words covered by 5-word windows that the row holds twice or more."""
    out = np.zeros(len(first) - 1, np.int64)
    full = np.diff(first) >= 5
    if not full.any():
        return out
    grams, bounds = W.shingles(h, first, 5)
    if len(out) == 1:  # a long row has many: no more than a sorted copy of them is held
        ordered = np.sort(grams)
        twice_ = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        if not len(twice_):
            return out
        at = np.flatnonzero(twice_[np.minimum(np.searchsorted(twice_, grams), len(twice_) - 1)] == grams)
        step = np.zeros(len(h) + 1, np.int8)  # a window starts and one ends at a word, at most
        step[at] += 1
        step[at + 5] -= 1
        return np.array([np.count_nonzero(np.cumsum(step, dtype=np.int32)[:-1])], np.int64)
    row = np.repeat(np.arange(len(out)), np.diff(bounds))
    # one key for (row, gram): equal keys are repeats within a row
    key = W.mix(grams ^ W.mix(row.astype(np.uint64), 7), 8)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= full[row]
    at = np.flatnonzero(twice)
    start = at - bounds[row[at]] + first[row[at]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + 5, -1)
    return _per_row(np.cumsum(cover)[:-1] > 0, first)


def base(part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words in repeated windows, whether the base fails) of each text."""
    exact, first = W.word_hashes(part, offs, lower=False)
    n_words, repeats = np.diff(first), _repeat_words(exact, first)
    return n_words, repeats, (n_words < 10) | (100 * repeats > 20 * n_words)


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.split(None, 1)]
    return len(lines) - len(set(lines))


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def verdicts(part: np.ndarray, offs: np.ndarray, refs: dict, langs: list[str | None]) -> list[pa.Array]:
    """The columns _NAMES of some texts of the languages langs."""
    n = len(offs) - 1
    n_words, repeats, failed = base(part, offs)
    raw = part.tobytes()
    dup = np.fromiter((_dup_lines(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)), np.int64, n)
    classes = class_counts(part, offs)
    chars = classes.sum(axis=1)
    h, low_first = lower_words(part, offs)
    row = np.repeat(np.arange(n), np.diff(low_first))
    said = np.asarray(langs, dtype=object)
    covers = {name: 1 - shares[-1] >= COVER for name, (_, shares, _) in refs.items()}
    unheld = {x for x in said if x is not None and x not in refs} | (set() if any(covers.values()) else {None})
    passed, near_c, near_w = np.fromiter((x in unheld for x in said), bool, n), np.full(n, np.inf), np.full(n, np.inf)
    for name in sorted(refs):
        known, shares, class_shares = refs[name]
        at = np.searchsorted(known, h)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == h[hit]
        k = len(known) + 1
        counts = np.bincount(row * k + np.where(hit, at, k - 1), minlength=n * k).reshape(n, k)
        dc = js_distance(classes / np.maximum(chars, 1)[:, None], class_shares)
        dw = js_distance(counts / np.maximum(n_words, 1)[:, None], shares)
        held = np.full(n, covers[name]) | (said == name)
        passed |= held & ((chars < CHAR_MIN) | (dc <= CHAR_LIMIT)) & ((n_words < WORD_MIN) | (dw <= WORD_LIMIT + WORD_NOISE * np.sqrt(len(known) / np.maximum(n_words, 1))))
        better = held & (dc + dw < near_c + near_w)
        near_c, near_w = np.where(better, dc, near_c), np.where(better, dw, near_w)
    return [
        *(pa.array(x.astype(np.int64)) for x in (n_words, _per_row(_WORD_CHAR[part], offs), _per_row(_IS_SYMBOL[part], offs), dup, repeats)), pa.array(failed), pa.array(~failed & passed),
        pa.array(near_c, mask=(chars < CHAR_MIN) | ~np.isfinite(near_c)), pa.array(near_w, mask=(n_words < WORD_MIN) | ~np.isfinite(near_w)),
    ]


def judge(docs: DataFrame, references: dict | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    char_distance and word_distance of the nearest language (null where too short)."""
    small_batches(docs.sparkSession)
    refs = language_references(docs) if references is None else references

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], *verdicts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], refs, batch.column("lang")[i:j].to_pylist())], ["doc_id", *_NAMES])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double")


def keep(docs: DataFrame, references: dict | None = None) -> DataFrame:
    """The rows of docs, with all columns, that judge() keeps; nothing is shuffled."""
    small_batches(docs.sparkSession)
    refs = language_references(docs) if references is None else references

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            langs = batch.column(batch.schema.get_field_index("lang"))
            for i, j in chunks(offsets):
                yield batch.slice(i, j - i).filter(verdicts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], refs, langs[i:j].to_pylist())[_NAMES.index("kept")])

    return docs.mapInArrow(run, docs.schema)
