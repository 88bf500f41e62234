"""Language ID: each document as a mixture of languages over hashed byte trigrams.

Learning counts trigrams of every labelled document by language. A document's language proportions are
those that maximise the likelihood of its trigrams, found by expectation-maximisation. Which languages
take part is decided by penalised likelihood: starting from the best single language, the one that
raises the likelihood most joins while the gain passes a penalty of half log n per language, with
likelihoods divided by the trigram length because overlapping trigrams tell the same thing repeatedly.
The prediction is the language with the largest share in the chosen set. The score is that share times the
posterior probability of the chosen among all that were learned, by the same likelihoods with equal priors,
so a text of a few trigrams that several languages have scores low.

Only text is looked at when predicting. Null texts and texts without a letter (a character of a letter
category; fractions, superscripts and circled numbers are none) are `und` with score 0,
and so is everything if no language was learned. A null lang or id is never learned from; a null id is
not held out. Repeated rows are predicted one by one; extra columns are ignored; an empty table gives an
empty result. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, utf8

GRAM = 3
FEATURES = 1 << 15
_BLOCK = 1024
SMOOTHING = 0.5
ROUNDS = 40
#: Lower shares are not tried for joining the set.
LEAST_SHARE = 0.02
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[:33] = 32


def has_letter(text: str) -> bool:
    """Whether any character is a letter; the expression also finds numbers that are no digits."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def features(data: np.ndarray) -> np.ndarray:
    """The hashed trigrams of a text, with a blank before and after."""
    x = _FOLD[np.concatenate([[32], data, [32]]).astype(np.uint8)]
    if len(x) < GRAM:
        return np.zeros(0, np.int64)
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities: languages x FEATURES) from docs(text, lang)."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            data, offsets = utf8(batch.column("text"))
            for lang in set(langs.tolist()):
                mine = np.flatnonzero(langs == lang)
                sums = total.setdefault(lang, np.zeros(FEATURES, np.int64))
                for i in mine.tolist():
                    for a, b in _pieces(int(offsets[i]), int(offsets[i + 1])):
                        sums += np.bincount(features(data[a:b]), minlength=FEATURES)
        task = TaskContext.get().partitionId()
        for lang, sums in total.items():
            blocks = sums.reshape(-1, _BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(blocks)), pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(np.full(len(blocks), task % 32, np.int32)), pa.array([x.tobytes() for x in blocks], pa.binary())], ["lang", "block", "salt", "counts"]
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BLOCK, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "block": [pdf["block"].iloc[0]], "salt": [0], "counts": [total.tobytes()]})

    schema = "lang string, block int, salt int, counts binary"
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    parts = known.mapInArrow(count, schema).groupBy("lang", "block", "salt").applyInPandas(add, schema)
    rows = parts.groupBy("lang", "block").applyInPandas(add, schema).toPandas()  # languages x FEATURES numbers
    languages = sorted(rows["lang"].unique().tolist()) if len(rows) else []
    counts = np.zeros((len(languages), FEATURES))
    for lang, block, x in zip(rows["lang"], rows["block"], rows["counts"], strict=True):
        counts[languages.index(lang), block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(x, np.int64)
    used = counts.sum(axis=1) > 0
    languages, counts = [x for x, u in zip(languages, used, strict=True) if u], counts[used]
    smooth = counts + SMOOTHING
    return languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)) if languages else counts


def _pieces(a: int, b: int, step: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Long texts are taken piece by piece, overlapping by what a trigram needs."""
    while b - a > step:
        yield a, a + step
        a += step - GRAM + 1
    yield a, b


def mixture(counts: np.ndarray, probabilities: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(shares, log-likelihood) by expectation-maximisation; probabilities: languages x trigrams."""
    k, n = len(probabilities), counts.sum()
    shares = np.full(k, 1 / k)
    for _ in range(rounds):
        joint = shares @ probabilities
        new = shares * (probabilities @ (counts / joint)) / n
        moved = np.abs(new - shares).max()
        shares = new
        if moved < 1e-4:
            break
    return shares, float(counts @ np.log(shares @ probabilities))


def infer(counts: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen languages, their shares, all languages' posterior probabilities) of one document's trigram counts."""
    scale = logs.max(axis=0)
    probabilities = np.exp(logs - scale)  # the common factor cancels in shares and gains
    single = counts @ np.log(probabilities).T
    posterior = np.exp((single - single.max()) / GRAM)
    posterior /= posterior.sum()
    chosen = [int(single.argmax())]
    shares, best = np.ones(1), float(single[chosen[0]])
    if len(logs) == 1:
        return np.array(chosen), shares, posterior
    all_shares, _ = mixture(counts, probabilities)
    penalty = 0.5 * np.log(max(counts.sum(), 2))
    order = [int(x) for x in np.argsort(-all_shares, kind="stable") if all_shares[x] >= LEAST_SHARE and x != chosen[0]]
    while order:
        tried = [(mixture(counts, probabilities[[*chosen, x]]), x) for x in order]
        (new_shares, ll), x = max(tried, key=lambda t: t[0][1])
        if (ll - best) / GRAM <= penalty:
            break
        chosen.append(x)
        order.remove(x)
        shares, best = new_shares, ll
    return np.array(chosen), shares, posterior


def predict(docs: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """docs(doc_id, text) with lang_pred, score and languages, the mixture as lang:share by falling share."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(logs.astype(np.float32))  # languages x FEATURES

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value.astype(np.float64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            predicted, scores, mixed = [], [], []
            for i, text in enumerate(batch.column("text")):
                value = text.as_py()
                if not languages or value is None or not has_letter(value):
                    predicted.append(UNDETERMINED), scores.append(0.0), mixed.append("")
                    continue
                counts = np.zeros(FEATURES, np.int64)
                for a, b in _pieces(int(offsets[i]), int(offsets[i + 1])):
                    counts += np.bincount(features(data[a:b]), minlength=FEATURES)
                seen = np.flatnonzero(counts)
                chosen, shares, posterior = infer(counts[seen].astype(float), own[:, seen])
                order = np.lexsort((chosen, -shares))
                predicted.append(languages[chosen[order[0]]])
                scores.append(float(min(1.0, shares[order[0]] * posterior[chosen].sum())))
                mixed.append(",".join(f"{languages[chosen[x]]}:{shares[x]:.2f}" for x in order))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(mixed, pa.string())], ["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all: doc_id, held_out, lang_pred, score, languages."""
    small_batches(docs.sparkSession)
    languages, logs = learn(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    found = predict(docs, languages, logs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
