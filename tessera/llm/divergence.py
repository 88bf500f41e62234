"""Source divergence audit by joint count histograms.

How far the vocabulary of each source of a language is from that of every other, and which terms set a source apart
from its language, in exact integers. A term is a maximal run of ASCII letters and characters beyond ASCII, A-Z
lower-cased; a language keeps those in at least DOCS of its documents (V of them). With count occurrences of a
term in a group, N of all kept terms there, the term's share is p = 1 + floor(10^9 (count + 5) / (N + 5 V)).

Two sources differ by the sum of |p - q| over all kept terms. p and q depend on the two counts alone, so the terms
of a pair are tallied by (count, count) and the difference is evaluated once for each combination. Terms that
both sources have are tallied as they are; how many have a count in the one and none in the other is what the
one's own histogram of counts has more than the tally, and what is left of V has neither. So no zero is ever a row.

Terms are counted in tasks a batch at a time, by their strings, and summed before they are shuffled; a very long
text goes in pieces between terms, a share of the terms at a time. What meets under one key are counts: a
term's by source, so at most as many as there are sources. Terms of a hot source are rows of many keys. Ranks
of terms keep TOP of each task's rows before they meet.

Null text, lang and source count as ''. Texts that are empty or have no term still make their group occur: its
counts are zero, and if its language keeps no term its pairs have value 0. Repeated rows count as often as they
occur; ids play no part. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import chunks, lean, materialize, skew_join, small_batches, utf8

#: Documents of a language that have a kept term, and ranks of terms for each group.
DOCS, TOP = 30, 50
#: Bytes of text whose terms are told apart at once.
PIECE = 8 << 20
#: Rows of sums, one for each group or pair of groups, that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 100_000
# Fixed values of the shares.
UNIT, MORE = 1_000_000_000, 5

_TERM = np.ones(256, bool)
_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def _terms(data: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of UTF-8 bytes, and where they start."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = flips[::2], flips[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(W.LOWER[data[inside[1:-1]]])), starts


def _found(piece: np.ndarray, rows: np.ndarray, begin: np.ndarray) -> pa.Table:
    """(row, term, count) of the rows that begin at these bytes of a piece."""
    terms, starts = _terms(piece)
    coded = terms.dictionary_encode()
    row = np.searchsorted(begin, starts, side="right") - 1
    n = max(len(coded.dictionary), 1)
    pairs, counts = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
    return pa.table({"row": rows[pairs // n] if len(pairs) else np.zeros(0, np.int64), "term": coded.dictionary.take(pa.array(pairs % n)), "count": counts.astype(np.int64)})


def _cuts(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about limit bytes, cut between terms."""
    a, b = 0, len(data)
    while a < b:
        end = min(b, a + limit)
        gaps = np.flatnonzero(~_TERM[data[a:end]])
        if end < b and len(gaps):
            end = a + int(gaps[-1]) + 1
        while end < b and not len(gaps):
            gaps = np.flatnonzero(~_TERM[data[end : end + limit]])
            end = end + int(gaps[0]) + 1 if len(gaps) else min(b, end + limit)
        yield data[a:end]
        a = end


def _of_long(data: np.ndarray, row: int, limit: int) -> Iterator[pa.Table]:
    """The same of one long text: as many passes as pieces, each for a share of the terms, so that memory is bounded
    however many terms differ."""
    passes = -(-len(data) // limit)
    for k in range(passes):
        held = []
        for piece in _cuts(data, limit):
            found = _found(piece, np.array([row]), np.zeros(1, np.int64))
            raw, offsets = utf8(found["term"])
            own = W.hashes(raw, offsets[:-1], offsets[1:]) % np.uint64(passes) == k
            held.append(found.filter(pa.array(own)))
        yield pa.concat_tables(held).group_by(["row", "term"]).aggregate([("count", "sum")]).rename_columns(["row", "term", "count"])


def count_terms(column: pa.Array, group: np.ndarray, limit: int = PIECE) -> Iterator[pa.Table]:
    """(group, term, docs, count) of texts, each of the group with the number beside it."""
    data, offsets = utf8(column)

    def of_groups(found: pa.Table) -> pa.Table:
        found = found.append_column("group", pa.array(group[found["row"].to_numpy()]))
        return found.group_by(["group", "term"]).aggregate([("row", "count"), ("count", "sum")]).rename_columns(["group", "term", "docs", "count"])

    for i, j in chunks(offsets, limit):  # whole rows, or one that is longer
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= limit:
            apart = np.insert(data[a:b], offsets[i + 1 : j] - a, 0x20)  # no term reaches over two rows
            yield of_groups(_found(apart, np.arange(i, j), offsets[i:j] - a + np.arange(j - i)))
        else:
            yield from map(of_groups, _of_long(data[a:b], i, limit))


@lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = pa.Table.from_batches([batch]).select(["lang", "source"]).group_by(["lang", "source"]).aggregate([])
        at = {x: i for i, x in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist(), strict=True))}
        group = np.array([at[x] for x in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)], np.int64)
        own = lambda c, g: pc.take(names[c].combine_chunks(), g)  # noqa: B023, E731
        # a row without a term says that the group occurs
        zeros = pa.array(np.zeros(len(at), np.int64))
        occurs = pa.table({"group": pa.array(np.arange(len(at))), "term": pa.nulls(len(at), pa.string()), "docs": zeros, "count": zeros})
        for found in itertools.chain([occurs], count_terms(batch["text"], group)):
            g = found["group"].combine_chunks()
            yield from pa.table({"lang": own("lang", g), "source": own("source", g), **{c: found[c] for c in ("term", "docs", "count")}}).combine_chunks().to_batches(50_000)


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count; the product is a decimal, since 10^9 times a count may not fit a long. Nothing is asked of a
    language that keeps no term, so 1 stands for its empty sum."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(count + MORE), wide(F.greatest(total + MORE * kept, F.lit(1)))) + 1


def _beside(rows: DataFrame, facts: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """rows with what facts has for their keys; facts has n rows, one a key. Few are broadcast."""
    return rows.join(F.broadcast(facts), keys) if n <= MOST_BROADCAST else skew_join(rows, facts, keys)


def _tally(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, of_a, of_b, n): how many kept terms occur so often in a and so often in b, for each pair a < b.
    Terms that both have are counted; what the sources' own histograms have more has a zero on one side."""
    zero = F.lit(0).cast("long")
    cell = lambda a, b, n: F.struct(a.alias("of_a"), b.alias("of_b"), n.alias("n"))
    spread = lambda df, *cells: df.select("lang", "a", "b", F.explode(F.array(*cells)).alias("c")).select("lang", "a", "b", "c.*")
    of_a, of_b, n = F.col("of_a"), F.col("of_b"), F.col("n")
    first = kept.select("lang", "cells", F.posexplode("cells").alias("i", "x"))
    both = first.select("lang", "x", F.explode(F.slice("cells", F.col("i") + 2, F.size("cells"))).alias("y"))
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.count").alias("of_a"), F.col("y.count").alias("of_b")).agg(F.count("*").alias("n"))
    own = kept.select("lang", F.explode("cells").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.count").alias("count")).agg(F.count("*").alias("n"))
    in_a = own.withColumnsRenamed({"source": "a", "count": "of_a"}).join(pairs.select("lang", "a", "b"), ["lang", "a"])
    in_b = own.withColumnsRenamed({"source": "b", "count": "of_b"}).join(pairs.select("lang", "a", "b"), ["lang", "b"])
    rows = spread(both, cell(of_a, of_b, n), cell(of_a, zero, -n), cell(zero, of_b, -n), cell(zero, zero, n))
    rows = rows.unionByName(spread(in_a, cell(of_a, zero, n), cell(zero, zero, -n))).unionByName(spread(in_b, cell(zero, of_b, n), cell(zero, zero, -n)))
    rows = rows.unionByName(pairs.select("lang", "a", "b", zero.alias("of_a"), zero.alias("of_b"), F.col("v").alias("n")))
    return rows.groupBy("lang", "a", "b", "of_a", "of_b").agg(F.sum("n").alias("n")).where("n <> 0")


def audit(docs: DataFrame, least_docs: int = DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the divergence from each other source of the language,
    part `term` the terms, `top` of them at most, whose share in the source is most above that in its language."""
    small_batches(docs.sparkSession)
    texts = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = texts.mapInArrow(_counted, "lang string, source string, term string, docs long, count long")
    counts = materialize(counts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count")), "counts")
    cells = F.sort_array(F.collect_list(F.struct("source", "count"))).alias("cells")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("in_lang"), cells)
    kept = materialize(kept.where(F.col("docs") >= least_docs), "kept")
    each = kept.select("lang", "term", "in_lang", F.explode("cells").alias("x")).select("lang", "term", "in_lang", "x.source", "x.count")

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n"))
    groups = counts.select("lang", "source").distinct().join(each.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.fillna(0, ["n", "v", "lang_n"]), "groups")
    n_groups = groups.count()

    p, q = _share(F.col("count"), F.col("n"), F.col("v")), _share(F.col("in_lang"), F.col("lang_n"), F.col("v"))
    more = _beside(each, groups, n_groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = more.withColumn("rank", rank).where(F.col("rank") <= top)

    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("n").alias(f"n_{x}"), *(["v"] if x == "a" else []))
    pairs = materialize(side("a").join(side("b"), "lang").where("a < b"), "pairs")
    f = F.abs(_share(F.col("of_a"), F.col("n_a"), F.col("v")) - _share(F.col("of_b"), F.col("n_b"), F.col("v")))
    values = _beside(_tally(kept, pairs), pairs, pairs.count(), ["lang", "a", "b"]).withColumn("f", f).groupBy("lang", "a", "b").agg(F.sum(F.col("f") * F.col("n")).alias("value"))
    found = pairs.select("lang", "a", "b").join(values, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    ranked = found.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).unionByName(terms)
