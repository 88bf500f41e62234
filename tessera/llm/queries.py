"""Queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, hard_negatives, html_extraction, language_id, minhash, packing, quality_rules, secret_scans, sharding, suffix_dedup, url_filters, warc
from .common import table

# Fixed values of the query's contract.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Listed canonical URLs; an entry that ends in / stands for all below it.
LISTED_URLS = ("spam-farm.example.org/", "cheap-pills.example.com/", "casino-win.example.org/")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"), 0.85)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.sql("SELECT canonical FROM VALUES " + ", ".join(f"('{x}')" for x in LISTED_URLS) + " AS t(canonical)")
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, listed)


TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, RANKS)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.places(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _OP1, "op6_url_filters": _OP6, "op4_minhash": _OP4, "op5_suffix_array_dedup": _OP5, "op9_secret_scans": _op9(), "op10_quality_rules": _op10(), "op11_hard_negatives": _OP11, "op12_sharding": _op12(), "op13_source_divergence": _OP13}


_OP1 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS m FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, url, CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to,
       strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest
FROM p LEFT JOIN g ON p.h = g.h
"""

_OP6 = r"""
WITH split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), rules(r, verdict) AS (VALUES """ + ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES) + r"""),
fits AS (
  SELECT page_id, host, path, r, verdict FROM split JOIN rules
  ON (host = split_part(r, '/', 1) OR ends_with(host, '.' || split_part(r, '/', 1))) AND starts_with(path, substr(r, strpos(r, '/')))
), best AS (
  SELECT page_id, host, path, arg_max(r, length(r)) AS rule, arg_max(verdict, length(r)) AS verdict FROM fits GROUP BY ALL
)
SELECT s.page_id, s.host, s.path, b.rule,
       coalesce(b.verdict, CASE WHEN """ + " OR ".join(f"s.host = '{x[:-1]}' OR ends_with(s.host, '.{x[:-1]}')" for x in LISTED_URLS) + r""" THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN best b ON s.page_id = b.page_id AND s.host = b.host AND s.path = b.path
"""


def _op9() -> str:
    """Matches by the engine's own expressions: what lies between them and their lengths give their places."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for n, (_, prefix, run, least) in enumerate(secret_scans.RULES):
        # groups of a prefix are not told apart; runs without a prefix are maximal, so that short ones need not be found
        rule = quoted(f"(?:{prefix})({run}+)".replace("(?:(", "(?:(?:").replace("k_(", "k_(?:") if prefix else f"({run}{{{least},}})")
        parts.append(f"SELECT rid, {n} AS kind, string_split_regex(x, {rule}) AS gaps, regexp_extract_all(x, {rule}, 0) AS hits, list_filter(range(1, len(hits) + 1), lambda k: length(regexp_extract_all(x, {rule}, 1)[k]) >= {least}) AS own FROM t WHERE regexp_matches(x, {rule})")
    names = "[" + ", ".join(f"'{k}'" for k in secret_scans.KINDS) + "]"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
m AS MATERIALIZED ({' UNION ALL '.join(parts)}),
s AS (SELECT rid, kind, gaps, hits, unnest(own) AS k FROM m),
spans AS (SELECT rid, kind, hits[k] AS hit, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS BIGINT) AS a FROM s),
said AS (SELECT rid, kind, a, {names}[kind + 1] || ':' || a || ':' || (a + length(hit)) AS span FROM spans),
sums AS (
  SELECT rid, {', '.join(f"count(*) FILTER (WHERE kind = {n}) AS n_{k}" for n, k in enumerate(secret_scans.BASE))},
         string_agg(span, ',' ORDER BY a, kind) FILTER (WHERE kind < {len(secret_scans.BASE)}) AS base, string_agg(span, ',' ORDER BY a, kind) AS spans
  FROM said GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scans.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN sums USING (rid)"""


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_OP4 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS w FROM documents),
sets AS MATERIALIZED (SELECT rid, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
flat AS MATERIALIZED (SELECT rid, md5_number(unnest(s)) AS h FROM sets),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM flat a JOIN flat b ON a.h = b.h AND a.rid < b.rid GROUP BY ALL),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM shared JOIN sets x ON x.rid = a JOIN sets y ON y.rid = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a, a AS b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
least AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM sets LEFT JOIN least ON a = doc_id
"""

_OP5 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS x FROM documents),
w AS MATERIALIZED (SELECT rid, i, hash(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT rid, x, unnest(range(0, CAST(length(x) // 2 AS BIGINT) - 199)) AS i FROM d)),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
found AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS step FROM w WHERE h IN (SELECT h FROM again)),
runs AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS b FROM (SELECT rid, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM found) GROUP BY rid, run),
gaps AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT rid, max(b), CAST(NULL AS BIGINT) FROM runs GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, length(x) // 2) - a)), '' ORDER BY a, b NULLS LAST) AS k FROM gaps JOIN d USING (rid) GROUP BY rid),
sums AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS m FROM runs GROUP BY rid)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(m, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)
"""


def _op10() -> str:
    q = quality_rules
    # the classes of quality_rules as sets of characters
    sets = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09]", "newline": r"[\x0A-\x0D]", "sentence": r"""[.,;:?'"()-]""", "beyond_ascii": r"[^\x00-\x7F]", "control": r"[\x00-\x08\x0E-\x1F\x7F]", "symbol": r"""[^a-zA-Z0-9\x00-\x20\x7F.,;:?'"()\-\x{80}-\x{10FFFF}]"""}
    counted = ", ".join("length(x) - length(regexp_replace(x, '{}', '', 'g')) AS c{}".format(sets[c].replace("'", "''"), i) for i, c in enumerate(q.CLASSES))
    k = range(len(q.CLASSES))
    term = lambda p, r: f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {r}) / 2)) ELSE 0 END + CASE WHEN {r} > 0 THEN {r} * log2({r} / (({p} + {r}) / 2)) ELSE 0 END)"
    chars = " + ".join(term(f"(c{i} / CAST(greatest(chars, 1) AS DOUBLE))", f"r.q{i}") for i in k)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS x FROM documents),
w AS MATERIALIZED (SELECT rid, regexp_extract_all(x, {_WORD}) AS w FROM d),
windows AS (SELECT rid, i, md5_number(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT rid, h FROM windows GROUP BY rid, h HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS place FROM windows JOIN twice USING (rid, h)) GROUP BY rid),
base AS MATERIALIZED (
  SELECT rid, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, {_WORD})) AS lines, coalesce(c.n, 0) AS n_repeat_words, length(x) AS chars, {counted}
  FROM d JOIN w USING (rid) LEFT JOIN covered c USING (rid)),
judged AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
low AS MATERIALIZED (SELECT rid, CASE WHEN length(y) > 1 AND regexp_matches(y, '[.,;:!?]$') THEN left(y, length(y) - 1) ELSE y END AS word FROM (SELECT rid, unnest(list_transform(w, lambda y: {_LOWER.format("y")})) AS y FROM w)),
counts AS MATERIALIZED (SELECT rid, word, count(*) AS n FROM low GROUP BY rid, word),
good AS (SELECT rid, lang FROM judged WHERE NOT base_failed AND lang IS NOT NULL),
totals AS (SELECT lang, CAST(sum(n) AS DOUBLE) AS n FROM good JOIN counts USING (rid) GROUP BY lang),
common AS MATERIALIZED (SELECT g.lang, word, sum(c.n) / any_value(t.n) AS q FROM good g JOIN counts c USING (rid) JOIN totals t ON t.lang = g.lang GROUP BY g.lang, word HAVING sum(c.n) >= {q.COMMON_COUNT} AND sum(c.n) >= any_value(t.n) * {q.COMMON_SHARE}),
shares AS (SELECT lang, {', '.join(f'sum(c{i}) / CAST(sum(chars) AS DOUBLE) AS q{i}' for i in k)} FROM judged WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang),
refs AS (SELECT s.*, coalesce((SELECT sum(q) FROM common c WHERE c.lang = s.lang), 0) AS cover, CAST((SELECT count(*) FROM common c WHERE c.lang = s.lang) AS DOUBLE) AS k FROM shares s JOIN totals USING (lang)),
met AS (SELECT rid, c.lang, sum({term('(n / CAST(n_words AS DOUBLE))', 'q')}) AS js, sum(q) AS q, CAST(sum(n) AS BIGINT) AS n FROM counts JOIN common c USING (word) JOIN judged USING (rid) GROUP BY rid, c.lang),
near AS (
  SELECT j.rid, r.lang, r.k, sqrt(greatest(({chars}) / 2, 0)) AS dc,
         sqrt(greatest((coalesce(m.js, 0) + (r.cover - coalesce(m.q, 0)) + {term("((j.n_words - coalesce(m.n, 0)) / CAST(greatest(j.n_words, 1) AS DOUBLE))", "(1 - r.cover)")}) / 2, 0)) AS dw
  FROM judged j JOIN refs r ON r.cover >= {q.COVER} OR r.lang = j.lang LEFT JOIN met m ON m.rid = j.rid AND m.lang = r.lang),
best AS (
  SELECT rid, bool_or((chars < {q.CHAR_MIN} OR dc <= {q.CHAR_LIMIT}) AND (n_words < {q.WORD_MIN} OR dw <= {q.WORD_LIMIT} + {q.WORD_NOISE} * sqrt(k / greatest(n_words, 1)))) AS passed, arg_min(dc, ROW(dc + dw, near.lang)) AS dc, arg_min(dw, ROW(dc + dw, near.lang)) AS dw
  FROM near JOIN judged USING (rid) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (coalesce(passed, false) OR lang IS NOT NULL AND lang NOT IN (SELECT lang FROM refs) OR lang IS NULL AND NOT EXISTS (SELECT 1 FROM refs WHERE cover >= {q.COVER})) AS kept,
       CASE WHEN chars >= {q.CHAR_MIN} THEN round(best.dc, 6) END AS char_distance, CASE WHEN n_words >= {q.WORD_MIN} THEN round(best.dw, 6) END AS word_distance
FROM judged LEFT JOIN best USING (rid)"""


_OP11 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.vec_id AS other_id, b.rid AS other, a.label = b.label AS same, CAST(list_inner_product(CAST(a.c AS DOUBLE[]), CAST(b.c AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid <> b.rid),
p AS (SELECT anchor, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, k ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


def _op12() -> str:
    """The jumps of each key one after the other, and checksums byte by byte over a table of 256 made by its rule."""
    steps, n = [], sharding.SHARDS + 1
    for i in range(1, n + 1):
        after = f"(k * {sharding.MULTIPLIER} + 1) % 18446744073709551616::UHUGEINT"
        steps.append(f"s{i} AS (SELECT * EXCLUDE (k, j, js), {after} AS k, CAST(floor((j + 1) * (2147483648 / CAST(({after}) // 8589934592 + 1 AS DOUBLE))) AS BIGINT) AS j, list_append(js, j) AS js FROM s{i - 1})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc),
sums AS MATERIALIZED (SELECT rid, doc_id, strlen(x) + 1 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(x), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM d, t),
s0 AS (SELECT *, CAST(coalesce(doc_id, 0) AS HUGEINT) AS signed_, CAST(CASE WHEN signed_ < 0 THEN signed_ + 18446744073709551616 ELSE signed_ END AS UHUGEINT) AS k, CAST(0 AS BIGINT) AS j, CAST([] AS BIGINT[]) AS js FROM sums),
{', '.join(steps)},
placed AS (SELECT doc_id, size, text_crc32, {', '.join(f"CAST(list_max(list_filter(js, lambda y: y < {m})) AS INTEGER) AS {c}" for c, m in (("shard", n - 1), ("grown_shard", n)))} FROM s{n})
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed"""


_OP13 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT lang, source, term, count(*) AS docs, sum(n) AS n FROM (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING sum(docs) >= {divergence.DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
cells AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n, sum(coalesce(t.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, k.n AS in_lang FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
shares AS MATERIALIZED (
  SELECT c.lang, source, term, c.n, 1 + CAST(1000000000 AS HUGEINT) * (c.n + 5) // (total + 5 * v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (in_lang + 5) // (langs.n + 5 * v) AS q FROM cells c JOIN langs ON langs.lang = c.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""
