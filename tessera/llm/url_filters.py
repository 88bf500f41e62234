"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Everything here is DataFrame functions. A url's host is what stands after the first `://` up to `/`,
`?`, `#` or the end, with A-Z lower-cased; its path goes on up to `?`, `#` or the end. Without `://`,
and for null, both are empty.

Rules are strings host/path with a verdict. A rule fits its host and all of its subdomains if the
url's path starts with the rule's path; the longest fitting rule gives the verdict.

Urls that no rule fits are looked up in a list of canonical URLs. A listed entry is a host and path
without scheme, user, port, trailing dot, query and fragment; an entry that ends in `/` stands for
all below it. For one url the candidates are each suffix of its host of at least two labels, with each
leading directory of its path and the path itself, as far as the list's own entries reach: its greatest
numbers of labels and of directories are the bounds, so no listed entry is missed. The list is held in a blocked Bloom filter: a hash
picks one block of 256 bits, others pick bits within it, so a candidate is tested with one lookup and
a few bit operations. Possible hits then go to an exact hash join with the list, which removes the
false positives; a url is blocked if a candidate is listed.

The filter is sized from the list's count. It is broadcast only below `BROADCAST_BLOCKS` blocks, which
bounds its bytes; beyond that both sides are dealt by block. Hits are joined by a salted entry, and back to
the pages by a salted url, so that neither a hot entry nor a hot url gathers in one task.

Null and empty urls get empty host and path, no rule, and `allow`. Repeated rows are kept as they are.
Extra columns are ignored. An empty list lets everything pass; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_ENTRY = 16
PROBES = 5
#: 256 bits a block as four longs: 64k blocks are 2 MB of bits.
BROADCAST_BLOCKS = 1 << 16
SALTS = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url, by the rule above."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, r"^([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one overwrites
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def depth(canonical: Column) -> tuple[Column, Column]:
    """(labels, directories) of a listed entry; a last part that does not end in / is no directory."""
    host = F.regexp_extract(canonical, r"^([^/]*)", 1)
    rest = F.substring(canonical, F.length(host) + 2, F.length(canonical))
    return F.size(F.split(host, r"\.")), F.size(F.split(rest, "/")) - 1


def candidates(host: Column, path: Column, max_labels: int, max_directories: int) -> Column:
    """Canonical URLs under which a url may be listed, by entries of at most so many labels and directories;
    the whole host and the whole path are always among them."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.*(:[0-9]*)?$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    hosts = F.when(n < 2, F.array(bare)).otherwise(
        F.transform(F.sequence(F.greatest(F.lit(1), n - max_labels + 1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))
    )
    hosts = F.array_distinct(F.concat(F.array(bare), hosts))
    steps = F.split(F.regexp_replace(path, r"^/", ""), "/")
    upto = F.least(F.size(steps) - 1, F.lit(max_directories))
    folders = F.when(upto < 1, F.array(F.lit("/"))).otherwise(
        F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))))
    )
    paths = F.array_distinct(F.concat(folders, F.array(F.when(path == "", F.lit("/")).otherwise(path))))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def _block(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry, F.lit(17)), F.lit(blocks)).cast("int")


def _bit(entry: Column, probe: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(entry, F.lit(71)), 8 * probe), F.lit(256)).cast("int")


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the entries in column `canonical`."""
    masks = [
        [F.when(F.shiftright(_bit(F.col("canonical"), p), 6) == w, F.expr("shiftleft(1L, bit)".replace("bit", f"b{p} & 63"))).otherwise(F.lit(0).cast("long")) for p in range(PROBES)]
        for w in range(4)
    ]
    bits = listed.select("canonical", *(_bit(F.col("canonical"), p).alias(f"b{p}") for p in range(PROBES)))
    words = bits.select(_block(F.col("canonical"), blocks).alias("block"), *(_or(m).alias(f"w{w}") for w, m in enumerate(masks)))
    return words.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(4)))


def _or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _maybe(entry: Column) -> Column:
    """Whether all bits of an entry are set in the words w0..w3 of its block."""
    out = F.lit(True)
    for p in range(PROBES):
        bit = _bit(entry, p)
        word = F.element_at(F.array("w0", "w1", "w2", "w3"), F.shiftright(bit, 6) + 1)
        out = out & (F.getbit(word, bit.bitwiseAND(F.lit(63))) == 1)
    return out


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """pages(page_id, url) judged: page_id, host, path, rule, verdict. listed: column `canonical`."""
    listed = listed.select("canonical").where("canonical is not null").distinct()
    labels, directories = depth(F.col("canonical"))
    count, max_labels, max_directories = listed.agg(F.count("*"), F.greatest(F.max(labels), F.lit(2)), F.coalesce(F.max(directories), F.lit(0))).first()
    blocks = max(1, 1 << max(0, (count * BITS_PER_ENTRY // 256 - 1).bit_length()))
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = split.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    if not count:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"))
    filter_ = bloom_filter(listed, blocks)
    # Only what no rule decides is looked up, each distinct (host, path) once.
    open_ = judged.where("said is null and host <> ''")
    asked = open_.select("host", "path").distinct()
    entries = asked.select("host", "path", F.explode(candidates(F.col("host"), F.col("path"), max_labels, max_directories)).alias("canonical"))
    entries = entries.withColumn("block", _block(F.col("canonical"), blocks))
    possible = entries.join(F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_, "block").where(_maybe(F.col("canonical")))
    # Listed entries that may be hit are confirmed once each; then a hot one meets its urls in SALTS parts.
    confirmed = possible.select("canonical").distinct().join(listed, "canonical", "left_semi")
    confirmed = confirmed.select("canonical", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = possible.select("host", "path", "canonical", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt")).join(confirmed, ["canonical", "salt"])
    hits = met.select("host", "path").distinct()
    # One url may hold a large part of the pages: it is spread over salts, and a hit stands under each of them.
    hits = hits.select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("found"))
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    looked_up = salted.join(hits, ["host", "path", "salt"], "left").select(
        "page_id", "host", "path", "rule", F.when(F.col("found"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict")
    )
    return looked_up.unionByName(judged.where("said is not null or host = ''").select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict")))
