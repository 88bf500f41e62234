"""Sharding by jump consistent hashing: a key's shard is where its pseudo-random jumps end.

Lamping and Veach's generator is seeded with the key. From shard b the next jump leads to floor((b + 1) / r), r being
the generator's next number in (0, 1]; the last place below the number of shards is the key's. There is no table
of a ring, and the jumps do not depend on the number of shards: with one shard more, a key either stays or goes to
the new shard, which happens to one in so many keys.

The law of a sharding is `key`: rows of one key are in one shard, whatever else they hold. Keys of an integral type
seed the generator as they are, others by their hash; null counts as 0. Rows without a text have none to
count. Equal texts under different keys may lie apart. Repeated rows stand beside each other, each with its own slot.
A key that very many rows have makes its shard large, which the law asks for, but no task: rows are numbered and
written over ranges of (shard, key, text), never shard by shard. Slots number a shard's rows by key, checksum and
size, so they are the same in every run. Other columns are ignored, and kept where rows are written; an empty table
gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import numbered
from .common import materialize

SHARDS = 8
#: Jumps followed at once; keys that need more (none of up to so many shards, one in 10^20 of more) go through all.
JUMPS = 64
# The generator's multiplier, and the reach of its upper 31 bits.
MULTIPLIER, REACH = 2862933555777941757, float(1 << 31)
_HALF, _QUARTER = (1 << 32) - 1, (1 << 16) - 1
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & _HALF


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The two halves of state * MULTIPLIER + 1 modulo 2^64, by products that fit into a long."""
    times = lambda half: ((half.bitwiseAND(F.lit(_QUARTER))) * F.lit(_LOW), F.shiftright(half, 16) * F.lit(_LOW))
    (a, b), (c, d) = times(low), times(high)
    upper = lambda x: x.bitwiseAND(F.lit(_QUARTER)) * F.lit(1 << 16)
    own = a + upper(b) + 1
    return (F.shiftright(own, 32) + F.shiftright(b, 16) + low * F.lit(_HIGH) + c + upper(d)).bitwiseAND(F.lit(_HALF)), own.bitwiseAND(F.lit(_HALF))


def _jumps(state: Column, shards: int, most: int) -> Column:
    """The state (at, to, high, low) after so many jumps, or before the first that leads to `shards` or beyond."""

    def jump(s: Column, _: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        to = F.floor((s["to"] + 1) * (F.lit(REACH) / (F.shiftright(high, 1) + 1)))
        return F.when(s["to"] < shards, F.struct(s["to"].alias("at"), to.cast("long").alias("to"), high.alias("high"), low.alias("low"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, jump)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a long; null counts as 0."""
    if isinstance(shards, bool) or not isinstance(shards, int) or not 1 <= shards < 1 << 31:
        raise ValueError("the number of shards must be an integer of at least 1")
    key = F.coalesce(key, F.lit(0)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("to"), F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_HALF)).alias("low"))
    some = _jumps(start, shards, min(shards, JUMPS))
    if shards > JUMPS:
        some = F.transform(F.array(some), lambda s: F.when(s["to"] < shards, _jumps(s, shards, shards)).otherwise(s))[0]
    return some["at"].cast("int")


def shard(docs: DataFrame, shards: int, key: str = "doc_id") -> Column:
    """The shard of each row of docs."""
    kind = docs.schema[key].dataType
    return jump_hash(docs[key] if isinstance(kind, T.IntegralType) else F.when(docs[key].isNotNull(), F.xxhash64(docs[key])), shards)


def places(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row: its shard, its number there from 0,
    and its shard if there were one more. Texts are read once; what is sorted are the numbers about them."""
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    # The place in the table parts equal rows, so that ranges can be cut among them.
    facts = docs.select(docs["doc_id"], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), shard(docs, shards).alias("shard"), shard(docs, shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("_row"))
    facts = materialize(facts, "places")
    sizes = {r["shard"]: r["count"] for r in facts.groupBy("shard").count().collect()}  # one row per shard
    starts, total = [], 0
    for s in sorted(sizes):
        starts.append((s, total))
        total += sizes[s]
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "shard int, _start long"))
    found = numbered(facts, ["shard", "doc_id", "text_crc32", "size", "_row"], "_number").join(starts, "shard")
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_number") - 1 - F.col("_start")).alias("slot"), "grown_shard")


def _stored(rows: DataFrame, path: str, files: int) -> None:
    """rows with their shard, as `files` files of about as many rows in folders shard=0, shard=1 and so on."""
    spread = rows.repartitionByRange(files, "shard", F.xxhash64(*(F.to_json(F.struct(c)) if isinstance(rows.schema[c].dataType, T.MapType) else rows[c] for c in rows.columns)), F.monotonically_increasing_id())
    spread.write.mode("append").partitionBy("shard").parquet(path)


def write(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", files: int = 64) -> None:
    """docs as Parquet in a folder per shard. docs has no column named shard."""
    _stored(docs.withColumn("shard", shard(docs, shards, key)), path, files)


def read(spark: SparkSession, path: str, shards: int, key: str = "doc_id") -> DataFrame:
    """The rows of write(), each in the shard (a column) where it belongs among so many; what grow() has copied from
    there to another shard no longer counts."""
    found = spark.read.parquet(path)
    return found.where(F.col("shard") == shard(found, shards, key))


def grow(spark: SparkSession, path: str, shards: int, more: int, key: str = "doc_id", files: int = 64) -> None:
    """From `shards` to `more` shards: writes the rows that belong to the new shards, about 1 - shards/more of all, and
    touches no file that is there. A run that fails commits no file and can be repeated; one that is through can't."""
    if more <= shards:
        raise ValueError("shards can only be added")
    if not spark.read.parquet(path).where(F.col("shard") >= shards).isEmpty():
        raise ValueError(f"there are more than {shards} shards already")
    found = read(spark, path, shards, key)
    to = shard(found, more, key)
    _stored(found.where((F.col("shard") < shards) & (to >= shards)).withColumn("shard", to), path, files)
