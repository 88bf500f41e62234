"""The corpus pipeline: documents through the stages below, each written as Parquet and read again.

Every stage but the last returns the columns of documents. Null texts and texts without words do not pass
the first stage. Rows without an id are kept unless the quality rules reject them or they hold a benchmark
item. Rows of one id with different texts are judged apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, minhash, packing, quality_rules, secret_scans
from tessera.llm.common import materialize, own_scratch, remove, scratch, table, without
from tessera.llm.queries import RANKS, TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by language references of the stage's own input."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by a similarity of 0.8 or more."""
    return minhash.keep_one(docs, 0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A row goes by its own text: ids may be null or repeated."""
    found = materialize(decontamination.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "digest").distinct(), "found")
    return without(docs, found, doc_id=F.col("doc_id"), digest=F.unhex(F.sha2("text", 256)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by the name of their kind."""
    return secret_scans.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids, and their places in sequences."""
    return packing.pack(docs, TOKENIZER, RANKS, keep_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scans", secrets),
    ("packing", pack),
]

#: Language references, sketches and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage makes on its way is removed once it is written, and its input with it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        with own_scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
