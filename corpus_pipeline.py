"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept; its result is written as
Parquet in the shared folder and read again, so a lost executor repeats one
stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import langid, mixing, packing, pii, simhash
from tidegauge.llm.common import stored
from tidegauge.llm.queries import tokenizer

#: Texts less like every learned language than this go, as do those without a letter.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the corpus names; fills in a missing lang."""
    names = docs.columns
    found = langid.identify(docs.select(F.struct(*names).alias("row"), "text"), langid.learn(docs))
    good = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return good.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group whose five-word shingles are similar by 0.8 or more: candidates by SimHash and trie, an exact check."""
    return simhash.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a placeholder in the place of each span of personal data."""
    names = docs.columns
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*names)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops, keeps or doubles documents so that sources come to their target weights."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), "word", 2)


STAGES = [("language_id", language_id), ("simhash_dedup", near_dedup), ("pii", personal_data), ("mix_sources", source_mix), ("packing", pack)]

#: None: no SQL expresses these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
