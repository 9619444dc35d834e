"""The corpus pipeline: documents to encoded training rows in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import bpe, langid, mixing, neardup, secrets
from factorloom.llm.common import scratch, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those that no learned language codes in under 8 bits a byte; a null lang is filled in."""
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.predict(docs, model, keep=tuple(docs.columns), names=("__lang", "__score", "__bits"))
    known = found.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__bits") < 8))
    return known.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return neardup.keep_one(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked."""
    clean = secrets.redact(docs, secrets.train(secrets.sample_findings(spark)), path_col="source")
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times."""
    rated = mixing.mix(docs, names=("__size", "__source_size", "__target", "__copies"))
    return rated.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of what they decode to."""
    codec = bpe.Codec.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = bpe.encode(docs, codec, decoded=True)
    return both.select("doc_id", "n_tokens", "ids", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("secrets", no_secrets),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: Statistical models, sketches and merges are beyond SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = table(spark, sf_dir, "documents")
    at = scratch(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
