"""A training-data pipeline over ``documents``: each stage works on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, language_id, ngram_join, packing, secret_scan
from corpusloom.llm.shared import discarding, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without a letter and those that no language fits go.

    The network learns from the documents' own languages.
    """
    net = language_id.fit(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text"))
    return language_id.accepted(docs, net, language_id.least_score(net))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays, and one of rows that repeat it."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the smallest doc_id stays."""
    return ngram_join.drop_near_copies(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked and n_chars counts what is left."""
    return secret_scan.redact(docs, secret_scan.standard_forest(spark)).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the first stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written as Parquet and read again, then its own tables go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with discarding(spark):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
