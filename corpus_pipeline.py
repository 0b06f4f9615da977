"""A pipeline over documents: toxicity, near-duplicates, benchmark passages, secrets, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import bpe, contamination, secrets, simhash, toxicity
from gridwright.llm._shared import fresh, key_of, settle

#: Near-duplicates: shingles of five words, and the least similarity that their fingerprints must show.
WIDTH, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. The model learns as op9 does, from the whole table's labels."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit_outside_fold(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "_score")
    return toxicity.score_texts(docs, model, score=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, and one row of it."""
    return simhash.drop_near_duplicates(docs, width=WIDTH, similarity=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = contamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    (key,) = fresh(docs, "_key")
    # written, so that its size is known when the join is planned: texts are exchanged only if there are too many hits to send
    hit = settle(found.select(key_of("doc_id").alias(key)).distinct(), "pipeline-contaminated")
    return docs.withColumn(key, key_of("doc_id")).join(hit, key, "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays. n_chars follows the text."""
    masked = secrets.redact(docs, secrets.fit(spark))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.bpe_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet into the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
