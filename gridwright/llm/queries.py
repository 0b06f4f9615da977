"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import ann, bpe, contamination, language, licenses, secrets, simhash, substrings, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_outside_fold(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (toxicity.held_out("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), secrets.fit(spark))
    return found.select("doc_id", "start", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = toxicity.held_out("doc_id", 4) == 2
    model = language.fit(documents.select("doc_id", "text", "lang").where(~held_out))
    return language.identify(documents.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_neighbours": op1_neighbours,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_substrings": op4_substrings,
    "op5_language": op5_language,
    "op6_licenses": op6_licenses,
    "op7_secrets": op7_secrets,
    "op8_urls": op8_urls,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}

SQL: dict[str, str] = {
    "op4_substrings": r"""
with d as (select row_number() over () id, coalesce(doc_id, -9223372036854775808) k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
windows as (select id, k, s, array_to_string(w[s:s + 19], ' ') t from (select *, unnest(generate_series(1, len(w) - 19)) s from d)),
again as (select id, s from windows qualify rank() over (partition by t order by k, s) > 1),
gone as (select distinct id, unnest(generate_series(s, s + 19)) p from again),
words as (select id, unnest(w) word, unnest(generate_series(1, len(w))) p from d),
kept as (select id, string_agg(word, ' ' order by p) text, count(*) n from words anti join gone using (id, p) group by id)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(kept.text, '')) kept_sha256 from d left join kept using (id)
""",
}
