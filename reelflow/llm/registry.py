"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.llm import chat, decontaminate, html, language, minhash, mixing, periodic, quality, secrets, spelling, spotsigs, toxicity, urls
from reelflow.llm.common import read


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identified(read(spark, sf, "documents"), read(spark, sf, "pages"))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.grades(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op3_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secrets(read(spark, sf, "documents"))


def op4_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.main_texts(read(spark, sf, "pages"))


def op5_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urls.verdicts(read(spark, sf, "pages"))


def op6_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return spotsigs.fingerprints(read(spark, sf, "documents"))


def op7_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and conversation -7, whose texts are full of marks."""
    given = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    marks = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.formatted(given.union(marks)))


def op8_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf, "documents"))


def op9_mixing_to_targets(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(read(spark, sf, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.with_repeated_tails(read(spark, sf, "documents"))))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf, "documents"), spelling.DELETED)


def op13_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judged(read(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_secret_scans, op4_html_extraction, op5_url_filters, op6_document_fingerprints, op7_chat_formatting, op8_minhash_near_dedup, op9_mixing_to_targets, op10_benchmark_decontamination, op11_periodic_runs, op12_spelling_variants, op13_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_formatting": chat.oracle_sql(), "op9_mixing_to_targets": mixing.oracle_sql(), "op11_periodic_runs": periodic.oracle_sql(), "op12_spelling_variants": spelling.oracle_sql()}
