"""The operators as registered queries: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import best_fit_packing, language_id, line_dedup, media_columns, minhash_forest, quality_rules, suffix_dedup, template_decontamination, token_counts, url_filters
from lodestone.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.judged(table(spark, sf_dir, "documents"), threshold=2, least=1, linked=16).drop("row")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_columns(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), depth=50)


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_media_columns, op4_url_filters, op5_suffix_dedup, op6_minhash_forest, op7_template_decontamination, op8_best_fit_packing, op9_language_id, op10_quality_rules)}
ORACLES: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE, "op4_url_filters": url_filters.ORACLE, "op6_minhash_forest": minhash_forest.ORACLE}
