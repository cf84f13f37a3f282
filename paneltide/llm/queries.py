"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paneltide.llm import common, decontaminate, dominance, html_text, importance, line_dedup, near_dedup, packing, quality_model, quality_rules, secret_scan, simhash, span_dedup, toxicity
from paneltide.llm.sql import ORACLE


def op1_edit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(common.table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(common.table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(common.table(spark, sf_dir, "pages"))


def op6_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(common.table(spark, sf_dir, "documents"))


def op7_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.digest(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.digest(common.table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(common.table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(common.table(spark, sf_dir, "documents"))


def op11_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(common.table(spark, sf_dir, "documents"))


def op12_crc_ring_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op13_dominance_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.digest(common.table(spark, sf_dir, "sales"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_edit_match, op2_toxic_spans, op3_best_two_fit, op4_line_dedup, op5_main_text, op6_credential_links, op7_quadratic_discriminant, op8_sentence_spans, op9_near_duplicates, op10_quality_rules, op11_pigeonhole_simhash, op12_crc_ring_resampling, op13_dominance_tiles)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
