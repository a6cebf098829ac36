"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_dedup, html_text, language, licenses, merkle, mixing, packing, quality, secrets, simhash, substring_dedup, warc
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.deduplicate_substrings(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(exact_dedup.exact_duplicates(*exact_dedup.by_arrival(table(spark, sf_dir, "documents"))))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(html_text.extract_text(table(spark, sf_dir, "pages")))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve(warc.captures(table(spark, sf_dir, "pages"))))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_scores(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.tampered(docs))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_quality_rules, op3_exact_dedup, op4_html_text, op5_simhash_near_dedup, op6_mixing, op7_language_id, op8_packing, op9_secret_scan, op10_warc_revisits, op11_token_alignment, op12_merkle_manifest, op13_license_scan)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.oracle(), "op3_exact_dedup": exact_dedup.ORACLE, "op6_mixing": mixing.ORACLE, "op10_warc_revisits": warc.ORACLE, "op12_merkle_manifest": merkle.oracle()}
