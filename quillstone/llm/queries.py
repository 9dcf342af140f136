"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import bpe, counts, extract, neardup, packing, pii, quality, rules, search, secrets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(table(spark, sf_dir, name))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.learned(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": _over("documents", bpe.encode),
    "op2_secrets": _over("documents", secrets.scan),
    "op3_search": lambda spark, d: search.search(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op4_packing": _over("documents", packing.pack),
    "op5_near_duplicates": _over("documents", neardup.near_duplicates),
    "op6_personal_data": _over("documents", pii.detect),
    "op7_quality_rules": _over("documents", rules.assess),
    "op8_token_counts": _over("documents", counts.count_tokens),
    "op9_quality_classifier": _classified,
    "op10_html_extraction": _over("pages", extract.extract),
}
SQL: dict[str, str] = {
    "op3_search": search.sql(),
    "op7_quality_rules": rules.sql(),
}
