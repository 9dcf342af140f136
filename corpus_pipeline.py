"""The corpus pipeline: quality rules, quality classifier, near-duplicate removal, secret redaction, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.cluster import delete, shared_dir
from quillstone.llm import neardup, packing, quality, rules, secrets
from quillstone.llm.queries import table


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept(docs)


def _classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The field is trained on the given tables, not on what the stage before left, so that it knows what bad documents look like."""
    return quality.kept(docs, quality.learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their redacted texts and all other columns, each with its place in a batch."""
    return packing.pack(docs, keep=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", _rules),
    ("quality classifier", _classifier),
    ("near duplicates", _near_duplicates),
    ("secrets", _secrets),
    ("packing", _packing),
]
#: SQL expresses neither the field, the signatures nor the automata: tests/llm holds the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; what each leaves is written to the shared folder and read again as the next one's input.

    The result is the last stage's table; the tables between are deleted as soon as they were read, also where a stage fails. Null, empty and wordless texts
    go with the first stage; long ones are read whole; of repeated rows one stays; columns of any name are kept; an empty table gives an empty one.
    """
    import uuid

    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done = -1
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
            docs, done = spark.read.parquet(f"{at}/{k}"), k
            if k:
                delete(spark, f"{at}/{k - 1}")
        return docs
    finally:
        if done < len(STAGES) - 1:
            delete(spark, at)
