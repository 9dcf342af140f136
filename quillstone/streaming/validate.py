"""Validation of streams: rules row by row, repeated keys within a watermark, references against a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.validate import rules
from quillstone.schema import Model


def stream_rules(stream: DataFrame, model: Model) -> DataFrame:
    """Violations of a stream's rows: stateless, the same projection as for tables."""
    return rules(stream, model)


def first_seen(stream: DataFrame, key: str, time: str, lateness: str = "10 minutes") -> DataFrame:
    """The rows whose key wasn't seen within the watermark: state is bounded by the lateness that is allowed."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def stream_references(stream: DataFrame, column: str, to: DataFrame, key: str, model: str) -> DataFrame:
    """References that the static table doesn't have: a stream-static left join."""
    ids = to.select(F.col(f"`{key}`").alias("__key")).distinct()
    c = F.col(f"`{column}`")
    both = stream.join(ids, c == F.col("__key"), "left").where(c.isNotNull() & F.col("__key").isNull())
    return both.select(F.lit(model).alias("model"), F.lit(column).alias("attr"), c.cast("string").alias("value"))


def counts(stream: DataFrame, time: str, by: str, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Rows per window and value, append mode once a window is closed."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), F.col(f"`{by}`")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), f"`{by}`", "n")


__all__ = ["counts", "first_seen", "stream_references", "stream_rules"]
