"""Run status, metrics in long form and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_run(overlay_empty: Column, book_failed: Column, partial: Column, skipped: Column) -> Column:
    """The first that holds: an overlay that wrote nothing hides a failed book, and so on."""
    return F.when(overlay_empty, "overlay-empty").when(book_failed, "bin-failed").when(partial, "partial").when(skipped, "skips").otherwise("ok")


def metrics(stage: str, counts: DataFrame) -> DataFrame:
    """stage, name, value of a one-row table of counts: from aggregates, so a retried task counts nothing twice."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in counts.columns])
    return counts.select(F.lit(stage).alias("stage"), F.inline(pairs))


def report_lines(values: DataFrame) -> DataFrame:
    """One line of text per metric."""
    return values.select(F.concat(F.rpad("stage", 12, " "), F.rpad("name", 28, " "), F.format_number("value", 0)).alias("value"))
