"""Ordered rejection: the first rule that fits names the reason; null is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(df: DataFrame, rules: list[tuple[str, Column]], column: str = "reject") -> DataFrame:
    """One CASE, so accepted rows and reasons come from the same pass."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return df.withColumn(column, reason)


def accepted(df: DataFrame, column: str = "reject") -> DataFrame:
    return df.filter(F.col(column).isNull()).drop(column)


def reason_counts(df: DataFrame, by: list[str] | None = None, column: str = "reject") -> DataFrame:
    return df.groupBy(*(by or []), F.coalesce(column, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def game_rules(least_plies: int, least_elo: int = 0, most_gap: int = 0) -> list[tuple[str, Column]]:
    """no-result, setup, short, elo, elo-gap over result, tags, toks, white_elo and black_elo."""
    white, black = F.col("white_elo"), F.col("black_elo")
    both = white.isNotNull() & black.isNotNull()
    return [
        ("no-result", ~F.coalesce(F.trim("result").isin("1-0", "0-1", "1/2-1/2"), F.lit(False))),
        ("setup", (F.coalesce(F.col("tags")["SetUp"], F.lit("")) == "1") | (F.coalesce(F.col("tags")["FEN"], F.lit("")) != "")),
        ("short", F.size("toks") < least_plies),
        ("elo", F.lit(least_elo > 0) & (~both | (white < least_elo) | (black < least_elo))),
        ("elo-gap", F.lit(most_gap > 0) & both & (F.abs(white - black) > most_gap)),
    ]
