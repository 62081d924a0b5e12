"""How far games follow selected moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def game_coverage(edges: DataFrame, game: str, position: list[str], move: str, selected: DataFrame) -> DataFrame:
    """covered (edges at a position with selected moves) and matched (edges that are one) of each game that covers any.

    Selected moves are few against edges; Spark broadcasts them if they are small enough, else joins by position.
    """
    chosen = selected.groupBy(*position).agg(F.collect_set(move).alias("_moves"))  # a few moves a position
    hit = edges.join(chosen, position)
    return hit.groupBy(game).agg(F.count("*").alias("covered"), F.sum(F.when(F.array_contains("_moves", F.col(move)), 1).otherwise(0)).alias("matched"))


def model_games(coverage: DataFrame, least_matched: int = 3, least_share: float = 0.80) -> DataFrame:
    share = F.col("matched") / F.col("covered").cast("double") + F.lit(1e-12)
    return coverage.filter((F.col("covered") > 0) & (F.col("matched") >= least_matched) & (share >= F.lit(least_share)))
