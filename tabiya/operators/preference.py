"""Win, draw and loss evidence for each position and move, and the moves that it prefers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The one-sided 80 % quantile of the normal distribution.
Z80 = 0.8416212335729143


@dataclass(frozen=True)
class Evidence:
    """What a preferred move needs."""

    least_games: int = 32
    least_decisive: int = 4
    window: float = 0.035
    top: int = 2


@dataclass(frozen=True)
class Policy:
    """What an anchor move needs: games, decisive games, Wilson bound, distance from the best posterior, how many, and weights."""

    least_games: int = 32
    least_decisive: int = 4
    least_wilson: float = 0.50
    window: float = 0.035
    top: int = 2
    most_weight: int = 12


STRICT = Policy()
#: Thinner evidence for small or broad books, with less influence.
SMALL = Policy(least_games=8, least_decisive=2, least_wilson=0.40, window=0.025, top=1, most_weight=3)


def distinct_per_game(df: DataFrame, game: str, position: list[str], move: str) -> DataFrame:
    """A position and move count once in a game."""
    return df.dropDuplicates([game, *position, move])


def tally(df: DataFrame, position: list[str], move: str, outcome: str) -> DataFrame:
    """w, d, l, n, decisive and score of each position and move; outcome is 1 won, 2 drawn, 3 lost."""
    count = lambda k: F.sum(F.when(F.col(outcome) == k, 1).otherwise(0))
    stats = df.groupBy(*position, move).agg(count(1).alias("w"), count(2).alias("d"), count(3).alias("l"))
    return with_score(stats)


def with_score(stats: DataFrame) -> DataFrame:
    stats = stats.withColumn("n", F.col("w") + F.col("d") + F.col("l")).withColumn("decisive", F.col("w") + F.col("l"))
    return stats.withColumn("score", (F.col("w") + F.lit(0.5) * F.col("d") + 1) / (F.col("n") + 2))


def qualified(e: Evidence) -> Column:
    return (F.col("n") >= e.least_games) & (F.col("decisive") >= e.least_decisive)


def preferred(stats: DataFrame, position: list[str], move: str, e: Evidence = Evidence()) -> DataFrame:
    """Qualified moves within the window of their position's best one; the first `top` by score, games and move, as rn.

    Only aggregated rows are shuffled for the ranking.
    """
    of = W.partitionBy(*position)
    good = stats.filter(qualified(e)).withColumn("best", F.max("score").over(of)).filter(F.col("score") >= F.col("best") - F.lit(e.window))
    return good.withColumn("rn", F.row_number().over(of.orderBy(F.desc("score"), F.desc("n"), F.col(move)))).filter(F.col("rn") <= e.top).drop("best")


def model_counts(stats: DataFrame, position: list[str], move: str, e: Evidence = Evidence()) -> DataFrame:
    """positions, candidates, qualified, anchor_positions, anchor_signals, as one row."""
    chosen = preferred(stats, position, move, e)
    every = stats.agg(F.count_distinct(*position).alias("positions"), F.count("*").alias("candidates"), F.coalesce(F.sum(F.when(qualified(e), 1).otherwise(0)), F.lit(0)).alias("qualified"))
    some = chosen.agg(F.count_distinct(*position).alias("anchor_positions"), F.count("*").alias("anchor_signals"))
    return every.crossJoin(some)  # one row each


def wilson(stats: DataFrame) -> DataFrame:
    """Adds wilson (the 80 % lower bound of won among decisive) and posterior."""
    n, p = F.col("decisive").cast("double"), F.col("w") / F.col("decisive").cast("double")
    z2 = F.lit(Z80 * Z80)
    low = (p + z2 / (2 * n) - F.lit(Z80) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return stats.withColumn("wilson", F.when(F.col("decisive") > 0, low).otherwise(F.lit(0.0))).withColumn("posterior", (F.col("w") + 1) / (F.col("decisive") + 2))


def first_failure(p: Policy) -> Column:
    """The first rule that a move breaks, or ok."""
    return (
        F.when(F.col("n") == 0, "no-wdl")
        .when(F.col("n") < p.least_games, "below-games")
        .when(F.col("decisive") < p.least_decisive, "below-decisive")
        .when(F.col("w") <= F.col("l"), "not-positive")
        .when(F.col("wilson") < p.least_wilson, "below-wilson")
        .otherwise("ok")
    )


def evidence_weight(p: Policy) -> Column:
    """1 to most_weight, from the bound's excess, the number of games and the posterior."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    part = F.lit(0.45) * unit((F.col("wilson") - F.lit(p.least_wilson)) / F.lit(0.2)) + F.lit(0.35) * unit(F.log1p(F.col("n").cast("double")) / F.log1p(F.lit(10000.0)))
    part = part + F.lit(0.2) * unit((F.col("posterior") - F.lit(0.5)) / F.lit(0.5))
    return F.greatest(F.lit(1), F.least(F.lit(p.most_weight), 1 + F.round(F.lit(float(p.most_weight - 1)) * part).cast("int")))


def anchors(stats: DataFrame, position: list[str], move: str, p: Policy = STRICT) -> DataFrame:
    """Moves that break no rule, near the position's best posterior, by Wilson bound, games and move."""
    of = W.partitionBy(*position)
    ok = wilson(stats).filter(first_failure(p) == "ok").withColumn("best", F.max("posterior").over(of)).filter(F.col("posterior") >= F.col("best") - F.lit(p.window))
    ranked = ok.withColumn("rn", F.row_number().over(of.orderBy(F.desc("wilson"), F.desc("n"), F.col(move)))).filter(F.col("rn") <= p.top)
    return ranked.drop("best").withColumn("weight", evidence_weight(p))


def relative_weight(edges: DataFrame, node: list[str], weight: str) -> DataFrame:
    """Adds rel, the weight's per cent of all of its node; totals are aggregated first."""
    totals = edges.groupBy(*node).agg(F.sum(weight).alias("_total"))
    share = F.when(F.col("_total") == 0, F.lit(0.0)).otherwise(F.col(weight) * F.lit(100.0) / F.col("_total"))
    return edges.join(totals, node).withColumn("rel", share).drop("_total")
