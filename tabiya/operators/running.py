"""Running totals inside a source, in two levels, so that a large source isn't one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabiya.session import cut


def running_totals(df: DataFrame, source: list[str], seq: str, totals: dict[str, str], block: int = 1 << 16) -> DataFrame:
    """Adds running sums {new column: summed column} over rows with a seq up to each row's own.

    Blocks of consecutive seq values are summed up first; a task then orders one block, or the blocks of a source.
    """
    df = df.withColumn("_block", F.floor(F.col(seq) / block))
    sums = df.groupBy(*source, "_block").agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    before = W.partitionBy(*source).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*source, "_block", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    inside = W.partitionBy(*source, "_block").orderBy(seq)
    df = df.select("*", *[F.sum(c).over(inside).alias(n) for n, c in totals.items()]).join(sums, [*source, "_block"])
    for n in totals:
        df = df.withColumn(n, F.col(n) + F.col(f"_{n}"))
    return df.drop("_block", *[f"_{n}" for n in totals])


def error_alerts(df: DataFrame, source: list[str], seq: str, bad: str, least: int = 100, percent: int = 10) -> DataFrame:
    """Bad rows at which at least `least` rows were seen and at least `percent` of them were bad."""
    counted = df.withColumn("_one", F.lit(1)).withColumn("_bad", F.when(F.col(bad), 1).otherwise(0))
    seen = running_totals(counted, source, seq, {"seen": "_one", "bad_seen": "_bad"})
    return seen.filter(F.col(bad) & (F.col("seen") >= least) & (F.col("bad_seen") * 100 >= F.col("seen") * percent)).drop("_one", "_bad")


def ordinals(df: DataFrame, group: list[str], order: list[str], column: str = "ordinal") -> DataFrame:
    """A table of df with each row's place (from 0) in its group by `order`, which has no ties inside a group.

    Rows are sorted by ranges, so a group that holds most rows is shared by tasks; a task numbers its own, and the counts of ranges before are added.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy("_range", *group).orderBy(*order))
    numbered = ranged.withColumn("_place", inside).join(bases, [*group, "_range"])
    return numbered.select(*df.columns, (F.col("_base") + F.col("_place") - 1).alias(column))
