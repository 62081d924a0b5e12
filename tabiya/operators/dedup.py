"""Deterministic duplicates: the first of each key stays, by an explicit order.

A key that holds much of the table is pre-aggregated before it is shuffled: nothing here gathers a key's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; order should have no ties inside a key."""
    rest = [c for c in df.columns if c not in key and c not in order]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in key else F.col("_first")[c].alias(c) for c in df.columns])


def duplicate_status(df: DataFrame, key: list[str], source: str, seq: str, column: str = "status") -> DataFrame:
    """kept, or a duplicate: local (repeats inside its source) or cross (first of its source, but an earlier source has it).

    Rows join their source's first by key, source and place in it, so a frequent key doesn't gather.
    """
    firsts = df.groupBy(*key, source).agg(F.min(seq).alias(seq))
    # A window, not a join with an aggregate of firsts, for which df would be made once more; it orders one row for each source of a key.
    firsts = firsts.select(*key, source, seq, (F.col(source) == F.min(source).over(Window.partitionBy(*key))).alias("_best"))
    status = F.when(F.col("_best"), "kept").when(~F.col("_best"), "cross").otherwise("local")
    return df.join(firsts, [*key, source, seq], "left").withColumn(column, status).drop("_best")


def merge_sources(frames: list[DataFrame], key: list[str], seq: str) -> DataFrame:
    """The union of frames in that order, with the first of each key; rank is the frame's place."""
    merged = None
    for rank, frame in enumerate(frames):
        frame = frame.withColumn("rank", F.lit(rank))
        merged = frame if merged is None else merged.unionByName(frame, allowMissingColumns=True)
    return keep_first(merged, key, ["rank", seq])


def append_new(base: DataFrame, more: DataFrame, key: list[str], seq: str) -> DataFrame:
    """base as it is, and of `more` the first row of each key that base lacks; doing it twice changes nothing."""
    new = keep_first(more, key, [seq]).join(base.select(*key).distinct(), key, "left_anti")
    return base.unionByName(new)


def new_edges(edges: DataFrame, covered: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first occurrence of each edge that isn't covered."""
    return keep_first(edges.join(covered.select(*key).distinct(), key, "left_anti"), key, [seq])


def edge_sets(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """How many edges are only in old, only in new, and in both."""
    sides = old.select(*key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*key, F.lit(0).alias("o"), F.lit(1).alias("n")))
    each = sides.groupBy(*key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    count = lambda o, n: F.coalesce(F.sum(F.when((F.col("o") == o) & (F.col("n") == n), 1).otherwise(0)), F.lit(0)).cast("long")
    return each.agg(count(1, 0).alias("old_only"), count(0, 1).alias("new_only"), count(1, 1).alias("shared"))
