"""Token counts: an exact length histogram whose suffix sums answer every context limit.

Nulls and empty texts count as length 0 (1 with an end id). Repeated rows count each time. An empty table
gives an empty histogram. The histogram has one row per distinct length, so its size is bounded by the
longest document, not by the number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabiya.llm.common import cut, scoped, table
from tabiya.llm.tokens import Vocabulary, token_counts

#: Lengths in a first-level group of the suffix sums.
GROUP = 256


def length_histogram(counts: DataFrame, column: str = "n_tokens") -> DataFrame:
    """length, n_docs."""
    return counts.groupBy(F.col(column).alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Answers for the context limit L = length, for each length that occurs; the histogram is read twice (so: a table).

    docs_ge, tokens_ge: documents at least L long, and their tokens; docs_le: those at most L long;
    truncated_tokens: the sum of min(length, L); cdf: the share of documents at most L long, whose first
    length with cdf >= q is the q-quantile. Totals go by group first, so no task orders all lengths by more than GROUP.
    """
    h = histogram.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("g", F.floor(F.col("length") / GROUP))
    groups = h.groupBy("g").agg(F.sum("n_docs").alias("gd"), F.sum("tokens").alias("gt"))
    later = W.orderBy(F.desc("g")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    groups = groups.select(
        "g",
        F.coalesce(F.sum("gd").over(later), F.lit(0)).alias("after_d"),
        F.coalesce(F.sum("gt").over(later), F.lit(0)).alias("after_t"),
        F.sum("gd").over(everything).alias("all_d"),
        F.sum("gt").over(everything).alias("all_t"),
    )
    inside = W.partitionBy("g").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    h = h.select("*", F.sum("n_docs").over(inside).alias("in_d"), F.sum("tokens").over(inside).alias("in_t")).join(groups, "g")
    h = h.withColumn("docs_ge", F.col("in_d") + F.col("after_d")).withColumn("tokens_ge", F.col("in_t") + F.col("after_t"))
    return h.select(
        "length",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("all_d") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        (F.col("all_t") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_tokens"),
        ((F.col("all_d") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_d")).alias("cdf"),
    )


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents doesn't exceed."""
    return sums.filter(F.col("cdf") >= q).agg(F.min("length")).first()[0]


def truncated_total(sums: DataFrame, limit: int) -> int:
    """The sum of min(length, limit) for any limit, from the nearest longer length that occurs."""
    longer = sums.filter(F.col("length") >= limit).orderBy("length").first()
    if longer is None:
        last = sums.orderBy(F.desc("length")).first()
        return 0 if last is None else last["truncated_tokens"]
    return longer["truncated_tokens"] - (longer["length"] - limit) * longer["docs_ge"]


@scoped
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary(spark)
    return suffix_sums(cut(length_histogram(token_counts(table(spark, sf_dir, "documents"), vocabulary))))
