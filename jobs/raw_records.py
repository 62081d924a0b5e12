"""Job: merges the text records of many sources into one raw set, in which the first record of each word sequence stays.

Each record gets a fate: rejected (for the first rule that it breaks), kept, local (repeats one of its own source) or cross (the first of its
source, but an earlier source has it). Order is (source, seq); records are the same if their words and results are.
Under `out`:
    records  fate=, shelf= : every record; kept ones with their text. A shelf is a source's name, made safe for paths.
    report   one JSON row for each source: seen, kept, local, cross, and each reason's count.
A run replaces both, so a rerun over the same table gives the same. Nulls in the text count as no words, those in the result as *.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from tabiya.functions import text as X
from tabiya.operators import dedup, reject

RECORDS = "seq long, source string, n_words int, reject string, sig string, text string, fate string, shelf string"
REASONS = ("empty", "short")
_GAPS = "[\\x20\\x09-\\x0D]+"


def records(docs: DataFrame, config: dict) -> DataFrame:
    """seq, source, text, n_words, reject, sig, shelf and fate of each document."""
    text = F.coalesce(F.col(config["text"]), F.lit(""))
    found = docs.select(
        F.col(config["seq"]).cast("long").alias("seq"),
        F.col(config["source"]).cast("string").alias("source"),
        text.alias("text"),
        F.coalesce(F.col(config["result"]).cast("string"), F.lit("*")).alias("result"),
        F.array_remove(F.split(text, _GAPS), "").alias("words"),
    )
    safe = F.regexp_replace(F.coalesce("source", F.lit("")), "[^A-Za-z0-9._-]", "_")
    plain = F.coalesce(F.col("source").rlike("^[A-Za-z0-9._-]+$"), F.lit(False))
    shelf = F.when(plain, F.col("source")).otherwise(F.concat(safe, F.lit("_"), F.substring(F.sha2(F.coalesce("source", F.lit("null")), 256), 1, 8)))
    found = found.select("seq", "source", "text", F.size("words").alias("n_words"), X.signature(F.col("words"), F.col("result")).alias("sig"), shelf.alias("shelf"))
    found = reject.classify(found, [("empty", F.col("n_words") == 0), ("short", F.col("n_words") < config["least_words"])])
    # The rows that take part in the comparison are narrow; rejected ones are compared under '', to no effect. Keys are never null: Spark would
    # filter nulls out where the table is read, and so make words and signatures again for the filter, several times.
    kept = F.col("reject").isNull()
    keyed = found.withColumn("sig", F.coalesce(F.when(kept, F.col("sig")), F.lit(""))).withColumn("shelf", F.coalesce("shelf", F.lit("")))
    status = dedup.duplicate_status(keyed, ["sig"], "shelf", "seq", "fate")
    return status.withColumn("sig", F.when(kept, F.col("sig"))).withColumn("fate", F.when(kept, F.col("fate")).otherwise("rejected"))


def report(found: DataFrame) -> DataFrame:
    count = lambda of: F.count_if(of)
    fates = [count(F.col("fate") == x).alias(x) for x in ("kept", "local", "cross")]
    return found.groupBy("shelf").agg(F.first("source", True).alias("source"), F.count("*").alias("seen"), *fates, *(count(F.col("reject") == x).alias(x) for x in REASONS))


def read(spark: SparkSession, out: str) -> DataFrame:
    """The records as they stand."""
    return spark.read.schema(RECORDS).parquet(f"{out}/records")


def run(spark: SparkSession, documents: str, out: str, config: dict) -> None:
    """Merges the records of a table of documents into a raw set without duplicates."""
    docs = spark.read.parquet(documents)
    log.info("read %d rows of %s", docs.count(), documents)
    found = records(docs, config).withColumn("text", F.when(F.col("fate") == "kept", F.col("text")))
    # Large shelves are split over several tasks, small ones share one.
    found = found.select("seq", "source", "n_words", "reject", "sig", "text", "fate", "shelf").hint("rebalance", "fate", "shelf")
    found.write.mode("overwrite").partitionBy("fate", "shelf").parquet(f"{out}/records")
    written = read(spark, out)
    report(written).write.mode("overwrite").json(f"{out}/report")
    for row in written.groupBy("fate").count().orderBy("fate").collect():  # at most four
        log.info("wrote %d rows as %s to %s/records", row["count"], row["fate"], out)


if __name__ == "__main__":
    command_line("raw_records", "documents", run)
