"""Integrity scans: inventory, checkpoint, batches, engine output, throughput and remaining time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabiya.operators.running import ordinals
from tabiya.session import cut


def inventory_hash(files: DataFrame, name: str = "name", size: str = "size", mtime: str | None = "mtime_ns") -> DataFrame:
    """Adds item_hash, the sha-256 of lower-case name, size and modification time."""
    parts = [F.lower(name), F.col(size).cast("string")] + ([F.col(mtime).cast("string")] if mtime else [])
    return files.withColumn("item_hash", F.sha2(F.concat_ws("|", *parts), 256))


def inventory_digest(files: DataFrame) -> DataFrame:
    """One row: a digest of the whole inventory, from item hashes in order. An inventory is a listing of one folder."""
    return files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("item_hash")), "\n"), 256).alias("inventory_hash"), F.count("*").alias("files"))


def pending(files: DataFrame, results: DataFrame, name: str = "name") -> DataFrame:
    """Files without an OK or FAIL result; names ignore case."""
    done = results.filter(F.col("status").isin("OK", "FAIL")).select(F.lower(name).alias("_key")).distinct()
    return files.withColumn("_key", F.lower(name)).join(done, "_key", "left_anti").drop("_key")


def checkpoint_summary(files: DataFrame, results: DataFrame, name: str = "name") -> DataFrame:
    """status (OK, FAIL, ERROR or MISSING) and how many files have it."""
    known = results.select(F.lower(name).alias("_key"), "status")
    joined = files.select(F.lower(name).alias("_key")).join(known, "_key", "left")
    return joined.groupBy(F.coalesce("status", F.lit("MISSING")).alias("status")).agg(F.count("*").alias("n"))


def batches(files: DataFrame, group: list[str], name: str, size: str, most_files: int = 8, most_bytes: int = 16 << 30, block: int = 1 << 14) -> DataFrame:
    """name, size, batch: files by lower-case name go to the open batch unless it is full or would exceed the bytes. group columns aren't null.

    The rule starts anew with each batch, but where a batch that begins at a file ends needs only the `most_files` after it; that is the file's
    successor. The files that begin batches are those that the first one leads to by successors: their paths double in length each round, so 2^k batches
    take k rounds, and no task holds a folder.
    """
    named = files.select(*group, F.lower(name).alias("_key"), F.col(name).alias("name"), F.col(size).cast("long").alias("size"))
    placed = cut(ordinals(named, group, ["_key", "name"], "i"))
    # Each block has the rows after it that its last ones may need.
    halo = placed.select(*group, "i", "size", F.explode(F.array_distinct(F.array(F.floor(F.col("i") / block), F.greatest(F.lit(0), F.floor((F.col("i") - most_files) / block))))).alias("b"))
    window = W.partitionBy(*group, "b").orderBy("i").rowsBetween(0, most_files - 1)
    ahead = halo.withColumn("ahead", F.collect_list("size").over(window)).filter(F.col("b") == F.floor(F.col("i") / block))
    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(a, x):
        full = a["full"] | ((a["n"] > 0) & (a["bytes"] + x > most_bytes))
        return F.struct((a["bytes"] + F.when(full, 0).otherwise(x)).alias("bytes"), (a["n"] + F.when(full, 0).otherwise(1)).alias("n"), full.alias("full"))

    count = F.aggregate("ahead", start, add, lambda a: a["n"])
    jump = cut(ahead.select(*group, "i", (F.col("i") + count).alias("to")))
    first = jump
    begins, k = cut(jump.filter("i = 0").select(*group, "i", F.lit(0).cast("long").alias("batch"))), 0
    while True:
        more = begins.join(jump, [*group, "i"]).join(first.select(*group, F.col("i").alias("to")), [*group, "to"], "left_semi")
        more = cut(more.select(*group, F.col("to").alias("i"), (F.col("batch") + (1 << k)).alias("batch")))
        if not more.limit(1).count():
            break
        begins = cut(begins.unionByName(more))
        jump, k = cut(jump.join(jump.select(*group, F.col("i").alias("to"), F.col("to").alias("far")), [*group, "to"]).select(*group, "i", F.col("far").alias("to"))), k + 1
    inside = begins.join(first, [*group, "i"]).select(*group, F.explode(F.sequence("i", F.col("to") - 1)).alias("i"), F.col("batch").cast("int").alias("batch"))
    return placed.join(inside, [*group, "i"]).select(*group, "name", "size", "batch")


def engine_results(lines: DataFrame, line: str = "line") -> DataFrame:
    """name and status of lines `name: OK!` and `name: FAIL!`."""
    pattern = r"^\s*(.+?):\s*(OK|FAIL)!\s*$"
    found = lines.select(F.regexp_extract(line, pattern, 1).alias("name"), F.regexp_extract(line, pattern, 2).alias("status"))
    return found.filter("status != ''")


def recency_mean(samples: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """A mean that halves the weight of older samples: total = total / 2 + x, weight = weight / 2 + 1, in order. At most a history's 64 samples a group."""
    ordered = samples.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("_samples"))
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w"))
    fold = F.aggregate("_samples", zero, lambda a, x: F.struct((a["t"] / 2 + x["v"]).alias("t"), (a["w"] / 2 + 1).alias("w")), lambda a: a["t"] / a["w"])
    return ordered.select(*group, fold.alias("mean"))


def nearest_sample(samples: DataFrame, wanted: DataFrame, machine: str, size: str, seconds: str) -> DataFrame:
    """wanted (sizes above 0) with the seconds of its machine's sample nearest in log size, between half and twice, scaled by the ratio; rows without one go.

    Of samples of one size the fastest counts, of two equally near ones the smaller. An as-of join by buckets of log size: the nearest sample on either side is
    in the row's own bucket or at the near end of the next one, so a machine with most samples is shared by tasks.
    """
    log = F.log2(F.col("_s").cast("double"))
    s = samples.filter(F.col(size) > 0).groupBy(F.col(machine).alias("_m"), F.col(size).alias("_s")).agg(F.min(seconds).cast("double").alias("_t")).withColumn("_b", F.floor(log))
    item = F.struct("_s", "_t")
    ends = s.groupBy("_m", "_b").agg(F.min(item).alias("lo"), F.max(item).alias("hi"))
    asked = wanted.select(F.col(machine).alias("_m"), F.col(size).alias("_s")).filter("_s > 0").distinct().withColumn("_b", F.floor(log))
    both = s.select("_m", "_b", "_s", item.alias("x")).unionByName(asked.select("_m", "_b", "_s", F.lit(None).cast(s.select(item).schema[0].dataType).alias("x")))
    up = W.partitionBy("_m", "_b").orderBy("_s", F.col("x").isNull()).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("_m", "_b").orderBy(F.desc("_s"), F.col("x").isNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.select("*", F.last("x", True).over(up).alias("below"), F.last("x", True).over(down).alias("above")).filter("x is null")
    found = found.join(ends.select("_m", (F.col("_b") + 1).alias("_b"), F.col("hi").alias("lower")), ["_m", "_b"], "left")
    found = found.join(ends.select("_m", (F.col("_b") - 1).alias("_b"), F.col("lo").alias("upper")), ["_m", "_b"], "left")
    near = F.array_compact(F.array(F.coalesce("below", "lower"), F.coalesce("above", "upper")))
    ratio = lambda x: F.col("_s") / x["_s"]
    fits = F.filter(near, lambda x: ratio(x).between(0.5, 2))
    best = F.array_min(F.transform(fits, lambda x: F.struct(F.abs(F.log(ratio(x))).alias("far"), x["_s"].alias("of"), (x["_t"] * ratio(x)).alias("estimate"))))
    found = found.select(F.col("_m").alias(machine), F.col("_s").alias(size), best["estimate"].alias("estimate")).filter("estimate is not null")
    return wanted.join(found, [machine, size]).select(*wanted.columns, "estimate")


def expected_seconds(samples: DataFrame, wanted: DataFrame, machine: str, size: str, fingerprint: str, order: str, seconds: str) -> DataFrame:
    """wanted with seconds: the recency-weighted mean of samples of the same machine, size and fingerprint, else the nearest sample's, scaled; else null."""
    same = [machine, size, fingerprint]
    mean = recency_mean(samples, same, order, seconds)
    near = nearest_sample(samples, wanted.select(machine, size).distinct(), machine, size, seconds)
    found = wanted.join(mean, same, "left").join(near, [machine, size], "left")
    return found.select(*wanted.columns, F.coalesce("mean", "estimate").alias("seconds"))


def throughput(results: DataFrame, group: list[str], size: str, seconds: str) -> DataFrame:
    return results.groupBy(*group).agg(F.sum(size).alias("bytes"), F.sum(seconds).alias("seconds"), (F.sum(size) / F.sum(seconds)).alias("rate"))
