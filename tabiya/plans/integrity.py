"""A checkpointed integrity scan: discover, plan batches, check, retry what a batch left open, keep results."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.operators import integrity
from tabiya.session import cut

RESULTS = "name string, status string, size long, detail string"
#: Checks the files of a batch and gives the engine's lines `name: OK!` or `name: FAIL!`.
Checker = Callable[[list[str]], list[str]]


def plan(files: DataFrame, results: DataFrame, most_files: int = 8, most_bytes: int = 16 << 30) -> DataFrame:
    """name, size, batch of files (name, bytes) that results don't settle."""
    left = integrity.pending(files, results).withColumn("folder", F.lit(""))
    return integrity.batches(left, ["folder"], "name", "bytes", most_files, most_bytes).select("name", "size", "batch")


def scan(planned: DataFrame, checker: Checker) -> DataFrame:
    """name, status, size, detail: batches are checked side by side; a file that its batch left open is checked alone, then is an ERROR."""
    batches = planned.groupBy("batch").agg(F.collect_list(F.struct("name", "size")).alias("files"))  # at most a batch's files
    batches = batches.repartition(F.col("batch"))

    def run(parts):
        import re

        line = re.compile(r"\s*(.+?):\s*(OK|FAIL)!\s*").fullmatch

        def check(names):
            try:
                return {m[1].lower(): m[2] for x in checker(names) if (m := line(x))}, ""
            except Exception as e:  # an engine that dies leaves its files open
                return {}, str(e)

        for part in parts:
            rows = []
            for files in part.column("files").to_pylist():
                found, why = check([f["name"] for f in files])
                for f in files:
                    status = found.get(f["name"].lower())
                    if status is None:
                        alone, why = check([f["name"]])
                        status = alone.get(f["name"].lower(), "ERROR")
                    rows.append((f["name"], status, f["size"], why or "no result" if status == "ERROR" else ""))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["name", "status", "size", "detail"])

    return batches.mapInArrow(run, RESULTS)


def update_checkpoint(results: DataFrame, new: DataFrame) -> DataFrame:
    """The latest result of each name, without regard to case."""
    both = results.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    latest = both.groupBy(F.lower("name").alias("k")).agg(F.min_by(F.struct("name", "status", "size", "detail"), "age").alias("r"))
    return latest.select("r.*")


def run_scan(spark: SparkSession, files: DataFrame, checker: Checker, checkpoint: str, probe: Checker | None = None, most_files: int = 8, most_bytes: int = 16 << 30) -> DataFrame:
    """Scans what the checkpoint folder doesn't settle and writes the results beside it, as a new version of the same inventory.

    A probe that doesn't fail on purpose stops the scan first. A checkpoint of another inventory is left alone and starts anew.
    """
    if probe is not None and not any("FAIL!" in x for x in probe(["intentional"])):
        raise RuntimeError("the engine accepts a damaged file")
    digest = integrity.inventory_digest(integrity.inventory_hash(files.withColumnRenamed("bytes", "size"), mtime=None)).first()[0]
    home = f"{checkpoint.rstrip('/')}/{digest}"
    try:
        results = spark.read.schema(RESULTS).parquet(home)
        results.limit(1).count()
    except Exception:  # no checkpoint of this inventory yet
        results = spark.createDataFrame([], RESULTS)
    new = cut(scan(plan(files, results, most_files, most_bytes), checker))
    merged = cut(update_checkpoint(results, new))
    merged.write.mode("overwrite").parquet(home)
    return merged
