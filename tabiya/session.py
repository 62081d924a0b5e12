"""The session: sending this package to the executors, the shared folder, tables in place of lineage."""

from __future__ import annotations

import functools
import gc
import os
import tempfile
import uuid
import zipfile
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker: rows may hold long texts.
ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver has it; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tabiya-"), "tabiya_code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("tabiya", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        if spark.conf.get(ARROW, None) in (None, "67108864b", "64m", "64MB"):  # Spark's own; a cluster's choice stays
            spark.conf.set(ARROW, "4m")
        _sent.add(app)
    return spark


#: Bytes that may be broadcast, as Spark estimates them in memory, and rows; callers with more leave the choice to Spark.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 200_000
#: Bytes of stored input for each task that writes a table.
TASK_BYTES = 48 << 20
#: Bytes that a task holds in memory before it writes them.
ROW_GROUP_BYTES = 16 << 20
#: Paths of the tables of cut() that the scope that is open here has; threads and tasks of an event loop have scopes of their own. None: no scope is open.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
#: Plans' leaves that read no files, and the one that shows which it reads.
_WITHOUT_FILES, _WITH_FILES = {"LocalRelation", "OneRowRelation", "Range", "LogicalRDD", "CommandResult"}, "LogicalRelation"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tabiya-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes with the scope that it is made in, or with the driver."""
    path = f"{shared_dir(spark)}/tabiya/{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


def _leaves(df: DataFrame):
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [leaves.apply(i) for i in range(leaves.size())]


def stored_bytes(df: DataFrame) -> int:
    """What the tables and files that df reads hold, by the optimizer's statistics."""
    return sum(int(str(x.stats().sizeInBytes())) for x in _leaves(df) if x.getClass().getSimpleName() == "LogicalRelation")


def _paths(df: DataFrame) -> str | None:
    """The root paths of the files that df reads, as one text; None if that can't be told."""
    roots = []
    for x in _leaves(df):
        kind = x.getClass().getSimpleName()
        if kind == _WITH_FILES and x.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found = x.relation().location().rootPaths()
            roots += [found.apply(i).toString() for i in range(found.size())]
        elif kind not in _WITHOUT_FILES:
            return None
    return "\n".join(roots)


def reclaim(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files and broadcasts of queries that are done, and the driver give memory back.

    Spark deletes these once the driver's collector has found that nothing refers to them, which else may be long after; the query's own tables stay.
    """
    gc.collect()  # Python's references keep the JVM's
    spark._jvm.System.gc()


def release(df: DataFrame) -> DataFrame:
    """Deletes the tables of the innermost scope that df doesn't read; nothing else may need them. If it can't be told what df reads, all stay."""
    scope, roots = _scope.get(), _paths(df)
    if scope is None or roots is None:
        return df
    kept = []
    for path in scope:
        if path.rsplit("/", 1)[1] in roots:
            kept.append(path)
        else:
            _delete(df.sparkSession, path)
    scope[:] = kept
    reclaim(df.sparkSession)
    return df


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the table of cut() that df is; nothing may need it any more."""
    scope, roots = _scope.get() or [], _paths(df) or ""
    for path in [x for x in scope if x.rsplit("/", 1)[1] in roots]:
        _delete(df.sparkSession, path)
        scope.remove(path)


def scoped(make):
    """make() in a scope of its own: of the tables written in it, those stay that the DataFrame it returns reads; they pass to the scope around it."""

    @functools.wraps(make)
    def run(*args, **named):
        mine: list[str] = []
        token = _scope.set(mine)
        try:
            return release(make(*args, **named))
        finally:
            _scope.reset(token)
            if (around := _scope.get()) is not None:
                around.extend(mine)

    return run


def tasks_for(df: DataFrame, waves: int = 1) -> int:
    """Tasks that write a table: one for each TASK_BYTES of stored input, but `waves` for each core or an eighth of the shuffle partitions if these are more."""
    spark = df.sparkSession
    few = max(waves * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    return max(few, -(-stored_bytes(df) // TASK_BYTES))


def cut(df: DataFrame, waves: int = 1) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors cost no recomputation.

    Small tables are written by few tasks, each to one file; their number grows with the input (tasks_for), so that no task's work
    does. Tables whose making takes long for their size have more waves. No _SUCCESS file is made, since nothing looks for it: for each file on
    a local file system Spark starts a process, which counts as a second driver until it has begun.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.coalesce(tasks_for(df, waves)).write.option("parquet.block.size", ROW_GROUP_BYTES).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df if it is a table in files as it stands, else cut(df)."""
    return df if df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == _WITH_FILES else cut(df)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (from a table of cut()) with a broadcast hint if it has at most `rows` rows and BROADCAST_BYTES bytes, else as it is.

    A table that is stored in more bytes isn't looked at; of smaller ones the rows and the sizes of their values are added up.
    """
    if stored_bytes(df) > BROADCAST_BYTES:
        return df
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c)) if c in nested else F.col(c).cast("string")), F.lit(0)) + 16).cast("long") for c in df.columns)
    found = df.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["bytes"] or 0) <= BROADCAST_BYTES else df
