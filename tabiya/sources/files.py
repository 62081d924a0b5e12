"""What a folder holds: sources, their kinds and side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SKIPPED_FOLDERS = (".git", "temp", "!output")
#: How names of files begin that a run itself has written.
OWN_FILES = ("tabiya_raw", "tabiya_metal")
OVERLAY = "overlay-pgn"
SIDE_FILES = {"CTG": ("cto", "ctb"), "CBH": ("cbg", "cbp", "cbt"), "2CBH": ("2cbg", "2lid")}
VOLUME_FOLDERS = ("system volume information", "$recycle.bin", "recycler")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path and bytes of all files below root: their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))


def _folders(path: Column, root: str) -> Column:
    """Lower-case folder names between root and the file."""
    inside = F.expr("substring(path, length(root_) + 1)")
    return F.slice(F.split(F.lower(inside), "/"), 1, F.size(F.split(inside, "/")) - 1)


def inventory(files: DataFrame, root: str, skipped_folders: tuple[str, ...] = SKIPPED_FOLDERS, own: tuple[str, ...] = OWN_FILES) -> DataFrame:
    """src_id, kind, path, base, bytes, complete of the sources among files (path, bytes), in the order kind, lower-case path.

    Extensions and folder names ignore case. Own results (by how their names begin) and skipped folders are left out; sets without all side files are
    listed as incomplete. Games are overlays if their name ends in .overlay.pgn or a folder (root itself, too) says so.
    """
    root = root.rstrip("/")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    f = files.withColumn("root_", F.lit(root)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    f = f.withColumn("name_", name).withColumn("dirs_", _folders(F.col("path"), root))
    skipped = F.exists("dirs_", lambda x: x.isin(*skipped_folders) | x.endswith("_output"))
    f = f.filter(~skipped)
    for prefix in own:
        f = f.filter(~F.col("name_").startswith(prefix))
    ext = F.element_at(F.split("name_", r"\."), -1)
    f = f.withColumn("ext_", ext).withColumn("stem_", F.lower(F.expr("substring(path, 1, length(path) - length(ext_) - 1)")))
    overlay = F.col("name_").endswith(".overlay.pgn") | F.array_contains("dirs_", OVERLAY) | F.lit(root.rsplit("/", 1)[-1].lower() == OVERLAY)
    kind = F.when((F.col("ext_") == "pgn") & overlay, "OVERLAY-PGN")
    for e, k in (("pgn", "PGN"), ("bin", "BIN"), ("ctg", "CTG"), ("cbh", "CBH"), ("2cbh", "2CBH")):
        kind = kind.when(F.col("ext_") == e, k)
    sides = f.groupBy("stem_").agg(F.collect_set("ext_").alias("exts_"))  # a handful of extensions each
    f = f.withColumn("kind", kind).filter("kind is not null").join(sides, "stem_")
    complete = F.lit(True)
    for k, needed in SIDE_FILES.items():
        complete = F.when(F.col("kind") == k, F.forall(F.array(*[F.lit(x) for x in needed]), lambda x: F.array_contains("exts_", x))).otherwise(complete)
    f = f.withColumn("complete", complete).withColumn("base", F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*)\.[^.]*$", 1))
    f = f.withColumn("src_id", F.row_number().over(W.orderBy("kind", F.lower("path"))) - 1)  # a folder's listing, not its contents
    return f.select("src_id", "kind", "path", "base", "bytes", "complete")


def output_names(sources: DataFrame) -> DataFrame:
    """Adds a name that no other file of the kind gets: a repeated base is followed by eight hex digits of its path's hash."""
    again = F.row_number().over(W.partitionBy("kind", F.lower("base")).orderBy("src_id")) > 1
    safe = F.regexp_replace("base", r"[^A-Za-z0-9._-]", "_")
    return sources.withColumn("name", F.when(again, F.concat_ws("_", safe, F.substring(F.sha2(F.lower("path"), 256), 1, 8))).otherwise(safe))


def tablebase_files(files: DataFrame, root: str, recursive: bool = True) -> DataFrame:
    """name, path, bytes of .rtbw and .rtbz files, by lower-case name; volume folders directly below root are left out."""
    root = root.rstrip("/")
    f = files.withColumn("root_", F.lit(root)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    f = f.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("dirs_", F.filter(_folders(F.col("path"), root), lambda x: x != ""))
    f = f.filter(F.lower("name").rlike(r"\.rtb[wz]$") & ~F.coalesce(F.get("dirs_", F.lit(0)).isin(*VOLUME_FOLDERS), F.lit(False)))
    return (f if recursive else f.filter(F.size("dirs_") == 0)).select("name", "path", "bytes").orderBy(F.lower("name"))


def fingerprints(spark: SparkSession, paths: list[str], part: int = 64 << 10) -> DataFrame:
    """path, bytes and a sha-256 of size and three samples (start, middle, end) of each file."""
    f = spark.read.format("binaryFile").load(paths)
    middle = F.greatest(F.lit(1), F.floor(F.col("length") / 2 - part / 2) + 1).cast("int")
    last = F.greatest(F.lit(1), F.col("length") - part + 1).cast("int")
    cut = lambda at: F.substring("content", at, F.lit(part))
    data = F.concat(F.col("length").cast("string").cast("binary"), cut(F.lit(1)), cut(middle), cut(last))
    return f.select("path", F.col("length").alias("bytes"), F.sha2(data, 256).alias("fingerprint"))


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """sha256 and path, relative to root, of all files below it but those in TEMP, by path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    return f.select(F.sha2("content", 256).alias("sha256"), path.alias("path")).filter(~F.col("path").startswith("TEMP/")).orderBy("path")
