"""Writers: game text, statistics, and checks of what was written. Files appear whole, by Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.functions import text as X

CANONICAL = ("Event", "Site", "Date", "Round", "White", "Black", "Result", "WhiteElo", "BlackElo", "TimeControl")
VERSION = "tabiya 1"


def _tag(name: Column, value: Column) -> Column:
    return F.concat(F.lit("["), name, F.lit(' "'), X.escape(value), F.lit('"]\n'))


def raw_text(source: str = "path", tags: str = "tags", order: str = "tag_order", toks: str = "toks", result: str = "result") -> Column:
    """A game: ten canonical tags that hold something, the others in their order without FEN and SetUp, version, source, moves."""
    head = []
    for t in CANONICAL:
        value = F.col(result) if t == "Result" else F.coalesce(F.col(tags)[t], F.lit(""))
        head.append(F.when(value != "", _tag(F.lit(t), value)).otherwise(F.lit("")))
    rest = F.filter(order, lambda t: ~t.isin(*CANONICAL, "FEN", "SetUp"))
    rest = F.array_join(F.transform(rest, lambda t: _tag(t, F.element_at(F.col(tags), t))), "")
    own = F.concat(_tag(F.lit("Generator"), F.lit(VERSION)), _tag(F.lit("Source"), F.col(source)))
    return F.concat(*head, rest, own, F.lit("\n"), X.movetext(F.col(toks)), F.lit(" "), F.col(result), F.lit("\n"))


def model_text() -> Column:
    """A model game: a fixed set of tags, its originals kept under Original names, preference coverage, canonical moves."""
    original = [F.when(F.coalesce(F.col("tags")[t], F.lit("")) != "", _tag(F.lit("Original" + t), F.col("tags")[t])).otherwise(F.lit("")) for t in ("Event", "Site", "Date", "White", "Black")]
    head = [_tag(F.lit("Event"), F.lit("Model game")), _tag(F.lit("Result"), F.col("result")), *original, _tag(F.lit("OriginalResult"), F.col("result"))]
    share = F.concat(F.col("matched").cast("string"), F.lit("/"), F.col("covered").cast("string"))
    return F.concat(*head, _tag(F.lit("PreferenceCoverage"), share), F.lit("\n"), X.movetext(F.col("san")), F.lit(" "), F.col("result"), F.lit("\n"))


def adapter_text(width: int = 100) -> Column:
    """A game of a database set as it was converted: all its tags in order, and its move text wrapped."""
    tags = F.array_join(F.transform("tag_order", lambda t: _tag(t, F.element_at(F.col("tags"), t))), "")
    return F.concat(tags, F.lit("\n"), wrapped(F.col("movetext"), width), F.lit("\n"))


def line_text(line: str = "line", event: str = "Book line", width: int = 0) -> Column:
    """A book or overlay line with neutral tags and no result; with a width, moves are wrapped at it."""
    moves = X.movetext(F.col(line))
    head = F.concat(_tag(F.lit("Event"), F.lit(event)), _tag(F.lit("Result"), F.lit("*")), _tag(F.lit("PlyCount"), F.size(line).cast("string")))
    body = F.concat(moves, F.lit(" *"))
    return F.concat(head, F.lit("\n"), wrapped(body, width) if width else body, F.lit("\n"))


def wrapped(text: Column, width: int) -> Column:
    """Words in lines of at most width characters."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def step(a, w):
        longer = F.length(a["line"]) + 1 + F.length(w) > width
        return F.struct(
            F.when(longer & (a["line"] != ""), F.concat(a["done"], a["line"], F.lit("\n"))).otherwise(a["done"]).alias("done"),
            F.when((a["line"] == "") | longer, w).otherwise(F.concat(a["line"], F.lit(" "), w)).alias("line"),
        )

    return F.aggregate(F.split(text, " "), start, step, lambda a: F.concat(a["done"], a["line"]))


def clean_tag(value: Column) -> Column:
    """Control characters and runs of white space become one space; nothing becomes ?."""
    text = F.trim(F.regexp_replace(value, r"[\x00-\x20\x7f]+", " "))
    return F.when(F.coalesce(text, F.lit("")) == "", "?").otherwise(text)


def write_text(df: DataFrame, text: Column, order: list[str], path: str, by: list[str] | None = None) -> None:
    """Records in order, a blank line after each; `by` columns become folders. Sorted ranges keep the order across files."""
    rows = df.select(*(by or []), *[c for c in order if c not in (by or [])], text.alias("value"))
    rows = rows.repartitionByRange(*(by or []), *order).sortWithinPartitions(*(by or []), *order).select(*(by or []), "value")
    writer = rows.write.option("lineSep", "\n\n")
    (writer.partitionBy(*by) if by else writer).text(path)


def write_statistics(entries: DataFrame, path: str) -> None:
    """One JSON object per position; bytes as base64."""
    columns = [F.base64(c).alias(c) if k == "binary" else F.col(c) for c, k in entries.dtypes]
    entries.select(*columns).write.json(path)


def written_records(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many records a written folder holds, by their Result tags."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.agg(F.sum(F.when(F.col("value").startswith('[Result "'), 1).otherwise(0)).alias("records"))


def require_count(spark: SparkSession, path: str, expected: int) -> None:
    found = written_records(spark, path).first()[0] or 0
    if found != expected:
        raise ValueError(f"{path} holds {found} records, not {expected}")
