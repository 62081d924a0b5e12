"""Mixing sources to target weights by Pareto order sampling, in words.

Sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words by weight; no target exceeds
`most` times its source's words, and what it leaves is shared among the others by weight. Inside a source a
document's expected copies are proportional to the root of its words, at most `most`, and scaled so that expected words meet the
target. Whole copies are certain; the fraction left is an inclusion probability p. Documents rank by their random
odds over those odds, u/(1-u) / (p/(1-p)), and those ranked first are taken once more as long as they fit into the
source's words left; what then is left open goes to documents ranked next that still fit. u comes from an md5 of the
doc_id, so reruns agree.

The ranks of a source are never sorted as a whole: bins of the rank, about BIN documents each, are added up, and only the
bin in which the words run out is ordered and filled. The per-source plan is a row per source.

Null texts have no words and are taken 0 times. Rows that repeat a doc_id and size share their rank and stand together. An
empty table gives no rows. Texts may be of any length. Extra columns pass by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabiya.llm.common import WORD_PATTERN, bounded_broadcast, cut, quoted, scoped, table

BIN = 2000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _root(size: str) -> Column:
    """A document's weight, as a whole number, so that sums don't depend on their order."""
    return F.floor(F.sqrt(F.col(size).cast("double")) * 1024).cast("long")


def _big(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def source_targets(sizes: DataFrame, most: int = 3, cycle: int = 3) -> DataFrame:
    """source, n, source_size, target.

    Sources may be as many as hosts: they are ranked inside ranges, and the level of the shares is found over bins of equal ratios.
    """
    place = F.col("source").asc_nulls_last()
    s = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    s = cut(s.repartitionByRange(place).withColumn("part", F.spark_partition_id()))
    parts = s.groupBy("part").agg(F.count("*").alias("k"))
    parts = parts.select("part", F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.row_number().over(W.partitionBy("part").orderBy(place)) - 1
    s = s.join(F.broadcast(parts), "part").select("source", "n", "source_size", (1 + rank % cycle).alias("weight"), (F.col("source_size") * most).alias("most"))
    s = cut(s.withColumn("ratio", F.col("most") / F.col("weight")))
    equal = s.groupBy("ratio", F.floor(F.log2("ratio") * 64).alias("bin")).agg(F.sum("most").alias("m"), F.sum("weight").alias("w"), F.sum("source_size").alias("z"))
    bins = equal.groupBy("bin").agg(*(F.sum(c).alias(c) for c in "mwz"))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over, all_ = W.orderBy(F.col("bin").asc_nulls_first()), W.partitionBy()
    bins = bins.select(F.col("bin").alias("b"), *(earlier(over, c).alias(f"{c}1") for c in "mw"), F.sum("z").over(all_).alias("all_z"), F.sum("w").over(all_).alias("all_w"))
    inside = W.partitionBy("bin").orderBy("ratio")
    levels = equal.select("ratio", "bin", *(earlier(inside, c).alias(f"{c}2") for c in "mw")).join(F.broadcast(bins), F.col("bin").eqNullSafe(F.col("b")))
    level = (F.col("all_z") - F.col("m1") - F.col("m2")).cast("double") / (F.col("all_w") - F.col("w1") - F.col("w2"))
    levels = levels.withColumn("level", level).filter("ratio > level").agg(F.min_by("level", "ratio").alias("level"))  # one row
    share = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return s.crossJoin(F.broadcast(levels)).select("source", "n", "source_size", F.coalesce(share, F.col("most").cast("double")).alias("target"))


def source_scales(sizes: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """targets (a table) with scale: copies are scale * root, at most `most`; documents that reach that come first, largest first."""
    h = sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("k")).withColumn("root", _root("size"))
    h = h.withColumn("words", _big(F.col("size") * F.col("k"))).withColumn("mass", (F.col("words") * _big(F.col("root"))).cast("decimal(38,0)"))
    down = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("source")
    zero = F.lit(0).cast("decimal(38,0)")
    h = h.select("source", "size", "root", F.coalesce(F.sum("words").over(down), zero).alias("full"), (F.sum("mass").over(whole) - F.coalesce(F.sum("mass").over(down), zero)).alias("open"))
    h = h.join(bounded_broadcast(targets), h["source"].eqNullSafe(targets["source"])).select(targets["source"], "size", "root", ((F.col("target") - most * F.col("full").cast("double")) / F.col("open").cast("double")).alias("scale"))
    first = h.filter(F.col("scale") * F.col("root") < most - 1e-9).groupBy("source").agg(F.max_by("scale", "size").alias("scale"))
    joined = targets.join(first.withColumnRenamed("source", "s"), targets["source"].eqNullSafe(F.col("s")), "left")
    return joined.select(*targets.columns, F.coalesce("scale", F.lit(float(most))).alias("scale"))


def _ranked(sizes: DataFrame, plan: DataFrame, most: int, seed: int) -> DataFrame:
    """sizes with the plan's columns, certain (whole copies), v (the rank, from 0 to 1; null: not drawn) and bin."""
    plan = plan.withColumnRenamed("source", "s")
    x = sizes.join(bounded_broadcast(plan), sizes["source"].eqNullSafe(F.col("s"))).drop("s")
    copies = F.least(F.lit(float(most)), F.col("scale") * _root("size"))
    x = x.withColumn("certain", F.floor(copies)).withColumn("p", copies - F.floor(copies))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f"|{seed}"))
    u = (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5).cast("double")) / F.lit(float(1 << 52))
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    x = x.withColumn("v", F.when(F.col("p") > 0, q / (1 + q))).drop("p")
    return x.withColumn("bin", F.when(F.col("v").isNotNull(), F.least(F.floor(F.col("v") * F.ceil(F.col("n") / BIN)), F.ceil(F.col("n") / BIN) - 1)))


def mixing_plan(sizes: DataFrame, most: int = 3, seed: int = 9) -> DataFrame:
    """A row per source: source_size, target, scale, n, the bin in which its words run out, the last place in it up to which all are taken once more, and further ones taken."""
    plan = cut(source_scales(sizes, cut(source_targets(sizes, most)), most))
    ranked = _ranked(sizes, plan, most, seed)
    left = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("left"))
    bins = ranked.filter("v is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    up = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(up), F.lit(0))).withColumnRenamed("source", "s")
    bins = bins.join(left, F.col("s").eqNullSafe(left["source"])).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
    edge = bounded_broadcast(cut(bins.select("s", F.col("bin").alias("edge"), "before", "left")))
    at = ranked.join(edge, ranked["source"].eqNullSafe(F.col("s")) & (F.col("bin") == F.col("edge")))
    at = at.groupBy("source", "edge", "v", "doc_id", "size").agg(F.sum("size").alias("words"), F.first(F.col("left") - F.col("before")).alias("room"))
    place = "struct<v:double,doc_id:bigint,size:bigint>"
    at = at.groupBy("source", "edge").agg(F.first("room").alias("room"), F.sort_array(F.collect_list(F.struct("v", F.col("doc_id").cast("long").alias("doc_id"), "size", "words"))).alias("inside"))
    fill = at.select(
        F.col("source").alias("s"),
        "edge",
        F.expr(
            f"""aggregate(inside, named_struct('room', room, 'past', false, 'last', cast(null as {place}), 'more', cast(array() as array<{place}>)),
            (a, x) -> if(x.words > a.room, named_struct('room', a.room, 'past', true, 'last', a.last, 'more', a.more),
              named_struct('room', a.room - x.words, 'past', a.past, 'last', if(a.past, a.last, named_struct('v', x.v, 'doc_id', x.doc_id, 'size', x.size)),
                'more', if(a.past, array_append(a.more, named_struct('v', x.v, 'doc_id', x.doc_id, 'size', x.size)), a.more))))"""
        ).alias("fill"),
    )
    fill = fill.select("s", "edge", "fill.last", "fill.more")
    return cut(plan.join(fill, plan["source"].eqNullSafe(F.col("s")), "left").drop("s"))


def mixed(sizes: DataFrame, plan: DataFrame, most: int = 3, seed: int = 9) -> DataFrame:
    """sizes with source_size, target and copies."""
    x = _ranked(sizes, plan, most, seed)
    place = F.struct("v", F.col("doc_id").cast("long").alias("doc_id"), "size")
    inside = F.coalesce(place <= F.col("last"), F.lit(False)) | F.coalesce(F.array_contains("more", place), F.lit(False))
    drawn = F.col("v").isNotNull() & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & inside))
    return x.withColumn("copies", F.col("certain") + drawn.cast("long")).drop("n", "scale", "certain", "v", "bin", "edge", "last", "more")


@scoped
def mix_sources(docs: DataFrame, most: int = 3, seed: int = 9) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each document."""
    sizes = cut(docs.select("doc_id", "source", word_count().alias("size")))
    return mixed(sizes, mixing_plan(sizes, most, seed), most, seed).withColumn("taken", F.col("copies") * F.col("size"))


@scoped
def take_mix(docs: DataFrame, most: int = 3, seed: int = 9) -> DataFrame:
    """Each row of docs as often as the mix takes it, with docs' columns."""
    sizes = docs.select("doc_id", "source", word_count().alias("size"))
    plan = mixing_plan(cut(sizes), most, seed)
    columns = F.struct(*map(quoted, docs.columns)).alias("row")
    found = mixed(docs.select("doc_id", "source", word_count().alias("size"), columns), plan, most, seed)
    return found.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), l AS (
  SELECT *, row_number() OVER o AS pos, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM s WINDOW o AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, coalesce(least(most::DOUBLE, weight * (SELECT level FROM l WHERE most::DOUBLE / weight > level ORDER BY pos LIMIT 1)), most::DOUBLE) AS target FROM l
), h AS (
  SELECT source, size, count(*) AS k, floor(sqrt(size::DOUBLE) * 1024)::BIGINT AS root FROM d WHERE size > 0 GROUP BY source, size
), c AS (
  SELECT h.source, size, root, (target - 3 * coalesce(sum(size * k) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(size * k * root) OVER (PARTITION BY h.source) - coalesce(sum(size * k * root) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS scale
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY h.source ORDER BY size DESC)
), f AS (
  SELECT source, max_by(scale, size) AS scale FROM c WHERE scale * root < 3 - 1e-9 GROUP BY source
), e AS (
  SELECT d.*, source_size, target, least(3.0::DOUBLE, coalesce(f.scale, 3.0::DOUBLE) * floor(sqrt(size::DOUBLE) * 1024)) AS copies,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|9'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
), g AS (
  SELECT *, floor(copies)::BIGINT AS certain, CASE WHEN copies > floor(copies) THEN (u / (1 - u)) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS q FROM e
), v AS (
  SELECT *, least(floor(q / (1 + q) * nb), nb - 1) AS bin FROM (SELECT *, ceil(count(*) OVER (PARTITION BY source) / 2000.0)::BIGINT AS nb, target - sum(certain * size) OVER (PARTITION BY source) AS room FROM g)
), b AS (
  SELECT source, bin, any_value(room) AS room, sum(size) AS words FROM v WHERE q IS NOT NULL GROUP BY source, bin
), y AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b
), o AS (
  SELECT v.source, q, doc_id, size, sum(size) AS words, any_value(v.room - y.before) AS room, row_number() OVER (PARTITION BY v.source ORDER BY q, doc_id, size) AS k
  FROM v JOIN y ON v.source IS NOT DISTINCT FROM y.source AND v.bin = y.bin WHERE q IS NOT NULL AND y.before <= y.room AND y.room < y.before + y.words GROUP BY v.source, q, doc_id, size
), z AS (
  SELECT source, doc_id, size, k, room - CASE WHEN words <= room THEN words ELSE 0 END AS room, words <= room AS taken FROM o WHERE k = 1
  UNION ALL
  SELECT o.source, o.doc_id, o.size, o.k, z.room - CASE WHEN o.words <= z.room THEN o.words ELSE 0 END, o.words <= z.room FROM z JOIN o ON z.source IS NOT DISTINCT FROM o.source AND o.k = z.k + 1
), x AS (
  SELECT v.*, certain + CASE WHEN q IS NULL THEN 0 WHEN y.before + y.words <= y.room OR z.taken THEN 1 ELSE 0 END AS n
  FROM v LEFT JOIN y ON v.source IS NOT DISTINCT FROM y.source AND v.bin = y.bin LEFT JOIN z ON v.source IS NOT DISTINCT FROM z.source AND v.doc_id = z.doc_id AND v.size = z.size
)
SELECT doc_id, size, source_size, target, (n * size)::BIGINT AS taken, n::BIGINT AS copies FROM x
"""
