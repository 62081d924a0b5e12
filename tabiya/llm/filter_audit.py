"""Filter interaction audit: what each of five filters removes in each of the 120 orders in which they can be applied.

A document's mask has a bit for each filter that it fails; all counts come from the documents of each part by mask. Words are maximal
runs of other than ASCII white space, case-sensitive. Filters A (too few words), B (too few distinct words), C (too many capitals A-Z), D
(marks) look at one text; E fails a text that is identical to one of a smaller doc_id anywhere in the table.

E by partition refinement: rows are split by code-point length, then by the hashes of successive blocks, each eight times as long as the one before;
classes of one row are dropped after each split. The texts of the classes that are left are compared whole, so a hash decides nothing: a class that holds
several texts is split by its texts. All but a class's least doc_id fail.

Null texts count as ''; null sources are the part ''. A null doc_id is smaller than none and none is smaller than it. Rows that repeat a doc_id are
documents of their own; of repeated labels of a doc_id the largest counts. Texts may be of any length. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import WORD_PATTERN, bounded_broadcast, cut, discard, scoped, table

FILTERS = "ABCDE"
#: A: least words; B: least distinct words in 100; C: most capitals in 100 code points; D: marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
#: Bytes of the first block, and of each next one as a multiple.
BLOCK, TIMES = 64, 8
_GAPS = "[\\x20\\x09-\\x0D]+"


def own_failures(docs: DataFrame) -> DataFrame:
    """docs (text without nulls) with `own`: bits 0 to 3 for filters A to D."""
    words = F.array_remove(F.split("text", _GAPS), "")
    capitals = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))
    found = docs.select("*", words.alias("words"), capitals.cast("long").alias("capitals"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    failures = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * F.col("capitals") > MOST_CAPITALS * F.length("text").cast("long"), F.col("text").rlike(MARKS))
    own = reduce(Column.__add__, (F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failures)))
    return found.select(*docs.columns, own.alias("own"))


def block_hashes(text: Column) -> Column:
    """Hashes of the text's successive blocks of bytes; an empty text has one."""
    size, data = F.octet_length(text), text.cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.log(float(TIMES), size * (TIMES - 1) / BLOCK + 1))).cast("int")
    first = lambda i: BLOCK * (F.pow(F.lit(float(TIMES)), i) - 1) / (TIMES - 1)
    most = F.lit((1 << 31) - 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.substring(data, F.least(first(i) + 1, most).cast("int"), F.least(BLOCK * F.pow(F.lit(float(TIMES)), i), most).cast("int"))))


def _class(rounds: int) -> Column:
    """A row's class after so many blocks."""
    found = F.col("n_chars").cast("long")
    for k in range(rounds):
        found = F.xxhash64(found, F.get("blocks", F.lit(k)))
    return found


def repeated_classes(rows: DataFrame) -> tuple[DataFrame, int]:
    """The classes that still have two rows or more after all rounds, and the number of rounds; rows: n_chars, blocks."""
    rounds, left = 0, cut(rows.select(_class(0).alias("class"), "blocks"))
    while True:
        many = cut(left.groupBy("class").count().filter("count > 1").select("class"))
        if not left.filter(F.size("blocks") > rounds).limit(1).count():
            return many, rounds
        # Of a text that has ended, the missing block counts as another value, which all of its class share.
        found = left.join(bounded_broadcast(many), "class", "left_semi").withColumn("class", F.xxhash64("class", F.get("blocks", F.lit(rounds))))
        refined = cut(found)
        discard(left)
        discard(many)
        left, rounds = refined, rounds + 1


def repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with `repeats`: whether a smaller doc_id of docs has the same text. rows: a table with doc_id, n_chars, blocks and text_hash of each row of docs."""
    many, rounds = repeated_classes(rows)
    texts = docs.select("doc_id", "text", F.length("text").alias("n_chars"), block_hashes(F.col("text")).alias("blocks"))
    texts = texts.select("doc_id", "text", _class(rounds).alias("class")).join(bounded_broadcast(many), "class", "left_semi")
    firsts = texts.groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    compared = cut(firsts.groupBy("class").agg(F.count("*").alias("texts"), F.min("first").alias("first")))
    same = bounded_broadcast(cut(compared.filter("texts = 1").select("class", "first")))
    found = rows.withColumn("class", _class(rounds)).join(same, "class", "left").withColumn("repeats", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    mixed = compared.filter("texts > 1").select("class")
    if mixed.limit(1).count():  # different texts with equal hashes: these rows go by their texts
        some = texts.join(mixed, "class", "left_semi")
        later = some.join(firsts.join(mixed, "class", "left_semi"), ["class", "text"]).filter(F.col("doc_id") > F.col("first"))
        later = later.select("class", "doc_id", F.xxhash64("text").alias("text_hash"), F.lit(True).alias("later")).distinct()
        found = found.join(later, ["class", "doc_id", "text_hash"], "left").withColumn("repeats", F.col("repeats") | F.coalesce("later", F.lit(False)))
    return found.select(*rows.columns, "repeats")


@scoped
def filter_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit i: fails filter i of FILTERS)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = own_failures(docs).select("doc_id", "part", "own", F.length("text").alias("n_chars"), block_hashes(F.col("text")).alias("blocks"), F.xxhash64("text").alias("text_hash"))
    return repeats(docs, cut(rows)).select("doc_id", "part", (F.col("own") + F.when(F.col("repeats"), 16).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and those that a label says are good or toxic."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    found = masks.join(known, "doc_id", "left")
    return found.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def roles(spark: SparkSession) -> DataFrame:
    """What a document of each of the 32 masks is at each of the 5 steps of each of the 120 orders: a fixed table of 19,200 rows.

    1 or 0: here (removed here), stays, later (fails here, removed before), alone (fails only here); share: in how many of the orders this filter removes it.
    """
    found = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            for mask in range(32):
                fails, met = bool(mask & bit), bool(mask & before)
                found.append((mask, "".join(order), step, int(fails and not met), int(not mask & (before | bit)), int(fails and met), int(mask == bit), 120 // mask.bit_count() if fails else 0))
            before |= bit
    return spark.createDataFrame(found, "mask int, filter_order string, step int, here int, stays int, later int, alone int, share int")


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step, from mask_counts()."""
    total = lambda of, n: F.sum(F.col(of) * F.col(n)).cast("long")
    found = counts.join(F.broadcast(roles(counts.sparkSession)), "mask").groupBy("part", "filter_order", "step")
    return found.agg(
        total("stays", "n").alias("kept"),
        total("here", "n").alias("removed"),
        total("later", "n").alias("redundant"),
        total("alone", "n").alias("unique_fails"),
        total("here", "good").alias("good_lost"),
        total("here", "toxic").alias("toxic_lost"),
        total("share", "n").alias("shapley"),
    )


@scoped
def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_masks(table(spark, sf_dir, "documents"))
    return audit(cut(mask_counts(masks, table(spark, sf_dir, "labels"))))


ORACLE_OP11 = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{WORD_PATTERN}') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t
), m AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    {{'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)}} AS f
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), b AS (
  SELECT part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
    || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS fails FROM m
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM b GROUP BY part, fails
), o AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE len(filter_order) < 5 AND NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, step, filter_order[step:step] AS filter, filter_order[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE len(filter_order) = 5
), r AS (
  SELECT *, contains(fails, filter) AS failed, length(translate(fails, before, '')) < length(fails) AS met FROM c, s
)
SELECT part, filter_order, step::INT AS step,
  sum(CASE WHEN NOT failed AND NOT met THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN failed AND NOT met THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN failed AND met THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN failed AND NOT met THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failed AND NOT met THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN failed THEN n * 120 // len(fails) ELSE 0 END)::BIGINT AS shapley
FROM r GROUP BY part, filter_order, step
"""
