"""Document fingerprints: 64-bit SimHash in SQL expressions only.

Terms are runs of five words (a text of fewer words is one term), each weighted by how often it occurs: every occurrence
votes for or against each bit by the bits of its hash. Votes for two bits are counted in one 64-bit sum, so a fingerprint is
32 sums of a hash aggregate that needs no shuffle of terms. A bit is set if more than half of the votes are for it.

near_fingerprints() finds all fingerprints within a Hamming radius by permuted block tables: of `blocks` blocks at most
`radius` can differ, so some choice of the others agrees; there is one table per choice, joined on those blocks.

Groups of ids adapt to how sparse these are, so neighbours are found without ordering all rows in one task.

Null texts count as ''; texts without words have fingerprint 0 and equal one another. Rows that repeat a doc_id follow
each other by content. Null ids come last in descending order. A table of one row has itself as next. Extra columns pass by.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabiya.llm.common import bounded_broadcast, cut, scoped, table

WIDTH = 5
#: Neighbours are looked up inside groups of ids that differ in their lowest GROUP_BITS bits, or in a multiple of these if groups then
#: have at most GROUP_ROWS rows.
GROUP_BITS, GROUP_ROWS = 9, 4096
#: A search finds fingerprints that differ in at most RADIUS bits, by tables of BLOCKS blocks; its queries are ids divisible by QUERIES.
RADIUS, BLOCKS, QUERIES = 3, 6, 100
_SPACE = " \t\n\x0b\x0c\r"


def terms(text: Column) -> Column:
    """The runs of WIDTH words of a text, as an array of structs of words."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1)
    n = F.size(words)
    runs = F.arrays_zip(*[F.slice(words, i + 1, F.greatest(n - WIDTH + 1, F.lit(0))).alias(f"w{i}") for i in range(WIDTH)])
    short = F.array(F.struct(*[F.get(words, F.lit(i)).alias(f"w{i}") for i in range(WIDTH)]))
    none = F.slice(short, 1, 0)
    return F.when(trimmed == "", none).when(n >= WIDTH, runs).otherwise(short)


def _votes() -> list[Column]:
    return [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(0x100000001))).alias(f"v{i}") for i in range(32)]


def _bits() -> Column:
    """The fingerprint as a BIGINT, from sums of two bits' votes each."""
    low, high = [], []
    for i in range(32):
        low.append(F.when(2 * F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("votes"), F.lit(1 << i)).otherwise(F.lit(0)))
        high.append(F.when(2 * F.shiftrightunsigned(f"v{i}", 32) > F.col("votes"), F.lit(1 << i)).otherwise(F.lit(0)))
    total = lambda x: sum(x[1:], x[0]).cast("long")
    return F.shiftleft(total(high), 32).bitwiseOR(total(low))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp (BIGINT) of each row; keys tell rows apart. Needs no shuffle if rows are dealt out by some of the keys."""
    found = rows.select(*keys, F.inline_outer(terms(F.coalesce(F.col(text), F.lit("")))))
    words = [f"w{i}" for i in range(WIDTH)]
    hashed = found.select(*keys, F.when(F.col("w0").isNotNull(), F.xxhash64(*words)).alias("h"))
    return hashed.groupBy(*keys).agg(F.count("h").alias("votes"), *_votes()).select(*keys, F.when(F.col("votes") > 0, _bits()).otherwise(F.lit(0).cast("long")).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """The share of the 64 bits that agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def group_bits(ids: DataFrame) -> int:
    """How many low bits of ids make a group: the most that leave every group at most GROUP_ROWS rows, so sparse ids share groups, too."""
    bits, counts = GROUP_BITS, ids.groupBy(F.shiftright("k", GROUP_BITS).alias("g")).agg(F.count("*").alias("n"))
    while bits + GROUP_BITS < 64:
        counts = cut(counts.groupBy(F.shiftright("g", GROUP_BITS).alias("g")).agg(F.sum("n").alias("n")))
        if (counts.agg(F.max("n")).first()[0] or 0) > GROUP_ROWS:
            break
        bits += GROUP_BITS
    return bits


def previous_groups(ids: DataFrame) -> DataFrame:
    """The largest place (k, b) of each group (g, b), and the next group that has ids, (to, to_b) (the first after the last).

    Groups are ordered inside ranges; one task orders only one row for each range.
    """
    groups = ids.groupBy("g", "b").agg(F.max("k").alias("k"))
    groups = cut(groups.repartitionByRange("g", "b").withColumn("part", F.spark_partition_id()))
    firsts = groups.groupBy("part").agg(F.min(F.struct("g", "b")).alias("first"))
    order = W.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    inner = F.lead(F.struct("g", "b")).over(W.partitionBy("part").orderBy("g", "b"))
    return groups.withColumn("inner", inner).join(F.broadcast(firsts), "part").select("k", "b", F.coalesce("inner", "after").alias("to"))


def with_next(docs: DataFrame) -> DataFrame:
    """g, b, r (which tell rows apart), copy, doc_id, text and next (the text that follows in descending doc_id order).

    Rows are dealt out by (g, b): ids that share their high bits, of rows without id those that share high bits of a hash of their
    texts. The last row of each group is also in the next group, where it only serves as a neighbour (copy).
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"))
    known = d.filter("doc_id is not null").select("k")
    bits = group_bits(known)
    hashed = F.shiftright(F.xxhash64("text"), 64 - max(1, (docs.filter("doc_id is null").count() // GROUP_ROWS).bit_length()))
    none = F.col("doc_id").isNull()
    d = d.withColumn("g", F.when(none, F.lit(-(1 << 63))).otherwise(F.shiftright("k", bits))).withColumn("b", F.when(none, hashed).otherwise(F.lit(0).cast("long")))
    last = bounded_broadcast(cut(previous_groups(d.select("k", "g", "b"))))
    here = F.struct("g", "b", F.lit(False).alias("copy"))
    places = F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("to.g").alias("g"), F.col("to.b").alias("b"), F.lit(True).alias("copy"))))
    d = d.join(last, ["k", "b"], "left").select("doc_id", "k", "text", F.inline(places))
    order = W.partitionBy("g", "b").orderBy(F.desc("copy"), "k", F.xxhash64("text"), "text")
    return d.select("g", "b", F.row_number().over(order).alias("r"), "copy", "doc_id", "text", F.lag("text").over(order).alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.when(F.col("copy"), F.lit("")).otherwise(F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half)))
    d = d.select("g", "b", "r", "copy", "doc_id", "n_chars", "text", edited.alias("edited"))
    d = d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))
    keys = ["g", "b", "r", "copy", "doc_id", "n_chars", "edited_sha256"]
    fp = fingerprints(d.select(*keys, F.inline(sides)), [*keys, "side"], "t")
    both = fp.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("efp"))
    order = W.partitionBy("g", "b").orderBy("r")
    both = both.withColumn("nfp", F.lag("fp").over(order)).filter(~F.col("copy"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )


def near_fingerprints(fps: DataFrame, radius: int = 3, blocks: int = 6, queries: DataFrame | None = None) -> DataFrame:
    """a < b and distance of the distinct fingerprints within the radius; with `queries`, the pairs of a query a and any b.

    Equal fingerprints are one; a pair is found in each table that fits it, and kept in the first of these.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("the radius must be less than the number of blocks, and these at most 64")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in keep) for keep in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]

    def tables(df: DataFrame, name: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(masks)])
        return df.select("fp").filter("fp is not null").distinct().select(F.col("fp").alias(name), F.inline(entries))

    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    order = F.col("a") < F.col("b") if queries is None else F.col("a") != F.col("b")
    asked = tables(fps if queries is None else queries, "a")
    found = (asked if queries is None else bounded_broadcast(cut(asked))).join(tables(fps, "b"), ["t", "block"])
    return found.filter(order & (F.bit_count(differ) <= radius) & (F.col("t") == first)).select("a", "b", F.bit_count(differ).alias("distance"))


def with_near(found: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, each: int = QUERIES) -> DataFrame:
    """found (doc_id and fp, a table) with n_near: how many other fingerprints are within the radius of this one, for ids divisible by `each`, else null."""
    asked = found.filter(F.col("doc_id") % each == 0).select("fp")
    near = near_fingerprints(found.select("fp"), radius, blocks, asked).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("n"))
    n = F.when(F.col("doc_id") % each == 0, F.coalesce("n", F.lit(0)))
    return found.join(bounded_broadcast(cut(near)), "fp", "left").withColumn("n_near", n).drop("n")


@scoped
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(edited_fingerprints(table(spark, sf_dir, "documents")))
    fp = F.shiftleft(F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring("fingerprint", 9, 8), 16, 10).cast("long"))
    return with_near(found.withColumn("fp", fp)).select(*found.columns, "n_near")
