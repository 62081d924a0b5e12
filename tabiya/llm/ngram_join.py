"""N-gram Jaccard join: documents whose sets of word shingles overlap, and the components that they form.

Documents by shingles are a sparse matrix with a column per shingle. Equal rows are one class. The product of the
matrix with itself is taken by blocks of columns (hash ranges), and bounds from the rows' sizes drop rows and
pairs before anything is paired:
1. Linked sets of sizes n, m share at least 3/4 of either. So, in any fixed order of columns, the first n - ceil(3n/4) + k
   of each hold k shared ones. Blocks of those leading columns count, for each row, the columns that it shares
   with anyone; rows with fewer than their k link with nothing.
2. For the rows left, blocks of all columns give each column's count of rows. Columns are ordered rarest first; a column of
   one row can't be shared. Each row keeps the leading columns among which a link must show.
3. Columns with the rows that keep them: each row is checked with one centre row of each of its columns, the most central one
   first and then one outside the largest component. Links join components, which leaves few columns whose rows are in
   several. There all pairs across components are checked that the bound from sizes and places lets through, so no link is
   lost, while large groups of mutual near copies never become pairs.
A check counts the overlap of two whole sets. Sets are of 64-bit hashes of shingles.

Null or empty texts have no shingles and link with nothing; a text of fewer words than a shingle is one shingle; texts may be of any
length. Rows that repeat a doc_id are rows of their own; null ids link like others and are the smallest only among themselves. Extra
columns pass by one_of_each(), whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import bounded_broadcast, cut, discard, gather, mix, own_names, quoted, reclaim, runs, scatter, scoped, shingle_sets, signed, strings, table, text_slices, tidy
from tabiya.llm.components import components

#: Entries of a block of columns, on average; and that a task collects before it deals them out.
BLOCK, HELD = 200_000, 1_000_000


def lead(n: np.ndarray | int, extra: np.ndarray | int) -> np.ndarray | int:
    """How many leading columns of a row of n hold `extra` shared ones with any partner of similarity 3/4."""
    return n - (3 * n + 3) // 4 + extra


def shared_needed(n):
    return np.maximum(1, n // 10)


def set_signature(h: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets have in common."""
    return tuple(np.array([mix(h).sum(), mix(h ^ np.uint64(0xA5A5F00D5EED1234)).sum()], np.uint64).view(np.int64).tolist())


def shingle_classes(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles and the signature (sign, sign_b) of each row's set."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(strings(part.column("text")), k)
                signs = [set_signature(h) for h in sets]
                columns = [pa.array([len(h) for h in sets], pa.int64()), pa.array([s[0] for s in signs], pa.int64()), pa.array([s[1] for s in signs], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("text_key"), *columns], ["doc_id", "text_key", "n_shingles", "sign", "sign_b"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(tidy(run), "doc_id long, text_key long, n_shingles long, sign long, sign_b long")


def _blocks(sets, blocks: int, leading: bool):
    """Rows of scatter() for an iterator of (signature, sorted set)."""
    held, n = [], 0

    def deal():
        h, s = np.concatenate([x[0] for x in held]), np.concatenate([np.full(len(x[0]), x[1], np.int64) for x in held])
        bucket = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        return scatter(bucket, {"h": h.astype(np.uint32) if leading else h, "s": s})

    for sign, h in sets:
        if leading:
            h = h[: lead(len(h), int(shared_needed(len(h))))]
        held.append((h, sign))
        n += len(h)
        if n > HELD:
            yield deal()
            held, n = [], 0
    if n:
        yield deal()


def sharing_rows(docs: DataFrame, entries: int, k: int = 5) -> DataFrame:
    """sign, shared: how many of its leading columns each row shares with another set."""
    blocks = max(64, math.ceil(entries / BLOCK))

    def deal(batches):
        def sets():
            seen: set[int] = set()
            for batch in batches:
                for part in text_slices(batch):
                    for h in shingle_sets(strings(part.column("text")), k):
                        if len(h) and (sign := set_signature(h)[0]) not in seen:
                            seen.add(sign)
                            yield sign, h

        yield from _blocks(sets(), blocks, True)

    def count(batches):
        x = gather(batches, {"h": np.uint32, "s": np.int64})
        order = np.argsort(x["h"], kind="stable")
        h, s = x["h"][order], x["s"][order]
        first, length = runs(h)
        if len(first):
            many = np.repeat(np.minimum.reduceat(s, first) != np.maximum.reduceat(s, first), length)
            h, s = h[many], s[many]
            order = np.lexsort((h, s))  # copies dealt out by several tasks count once
            h, s = h[order], s[order]
            s = s[np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])] if len(s) else s
            sign, shared = np.unique(s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sign), pa.array(shared)], ["sign", "shared"])

    dealt = docs.select("text").mapInArrow(tidy(deal), "bucket long, h binary, s binary").repartition(blocks, "bucket")
    return dealt.mapInArrow(tidy(count), "sign long, shared long").groupBy("sign").agg(F.sum("shared").alias("shared"))


def shingle_rows(docs: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """sign, n, shingles (binary) of one row of each wanted (doc_id, text_key, sign), as a table."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                signs, sets = [], []
                for sign, h in zip(part.column("sign").to_pylist(), shingle_sets(strings(part.column("text")), k), strict=True):
                    if set_signature(h)[0] == sign:  # another text may have the same hash
                        signs.append(sign)
                        sets.append(h)
                yield pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["sign", "n", "shingles"])

    of = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    at = wanted.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "sign")
    found = of.join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).select("sign", "text").mapInArrow(tidy(run), "sign long, n long, shingles binary")
    found = cut(found, 4)
    # Only rows of docs that repeat doc_id and text come twice, and whole sets are long to shuffle.
    return cut(found.dropDuplicates(["sign"]), 2) if found.groupBy("sign").count().filter("count > 1").limit(1).count() else found


def leading_columns(rows: DataFrame, entries: int) -> DataFrame:
    """h, sign, n, c, i: the rarest-first leading columns of each row, without columns of one row; c is the mean count of all its columns, i
    the place of a column in the row."""
    blocks = max(64, math.ceil(entries / BLOCK))

    def deal(batches):
        def sets():
            for batch in batches:
                for sign, h in zip(batch.column("sign").to_pylist(), batch.column("shingles"), strict=True):
                    yield sign, np.frombuffer(h.as_buffer(), np.uint64)

        yield from _blocks(sets(), blocks, False)

    def count(batches):
        x = gather(batches, {"h": np.uint64, "s": np.int64})
        order = np.argsort(x["h"], kind="stable")
        h, s = x["h"][order], x["s"][order]
        _, length = runs(h)
        df = np.repeat(length, length)
        h, s, df = h[df > 1], s[df > 1], df[df > 1].astype(np.uint32)
        if len(s):
            part = scatter(np.unique(s, return_inverse=True)[1].astype(np.int64), {"h": h, "df": df})
            yield part.append_column("sign", pa.array(np.unique(s))).select(["sign", "h", "df"])

    def choose(batches):
        table_ = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table_ is None:
            return
        sized = table_.filter(pc.is_valid(table_.column("n"))).sort_by("sign")
        table_ = table_.filter(pc.is_valid(table_.column("h")))
        signs = table_.column("sign").to_numpy()
        sizes = sized.column("n").to_numpy()[np.searchsorted(sized.column("sign").to_numpy(), signs)]
        x = gather(table_.to_batches(), {"h": np.uint64, "df": np.uint32})
        times = pc.binary_length(table_.column("h")).to_numpy() // 8
        s, n = np.repeat(signs, times), np.repeat(sizes, times)
        order = np.lexsort((x["h"], x["df"], s))
        h, s, n, df = x["h"][order], s[order], n[order], x["df"][order].astype(np.int64)
        first, length = runs(s)
        alone = n[first] - length  # columns of this row only come first
        central = np.repeat((np.add.reduceat(df, first) + alone) / n[first], length) if len(first) else np.empty(0)
        place = np.arange(len(s)) - np.repeat(first, length) + np.repeat(alone, length)
        keep = place < lead(n, 1)
        yield pa.RecordBatch.from_arrays([signed(h[keep]), pa.array(s[keep]), pa.array(n[keep]), pa.array(central[keep]), pa.array(place[keep])], ["h", "sign", "n", "c", "i"])

    dealt = rows.select("sign", "shingles").mapInArrow(tidy(deal), "bucket long, h binary, s binary").repartition(blocks, "bucket")
    # Sizes come to their rows' columns by the shuffle that gathers these, which a join would shuffle once more.
    counted = dealt.mapInArrow(tidy(count), "sign long, h binary, df binary").unionByName(rows.select("sign", "n"), True)
    return counted.repartition(blocks, "sign").mapInArrow(tidy(choose), "h long, sign long, n long, c double, i long")


def linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b; a table) whose whole sets have a similarity of at least 3/4."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    named = bounded_broadcast(cut(pairs.select(F.col("a").alias("sign")).union(pairs.select("b")).distinct()))
    rows = rows.join(named, "sign", "left_semi")  # whole rows are long, and most aren't in any pair
    x = rows.select(F.col("sign").alias("a"), F.col("shingles").alias("x"))
    y = rows.select(F.col("sign").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _may(n: str, i: str, m: str, j: str):
    """Whether rows of sizes n, m may link whose first shared column stands at i, j: all after it and it must hold 3/7 of both sizes."""
    return F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) * 7 >= (F.col(n) + F.col(m)) * 3


def row_components(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """sign, label for the rows that link, from the leading columns and the whole rows (both tables).

    The first centre of a column is its row with the most frequent columns: the text that near copies were made from, if
    there is one. The second is the most such row outside the column's largest component.
    """
    place = F.struct("c", "sign", "n", "i", "label")
    centres = columns.withColumn("label", F.col("sign")).groupBy("h").agg(F.max(place).alias("centre"), F.count("*").alias("size")).filter("size > 1")
    checked = cut(_against(columns.withColumn("label", F.col("sign")), centres))
    links = cut(linked(checked, rows))
    labels = components(links)
    reclaim(columns.sparkSession)
    now, most = _mixed(columns, labels)
    centres = now.join(most, "h").filter("label != most").groupBy("h").agg(F.max(place).alias("centre"))
    pairs = cut(_against(now, centres).join(checked, ["a", "b"], "left_anti"))
    links, checked = links.union(cut(linked(pairs, rows))), checked.union(pairs)
    labels = components(links)
    discard(now)
    reclaim(columns.sparkSession)
    now, most = _mixed(columns, labels)
    few = now.join(most, "h").filter("label != most").select("h", F.col("sign").alias("s"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("label").alias("other"))
    pairs = few.join(now, "h").filter((F.col("label") != F.col("other")) & _may("n", "i", "m", "j")).select(*_ordered("sign", "s")).distinct()
    rest = cut(pairs.join(checked, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        labels = components(cut(links.union(linked(rest, rows))))
    return labels.select(F.col("node").alias("sign"), "label")


def _against(columns: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of a column's rows and its centre, if they aren't in one component and their sizes allow a link."""
    met = columns.join(centres.select("h", "centre"), "h").filter((F.col("label") != F.col("centre.label")) & _may("n", "i", "centre.n", "centre.i"))
    return met.select(*_ordered("sign", "centre.sign")).distinct()


def _mixed(columns: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns whose rows are in several components, with labels, as a table; and each one's largest component."""
    now = _labelled(columns, labels)
    sizes = now.groupBy("h", "label").agg(F.count("*").alias("size"))
    most = cut(sizes.groupBy("h").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("size", "label")).alias("most")).filter("labels > 1").select("h", "most"))
    most = bounded_broadcast(most)  # few, while now has all columns
    return cut(now.join(most.select("h"), "h", "left_semi")), most


def _labelled(columns: DataFrame, labels: DataFrame) -> DataFrame:
    return columns.join(labels.withColumnRenamed("node", "sign"), "sign", "left").select("h", "sign", "n", "c", "i", F.coalesce("label", "sign").alias("label"))


@scoped
def jaccard_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (the smallest doc_id that links reach) and component (a key of the component, null
    without shingles) for every row; docs is read several times."""
    known = cut(shingle_classes(docs, k), 2)
    classes = cut(known.filter("n_shingles > 0").groupBy("sign", "sign_b", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_key")).alias("place")))
    entries = classes.agg(F.sum("n_shingles")).first()[0] or 0
    sharing = sharing_rows(docs, int(entries * 0.35), k).join(classes, "sign")
    fewest = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n_shingles") * 3 / 4) / 10))
    wanted = cut(sharing.filter(F.col("shared") >= fewest).select("place.doc_id", "place.text_key", "sign", "n_shingles"))
    reclaim(docs.sparkSession)
    rows = shingle_rows(docs, bounded_broadcast(wanted.select("doc_id", "text_key", "sign")), k)
    columns = cut(leading_columns(rows, wanted.agg(F.sum("n_shingles")).first()[0] or 0), 2)
    discard(wanted)
    reclaim(docs.sparkSession)
    named = cut(classes.join(row_components(columns, rows), "sign", "left"))
    for done in (columns, rows, classes):
        discard(done)
    reclaim(docs.sparkSession)
    least = bounded_broadcast(cut(named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))))
    named = named.join(least, "label", "left").select("sign", "sign_b", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("label", "sign").alias("component"))
    found = known.join(named, ["sign", "sign_b", "n_shingles"], "left")
    return found.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component")


@scoped
def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs without all but the first row, by doc_id and then a hash of the text, of each component; rows without shingles all stay."""
    rows = cut(jaccard_components(docs, k).filter("component is not null"))
    place = F.struct("doc_id", "text_key")
    d, t, own, rank = own_names(docs, 4)
    first = rows.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = rows.join(first, "component").filter(~place.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct()
    left = docs.join(bounded_broadcast(cut(gone)), docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(t)), "left_anti")
    # Equal rows (of doc_id and text) are one too many of their component, if they have shingles.
    twice = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(d), F.col("text_key").alias(t))
    twice = cut(twice)
    if not twice.limit(1).count():
        return left
    left = cut(left.withColumn(own, F.monotonically_increasing_id()))
    rest = left.join(bounded_broadcast(twice), left["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(left["text"]) == F.col(t)))
    later = rest.groupBy(d, t).agg(F.min(own).alias(rank)).select(rank)
    spare = cut(rest.select(own).join(later, F.col(own) == F.col(rank), "left_anti").withColumnRenamed(own, rank))
    return left.join(bounded_broadcast(spare), F.col(own) == F.col(rank), "left_anti").select(*map(quoted, docs.columns))


@scoped
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
