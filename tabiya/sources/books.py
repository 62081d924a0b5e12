"""Opening books: Polyglot records and CTG pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabiya.sources import ranges

_RECORD = np.dtype([("key", ">u8"), ("move", ">u2"), ("weight", ">u2"), ("learn", ">u4")])
PAGE = 4096
CTG_SCHEMA = "path string, page long, place int, signature binary, moves array<struct<code:int,ann:int>>, total long, losses long, wins long, draws long, recommendation int, footer binary"


def _records(spark: SparkSession, paths, size: int, header: int = 0, per: int = 1, first: int = 0, last: int | None = None) -> tuple[DataFrame, list[tuple[str, int]]]:
    """path, seq, data of the files' records (ranges.read_records()), and the files."""
    files = ranges.listed(spark, paths)
    if ranges.opened(files):
        return ranges.read_records(spark, files, size, header, per, first, last), files

    def run(batches):  # whole files, for stores that only Spark reads
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py() or b""
                n = min(max(0, len(data) - header) // size, last if last is not None else 1 << 62)
                seqs = list(range(first, n, per))
                rows = [data[header + s * size : header + min(s + per, n) * size] for s in seqs]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(seqs), pa.string()), pa.array(seqs, pa.int64()), pa.array(rows, pa.binary())], ["path", "seq", "data"])

    return ranges.whole_files(spark, paths).mapInArrow(run, "path string, seq long, data binary"), files


def read_polyglot(spark: SparkSession, paths: str | list[str], first: int = 0, last: int | None = None) -> DataFrame:
    """path, seq, key (the 64 bits as BIGINT), move, weight, learn of the records first to last (not included); a size that isn't a multiple of 16 is an error."""
    found, files = _records(spark, paths, 16, per=4096, first=first, last=last)
    for path, size in files:
        if size % 16:
            raise ValueError(f"{path}: a book holds records of 16 bytes")

    def run(batches):
        for batch in batches:
            for path, seq, data in zip(batch.column("path").to_pylist(), batch.column("seq").to_pylist(), batch.column("data"), strict=True):
                r = np.frombuffer(data.as_buffer(), _RECORD)
                columns = [np.arange(seq, seq + len(r)), r["key"].astype(np.uint64).view(np.int64), r["move"].astype(np.int32), r["weight"].astype(np.int32), r["learn"].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(r), pa.string()), *map(pa.array, columns)], ["path", "seq", "key", "move", "weight", "learn"])

    return found.mapInArrow(run, "path string, seq long, key long, move int, weight int, learn long")


def book_statistics(entries: DataFrame) -> DataFrame:
    """path, records, active, zero_weight, duplicates (of key and move), falls (unsigned keys below the one before)."""
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    before = F.lag("u").over(W.partitionBy("path").orderBy("seq"))
    e = entries.withColumn("u", unsigned).withColumn("fall", F.when(F.col("u") < before, 1).otherwise(0))
    each = e.groupBy("path", "key", "move").agg(F.count("*").alias("n"), F.sum(F.when(F.col("weight") > 0, 1).otherwise(0)).alias("active"), F.sum("fall").alias("falls"))
    return each.groupBy("path").agg(F.sum("n").alias("records"), F.sum("active").alias("active"), (F.sum("n") - F.sum("active")).alias("zero_weight"), (F.sum("n") - F.count("*")).alias("duplicates"), F.sum("falls").alias("falls"))


def ctg_page(data: bytes) -> list[tuple]:
    """Entries of a page: u16 count, u16 bytes, then signature (its length in five bits), move size, (code, remark) pairs, 33 bytes."""
    out, at = [], 4
    for place in range(int.from_bytes(data[:2], "big")):
        if at >= len(data):
            raise ValueError("a page is cut short")
        n = data[at] & 31
        if not n or at + n >= len(data):
            raise ValueError("a signature is damaged")
        size = data[at + n]
        if size % 2 == 0 or at + n + size + 33 > len(data):
            raise ValueError("a record is damaged")
        moves = [{"code": data[k], "ann": data[k + 1]} for k in range(at + n + 1, at + n + size, 2)]
        foot = data[at + n + size : at + n + size + 33]
        counts = [int.from_bytes(foot[k : k + 3], "big") for k in (0, 3, 6, 9)]
        out.append((place, data[at : at + n], moves, *counts, foot[30], foot))
        at += n + size + 33
    return out


def read_ctg(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """The entries of all pages, keyed by signature: a join replaces probing by hash. Damage fails the query, or with strict=False ends a page."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("code", pa.int32()), ("ann", pa.int32())])), *[pa.int64()] * 4, pa.int32(), pa.binary()]
        names = ["path", "page", "place", "signature", "moves", "total", "losses", "wins", "draws", "recommendation", "footer"]
        for batch in batches:
            found = []
            for path, page, data in zip(*(batch.column(c).to_pylist() for c in ("path", "seq", "data")), strict=True):
                try:
                    found += [(path, page, *r) for r in ctg_page(data)]
                except ValueError:
                    if strict:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    return _records(spark, paths, PAGE, header=PAGE)[0].mapInArrow(run, CTG_SCHEMA)


def preflight(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, pages, positions, moves, invalid_pages of a scan of all pages; files without pages aren't listed."""

    def run(batches):
        for batch in batches:
            found = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist(), strict=True):
                try:
                    rows = ctg_page(data)
                    found.append((path, len(rows), sum(len(r[2]) for r in rows), 0))
                except ValueError:
                    found.append((path, 0, 0, 1))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], ["path", "positions", "moves", "invalid"])

    pages = _records(spark, paths, PAGE, header=PAGE)[0].mapInArrow(run, "path string, positions long, moves long, invalid long")
    return pages.groupBy("path").agg(F.count("*").alias("pages"), *(F.sum(x).alias(x) for x in ("positions", "moves")), F.sum("invalid").alias("invalid_pages"))


def ctb_bounds(data: bytes) -> tuple[int, int]:
    """The lowest and highest page index of a .ctb file."""
    if len(data) < 12:
        raise ValueError("a page-bounds file holds 12 bytes")
    low, high = (int.from_bytes(data[k : k + 4], "big", signed=True) for k in (4, 8))
    if low < 0 or high < low:
        raise ValueError("page bounds are out of order")
    return low, high


def probe_indices(hash_: int, low: int, high: int) -> list[int]:
    """Indices to look at for a signature's hash (as a signed 32-bit number): one per mask, from low on, up to the first at or beyond high."""
    out, mask = [], 0
    while mask < 0x7FFFFFFF:
        key = (hash_ & mask) + mask
        if key >= low:
            out.append(key)
            if key >= high:
                break
        mask = 2 * mask + 1
    return out


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """place, page of an index file's entries (four bytes each after 16) that point to a page."""
    value = F.conv(F.hex("data"), 16, 10).cast("long")
    signed = F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)
    return _records(spark, path, 4, header=16)[0].select(F.col("seq").alias("place"), signed.alias("page")).filter("page >= 0")


def probes(entries: DataFrame, low: int, high: int) -> DataFrame:
    """signature, page, place: the places of the index that a reader tries for each entry's signature."""
    from tabiya.kernel.books import ctg_hash

    def run(batches):
        for batch in batches:
            places = [probe_indices(ctg_hash(s), low, high) for s in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("page"), pa.array(places, pa.list_(pa.int64()))], ["signature", "page", "places"])

    found = entries.select("signature", "page").mapInArrow(run, "signature binary, page long, places array<long>")
    return found.select("signature", "page", F.explode("places").alias("place"))


def probed(entries: DataFrame, index: DataFrame, low: int, high: int) -> DataFrame:
    """entries with probed: whether their signature's places in the index (index_entries()) lead to their page, as a reader by index would find them.

    A join of the exploded places with the index, so neither is held by one task.
    """
    hit = probes(entries, low, high).join(index.withColumnRenamed("page", "at"), "place").filter("at = page")
    hit = hit.select(F.col("signature").alias("_s"), F.col("page").alias("_p"), F.lit(True).alias("probed")).distinct()
    found = entries.join(hit, (F.col("signature") == F.col("_s")) & (F.col("page") == F.col("_p")), "left")
    return found.withColumn("probed", F.coalesce("probed", F.lit(False))).drop("_s", "_p")
