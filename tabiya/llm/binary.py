"""Token-id files in Simple-8b: 64-bit words whose selector says how many ids of how many bits follow.

A file is a run of segments; a segment has (little-endian)
    magic "S8BT", u32 version, u64 counts of documents, ids, words, escapes, blocks
    i64 doc_id of each document (the smallest i64: null), u64 length of each document
    u64 index of the first id of each block of BLOCK words
    u64 words
    u64 index and u64 value of each id of more than 60 bits (its place holds 0)
    u32 crc32 of all before it, and one line feed, with which Spark's text writer ends a row.
Blocks can be decoded alone; words of one selector are decoded together.

Rows are written in ascending doc_id order (nulls first, then by text): one range of ids per file, files
in that order by name. Null texts count as ''. An empty table writes no segment and reads as no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabiya.llm.common import cut, scoped, scratch, table, tidy
from tabiya.llm.tokens import Vocabulary, crc32, encoded

# Fixed values of the published Simple-8b coding: ids in a word, and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: The first id that is too wide for selectors 1, 2 and so on; and for ids of 16 bits the narrowest selector by id.
_LIMITS = np.array([1 << b for b in BITS[1:].tolist()], np.uint64)
_WIDTHS = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8) + np.uint8(1)
BLOCK = 1024
MAGIC, VERSION, NULL_ID = b"S8BT", 1, -(1 << 63)
_HEAD = struct.Struct("<4sI5Q")
#: Segments of a file; a segment comes from one slice of text.
SEGMENTS = 64


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and index and value of escapes. The last word may have room for more ids than there are."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    escapes = np.flatnonzero(ids >> np.uint64(60))
    values = ids[escapes]
    if len(escapes):
        ids = ids.copy()
        ids[escapes] = 0
    if n == 0:
        return np.empty(0, np.uint64), escapes.astype(np.uint64), values
    # The narrowest selector that holds each id, and the widest of them over windows of each count, from shorter windows.
    width = np.zeros(n + int(COUNTS[0]), np.uint8)
    width[:n] = np.searchsorted(_LIMITS, ids, "right") + 1 if int(ids.max()) >> 16 else _WIDTHS[ids.astype(np.int64)]
    widest = {1: width}
    chosen = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):
        count = int(COUNTS[s])
        part = max(c for c in widest if c < count and count - c in widest)
        x, y = widest[part], widest[count - part]
        widest[count] = np.maximum(x[: len(width) - count + 1], y[part : part + len(width) - count + 1])
        fits = widest[count][:n] <= max(s, 1)
        if not fits.any():  # nor will longer windows of narrower ids
            break
        np.copyto(chosen, np.uint8(s), where=fits)
    at = _words_from(chosen)
    selectors = chosen[at]
    words = np.zeros(len(at), np.uint64)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for s in np.unique(selectors):
        rows = np.flatnonzero(selectors == s)
        if BITS[s]:
            steps = np.arange(COUNTS[s])
            words[rows] = np.bitwise_or.reduce(padded[at[rows][:, None] + steps] << (steps * BITS[s]).astype(np.uint64), axis=1)
        words[rows] |= np.uint64(int(s) << 60)
    return words, escapes.astype(np.uint64), values


def _words_from(chosen: np.ndarray) -> np.ndarray:
    """Where words begin, if a word that begins at i has selector chosen[i]: every 16th by following jumps of 16 words, then those between."""
    n = len(chosen)
    jumps = [np.append(np.minimum(np.arange(n, dtype=np.int32) + COUNTS.astype(np.int32)[chosen], np.int32(n)), np.int32(n))]
    for _ in range(4):
        jumps.append(jumps[-1][jumps[-1]])
    far, at, i = memoryview(jumps.pop()), [], 0
    while i < n:
        at.append(i)
        i = far[i]
    at = np.array(at, np.int64)
    for jump in reversed(jumps):
        at = np.stack([at, jump[at]], axis=1).ravel()
    return at[at < n]


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the words, without escapes."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selectors):
        if BITS[s]:
            rows, steps = np.flatnonzero(selectors == s), np.arange(COUNTS[s])
            out[first[rows][:, None] + steps] = words[rows][:, None] >> (steps * BITS[s]).astype(np.uint64) & np.uint64((1 << int(BITS[s])) - 1)
    return out[:n]


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, escapes, values = pack_words(ids)
    starts = np.concatenate([[0], np.cumsum(COUNTS[(words >> np.uint64(60)).astype(np.int64)])])[:-1][::BLOCK]
    body = _HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), len(words), len(escapes), len(starts))
    body += b"".join(np.ascontiguousarray(x, k).tobytes() for x, k in ((doc_ids, "<i8"), (lengths, "<u8"), (starts, "<u8"), (words, "<u8"), (escapes, "<u8"), (values, "<u8")))
    return body + struct.pack("<I", zlib.crc32(body))


def segments(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, lengths and ids of each segment of a file; raises ValueError on damage."""
    at = 0
    while at < len(content):
        if len(content) - at < _HEAD.size:
            raise ValueError("a segment is cut short")
        magic, version, n_docs, n_ids, n_words, n_escapes, n_blocks = _HEAD.unpack_from(content, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id segment")
        size = _HEAD.size + 8 * (2 * n_docs + n_blocks + n_words + 2 * n_escapes)
        if len(content) < at + size + 5 or content[at + size + 4 : at + size + 5] != b"\n":
            raise ValueError("a segment is cut short")
        take = iter(np.split(np.frombuffer(content, "<u8", (size - _HEAD.size) // 8, at + _HEAD.size), np.cumsum([n_docs, n_docs, n_blocks, n_words, n_escapes])))
        doc_ids, lengths, starts, words, escapes, values = (next(take) for _ in range(6))
        if zlib.crc32(memoryview(content)[at : at + size]) != struct.unpack_from("<I", content, at + size)[0]:
            raise ValueError("a segment is damaged")
        ids = unpack_words(words, n_ids)
        ids[escapes.astype(np.int64)] = values
        if len(ids) != n_ids or int(lengths.sum()) != n_ids or len(starts) != -(-n_words // BLOCK):
            raise ValueError("a segment's counts differ")
        yield doc_ids.view("<i8"), lengths.astype(np.int64), ids
        at += size + 5


def decode_block(words: np.ndarray, starts: np.ndarray, block: int, n_ids: int) -> np.ndarray:
    """The ids (without escapes) of one block of BLOCK words alone, by way of its offset."""
    end = int(starts[block + 1]) if block + 1 < len(starts) else n_ids
    return unpack_words(words[block * BLOCK : (block + 1) * BLOCK], end - int(starts[block]))


def write_token_files(docs: DataFrame, path: str, vocabulary: Vocabulary, end: int = 0) -> None:
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        for part, ids, lengths in encoded(vocabulary, batches, end):
            doc_ids = part.column("doc_id").fill_null(NULL_ID).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([encode_segment(doc_ids, lengths, ids)], pa.binary())], ["segment"])

    out = ordered.mapInArrow(tidy(run), "segment binary").select(F.col("segment").cast("string").alias("value"))
    out.write.option("lineSep", "\n").option("maxRecordsPerFile", SEGMENTS).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                at = 0
                for doc_ids, lengths, ids in segments(content.as_py()):
                    ids, ends = ids.astype("<u4"), np.cumsum(lengths)
                    starts = ends - lengths
                    sums = [crc32(ids[lo:hi]) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
                    columns = [pa.array([name] * len(lengths), pa.string()), pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(starts + at), pa.array(lengths), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "doc_id", "start", "n_tokens", "ids_crc32"])
                    at += int(lengths.sum())

    decoded = cut(files.mapInArrow(tidy(rows), "path string, doc_id long, start long, n_tokens long, ids_crc32 long"))
    # One row per file of up to SEGMENTS segments: the only thing that is ordered in one task.
    earlier = W.orderBy(F.col("least").asc_nulls_first(), "path").rowsBetween(W.unboundedPreceding, -1)
    least = F.when(F.count("*") > F.count("doc_id"), F.lit(None)).otherwise(F.min("doc_id"))
    sizes = decoded.groupBy("path").agg(F.sum("n_tokens").alias("n"), least.alias("least"))
    bases = sizes.select("path", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return decoded.join(bases, "path").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


@scoped
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, Vocabulary(spark))
    return read_token_files(spark, path)
