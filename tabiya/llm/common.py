"""Shared pieces of the training-data operators.

Row identity: where an operator needs to tell rows apart it uses `doc_id` and the content of
`text`; rows that repeat both are the same document and get the same decision.
Columns: operators read only the columns that they name, so extra columns of any name pass by.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tabiya.session import bounded_broadcast, cut, discard, reclaim, release, scoped, scratch, shared_dir, ship  # noqa: F401

#: Bytes of text that a Python worker holds decoded at a time, apart from one longer text.
SLICE_BYTES = 2 << 20
#: Bytes of a batch that a worker sends back, apart from one longer row.
SENT_BYTES = 1 << 20
#: Words whose hashes a worker remembers.
CACHE_HASHES = 200_000
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def own_names(docs: DataFrame, n: int) -> list[str]:
    """Names for n columns of an operator's own that docs has none of."""
    taken, found, k = {c.lower() for c in docs.columns}, [], 0
    while len(found) < n:
        if f"own_{k}" not in taken:
            found.append(f"own_{k}")
        k += 1
    return found


def tidy(run):
    """run() over a task's batches, after which the worker gives unused memory back. What it yields goes in pieces of about SENT_BYTES: the
    JVM holds a batch outside its heap."""

    def task(batches):
        for batch in run(batches):
            rows = max(1, int(batch.num_rows * SENT_BYTES / max(1, batch.nbytes)))
            for k in range(0, batch.num_rows, rows):
                yield batch.slice(k, rows)
        trim()

    return task


def trim() -> None:
    """Gives unused memory of this process back."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to at most `most`, or that hold one item."""
    ends = np.cumsum(sizes)
    lo, n = 0, len(sizes)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield lo, hi
        lo = hi


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in slices(sizes, most):
        yield batch.slice(lo, hi - lo)


def strings(column: pa.Array) -> list[str]:
    """Values with '' for null."""
    return [x if x is not None else "" for x in column.to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words (bytes), of which the first CACHE_HASHES are remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_HASHES:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: The worker's own.
WORDS = WordHashes()
#: How to forget what a worker remembers, by kind of work.
MEMORIES = {"words": WORDS.clear}


def remember(kind: str) -> None:
    """A worker that does one kind of work forgets what it remembers for others: stages follow one another in the same workers."""
    for other, forget in MEMORIES.items():
        if other != kind:
            forget()


def ascii_words(text: str) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xE7037ED1A0B428DB)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x8EBC6AF09C88C6E3)
    h ^= h >> np.uint64(32)
    return h


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct hashes, ascending, of the runs of k words; fewer words are one run; no word, no run."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += mix(words[i : n - width + 1 + i] + np.uint64(i)) * _MULT[i % 5]
    if width < k:  # a shorter run never equals a run of k words
        total += np.uint64(width)
    return np.unique(mix(total))


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """shingle_hashes() of each text's ascii_words(), with the worker's remembered words."""
    remember("words")
    words = [ascii_words(x) for x in texts]
    counts = [len(w) for w in words]
    flat = WORDS.of([x for w in words for x in w])
    ends = np.cumsum(counts).tolist()
    total = np.zeros(max(0, len(flat) - k + 1), np.uint64)
    for i in range(k if len(total) else 0):
        total += mix(flat[i : len(total) + i] + np.uint64(i)) * _MULT[i % 5]
    total = mix(total)
    return [np.unique(total[hi - n : hi - k + 1]) if n >= k else shingle_hashes(flat[hi - n : hi], k) for hi, n in zip(ends, counts, strict=True)]


def scatter(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket, in which each column's values of that bucket are one binary."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first, len(bucket))
    arrays = [pa.array(bucket[first].astype(np.int64))]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        offsets = (ends * values.itemsize).astype(np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def gather(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """The values of all rows of scatter()'s columns."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
    for batch in batches:
        for c, kind in kinds.items():
            parts[c] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(c)]
    return {c: np.concatenate(x) if x else np.empty(0, kinds[c]) for c, x in parts.items()}


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
