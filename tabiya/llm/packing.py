"""Best-fit packing of tokenised documents into sequences.

The histogram of piece lengths (at most `capacity` bins, whatever the data's size) goes to the driver. There a
configuration linear program - how often to use each way to fill a sequence, so that all lengths are covered - is solved by
multiplicative weights: a length's weight falls with the exponential of its coverage, and each step prices the lengths, dealt out
into groups at random, with a knapsack dynamic program, adds each group's best configuration and covers its lengths. It runs until
all tokens but a share TOLERANCE are covered. The solution is rounded to whole sequences within supply, configurations of few
pieces first, and the program is solved again for what is left, until little is or rounding finds no more. This remainder
is filled best-fit: configuration by configuration, largest length first, each with the fullest of the sums that the lengths left
allow; the shortest pieces, half a per cent of the tokens, wait for it. A piece finds its sequence from its rank among pieces of its length.

Null texts count as ''; each document ends with the end id, so each has a piece. Rows that repeat a doc_id are
packed each time. An empty table gives no rows. Extra columns pass by.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabiya.llm.common import cut, remember, scoped, table, tidy
from tabiya.llm.tokens import Vocabulary, crc32, encoded

#: Pieces of one length that are ranked in one task.
RANKED = 4_000
#: The program: tokens that may stay uncovered, how fast weights fall, what a step covers of the scarcest length, lengths priced together.
TOLERANCE, RATE, STEP, GROUP = 0.1, 0.3, 0.5, 128
#: Shares of the tokens: what the program may leave to the filling, what a round of it must place at least, what waits for the filling.
REMAINDER, LEAST_GAIN, RESERVE = 0.05, 0.01, 0.005


def token_pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; all pieces of a document but the first have the length capacity."""

    def run(batches):
        for part, ids, lengths in encoded(vocabulary, batches, end):
            doc, rows, at = part.column("doc_id").cast(pa.int64()).to_pylist(), [], 0
            for d, n in zip(doc, lengths.tolist(), strict=True):
                first = (n - 1) % capacity + 1
                for piece, lo in enumerate([0, *range(first, n, capacity)]):
                    hi = first if piece == 0 else lo + capacity
                    rows.append((d, piece, lo, hi - lo, crc32(ids[at + lo : at + hi])))
                at += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def price(values: np.ndarray, lengths: np.ndarray, supply: np.ndarray, capacity: int, full: float = 0.5) -> dict[int, int]:
    """Copies by index of a most valuable configuration within supply: a knapsack over binary multiples of each length.

    A configuration without room is taken if its value is at least the share `full` of the best.
    """
    best, items = np.full(capacity + 1, -np.inf), []
    best[0] = 0
    for i, (v, k, n) in enumerate(zip(values.tolist(), lengths.tolist(), np.minimum(supply, capacity // lengths).tolist(), strict=True)):
        part = 1
        while n > 0:
            take = min(part, n)
            size = k * take
            more = best[: capacity + 1 - size] + v * take
            better = more > best[size:]
            np.maximum(best[size:], more, out=best[size:])
            items.append((i, take, size, better.tobytes()))
            n, part = n - take, part * 2
    at = int(np.argmax(best))
    if best[capacity] >= full * best[at]:
        at = capacity
    copies: dict[int, int] = {}
    for i, take, size, better in reversed(items):
        if at >= size and better[at - size]:
            copies[i] = copies.get(i, 0) + take
            at -= size
    return copies


def program(lengths: np.ndarray, supply: np.ndarray, capacity: int, seed: int = 2) -> dict[tuple[tuple[int, int], ...], float]:
    """How often to use each configuration, as pairs (length, copies), so that all tokens but a share TOLERANCE are covered.

    The weights start with the cube of the length, so long pieces, which are hardest to place, come first.
    """
    random = np.random.default_rng(seed)
    covered, found, tokens = np.zeros(len(lengths)), {}, lengths * supply
    while (np.minimum(covered, 1) * tokens).sum() < (1 - TOLERANCE) * tokens.sum():
        weights = (lengths / capacity) ** 3 * np.exp(-covered / RATE)
        wanted = np.flatnonzero((covered < 1) | (random.random(len(lengths)) < 0.4))  # covered lengths only fill gaps
        for part in np.array_split(random.permutation(wanted), -(-len(wanted) // GROUP)):
            part = part[np.argsort(-lengths[part])]
            copies = price(weights[part], lengths[part], supply[part], capacity)
            pick = [(int(part[i]), n) for i, n in sorted(copies.items())]
            times = STEP * min(float(supply[i]) / n for i, n in pick)
            for i, n in pick:
                covered[i] += times * n / supply[i]
            key = tuple((int(lengths[i]), n) for i, n in pick)
            found[key] = found.get(key, 0.0) + times
    return found


def rounded(found: dict[tuple[tuple[int, int], ...], float], left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole uses of configurations within `left`, which loses their pieces; those with room only if the others place too little."""
    out, before, rest = [], tokens_of(left), list(found.items())
    for most_room in (0, capacity):
        some = [c for c in rest if capacity - sum(k * n for k, n in c[0]) <= most_room]
        for pick, x in sorted(some, key=lambda c: (sum(n for _, n in c[0]), -c[1], c[0])):
            times = min(max(1, int(x + 0.5)), *(left.get(k, 0) // n for k, n in pick))
            if times > 0:
                out.append((dict(pick), times))
                _take(left, dict(pick), times)
        if before - tokens_of(left) >= LEAST_GAIN * before:
            break
    return out


def tokens_of(histogram: dict[int, int]) -> int:
    return sum(k * n for k, n in histogram.items())


def _take(left: dict[int, int], copies: dict[int, int], times: int) -> None:
    for k, n in copies.items():
        left[k] -= n * times
        if not left[k]:
            del left[k]


def fill(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations that hold all of `left`: the largest length, with the lengths that leave least room, as often as these last."""
    left, out = dict(left), []
    while left:
        copies = fullest(left, max(left), capacity)
        times = min(left[k] // n for k, n in copies.items())
        out.append((copies, times))
        _take(left, copies, times)
    return out


def programmed(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations by the program for most of `left`, which loses their pieces."""
    out, whole = [], tokens_of(left)
    while left and (before := tokens_of(left)) > REMAINDER * whole:
        lengths = np.array(sorted(left), np.int64)
        out += rounded(program(lengths, np.array([left[k] for k in lengths.tolist()], np.int64), capacity, seed=len(out)), left, capacity)
        if before - tokens_of(left) < LEAST_GAIN * whole:
            break
    return out


def configurations(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(copies by length, how many sequences) that hold each piece of the histogram once, and how many of the list's first the program chose.

    Pieces of full length need no choice and come last. The shortest pieces, which hold a share RESERVE of the other tokens, wait
    for the filling, whose gaps they close.
    """
    left = {k: v for k, v in sorted(histogram.items()) if v > 0}
    full = left.pop(capacity, 0)
    room, waiting = RESERVE * tokens_of(left), {}
    for k, n in list(left.items()):
        if room <= 0:
            break
        waiting[k] = min(n, math.ceil(room / k))
        room -= k * waiting[k]
        _take(left, {k: 1}, waiting[k])
    chosen = programmed(left, capacity)
    for k, n in waiting.items():
        left[k] = left.get(k, 0) + n
    filled = fill(left, capacity)
    # Rounding may have taken configurations with room where the filling does with fewer.
    tight = [c for c in chosen if tokens_of(c[0]) == capacity]
    for copies, times in chosen:
        if tokens_of(copies) < capacity:
            for k, n in copies.items():
                left[k] = left.get(k, 0) + n * times
    if len(tight) < len(chosen):
        again = fill(left, capacity)
        if sum(t for _, t in tight + again) < sum(t for _, t in chosen + filled):
            chosen, filled = tight, again
    return chosen + filled + ([({capacity: 1}, full)] if full else []), len(chosen)


def fullest(left: dict[int, int], largest: int, capacity: int) -> dict[int, int]:
    """A configuration with `largest` that leaves least room: reachable sums as a bit set, each length in binary multiples."""
    room, items = capacity - largest, []
    usable = sorted((k for k in left if k <= room), reverse=True)
    sums, seen = 1, [1]
    for k in usable:
        n = min(left[k] - (k == largest), room // k)
        part = 1
        while n > 0:
            take = min(part, n)
            items.append((k, take))
            sums = (sums | (sums << (k * take))) & ((1 << (room + 1)) - 1)
            seen.append(sums)
            n, part = n - take, part * 2
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    target = sums.bit_length() - 1
    copies = {largest: 1}
    for (k, take), before in zip(reversed(items), reversed(seen[:-1]), strict=True):
        if not before >> target & 1:
            copies[k] = copies.get(k, 0) + take
            target -= k * take
    return copies


def slots(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), the sequence of that rank, its offset: as many rows as configurations have pieces."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for copies, times in plan:
        offset = 0
        for k in sorted(copies, reverse=True):
            for _ in range(copies[k]):
                rows.append(((k << 40) | taken.get(k, 0), sequence, offset))
                taken[k] = taken.get(k, 0) + times
                offset += k
        sequence += times
    rows.sort()
    table_ = np.array(rows, np.int64).reshape(-1, 3)
    return table_[:, 0].copy(), table_[:, 1].copy(), table_[:, 2].copy()


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces, which are read several times (so: a table)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("a piece is longer than a sequence or empty")
    keys, sequences, offsets = slots(configurations(counts, capacity)[0])
    plan = spark.sparkContext.broadcast((keys, sequences, offsets))
    # From an Arrow table: a list of rows would go through Python workers of another kind, and executors would keep both kinds.
    salts = spark.createDataFrame(pa.table({"length": pa.array(counts, pa.int64()), "salts": pa.array([-(-n // RANKED) for n in counts.values()], pa.int64())}))
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(inside)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("r") - 1).alias("rank"))

    def run(batches):
        remember("places")  # the encoder isn't needed any more
        keys, sequences, offsets = plan.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            key = (batch.column("length").to_numpy() << 40) | rank
            at = np.searchsorted(keys, key, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(sequences[at] + (key - keys[at])), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@scoped
def pack_documents(docs: DataFrame, vocabulary: Vocabulary, capacity: int = 2048, end: int = 0) -> DataFrame:
    return pack(cut(token_pieces(docs, vocabulary, capacity, end), 4), capacity)


@scoped
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), Vocabulary(spark))
