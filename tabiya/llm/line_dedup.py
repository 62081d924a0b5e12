"""Line dedup: drops lines that repeat an earlier line of the corpus, exactly or within a small edit distance.

Lines are what '\\n' separates; lines without a non-space character stay. Lines are in order of (doc_id, content of the
document, line number). A line goes if an earlier line is equal, or is within `edits` edits (of UTF-8 bytes) and
both have at least `least` bytes; so the first of each kind stays, and documents keep their other lines. With `per`, a line
also goes if an earlier one of at least `least` bytes is within one edit of words for each `per` words of the shorter of
both, so this bound grows with the line. Words are what ASCII white space separates.

Near lines by segment partition: each line is cut into edits + 1 segments; a line within that distance contains one of them
unchanged, at a place that length and segment number bound. Segments and the substrings that may equal them go by key
to blocks; of a key that many lines of a task have, only representatives do. Per key, all lines are verified against the earliest
one and the one with most copies first. Lines that this leaves open are paired with other earlier lines of the key if it has few lines. A key of many
lines is narrowed: what they have in common at the start, in the segment and at the end can't differ, so the rest of each line is cut
into segments again, until keys have few lines. Letter and letter-pair parities that any pair within the distance passes go before a
banded bit-parallel edit distance, which verifies every pair, so no pair is lost and none is wrong.

Lines near by words share a run of at least per // 2 words. Of each such run, the smallest hash of RUN words in a row is a
key of the line, salted with its class of length; a line that the class below may hold a shorter partner of is in that, too. Lines of
a key of many are dealt out by buckets of their words instead, of which near lines have one in common.

Null texts have no lines; null ids come first. Rows that repeat both doc_id and text are one document: they get the same decision.
Lines may be of any length. Other columns stay, whatever their names; dedup_lines()'s own n_lines and n_dropped replace those of the same
name, without_repeated_lines() adds no column. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import WORDS, bounded_broadcast, cut, discard, gather, mix, own_names, quoted, reclaim, remember, runs, scatter, scoped, table, text_slices, tidy

EDITS, LEAST = 2, 24
#: Words for each edit of words; words that are hashed together; the ratio of lengths in a class.
PER, RUN, CLASS = 20, 5, 1.15
BLOCK, HELD = 200_000, 1_000_000
#: Lines of a key, and open ones among them, that are paired with one another; a key with more of both is narrowed.
HOT, OPEN = 32, 16
#: Lines near a key's most frequent end that those which have this end are paired with; with more of them, all are narrowed.
STARS = 64
#: Buckets of a line before one of them that are looked at, so that near copies meet once.
AHEAD = 32
_R = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def within(a: bytes | list, b: bytes | list, most: int) -> bool:
    """Whether the edit distance is at most `most`: Myers' bit vectors on the band of 2 * most + 1 diagonals."""
    if abs(len(a) - len(b)) > most:
        return False
    n, lo = min(len(a), len(b)), 0
    if a[:n] == b[:n]:
        return True
    step = 1 << max(0, n.bit_length() - 1)
    while step:  # the common start, by bisection
        if lo + step <= n and a[lo : lo + step] == b[lo : lo + step]:
            lo += step
        step >>= 1
    a, b = a[lo:], b[lo:]
    m, n = len(a), len(b)
    width, full = 2 * most + 1, (1 << (2 * most + 1)) - 1
    low = full >> 1
    # Bit k of column j is row j - most + k of a, counted from 1; rows up to 0 rise like row -row.
    up, down = (full >> most) << most, 0
    score = most  # at the band's lowest row
    # By symbol, the rows of the band that match it, as of a column: later ones are further right.
    match: dict = {}

    def enter(x, bit, j):
        rows, at = match.get(x, (0, j))
        match[x] = (rows >> (j - at) | 1 << bit, j)

    for i, x in enumerate(a[:most]):
        enter(x, i + most + 1, 0)
    for j in range(1, n + 1):
        if j + most <= m:
            enter(a[j + most - 1], width - 1, j)
        rows, at = match.get(b[j - 1], (0, j))
        eq = rows >> (j - at)
        zero = ((((eq & up) + up) & full) ^ up) | eq | down
        for k in range(most - j + 1):  # rows up to 0 cost a deletion each: never diagonal
            zero &= ~(1 << k)
        right_up = down | (full & ~(zero | up))
        right_down = zero & up
        score += 1 - (zero >> (width - 1) & 1)
        if score > 3 * most:
            return False
        shifted = zero >> 1
        up = (right_down | (full & ~(shifted | right_up))) & full
        down = shifted & right_up
        up = (up & low) | (1 << (width - 1))
        down &= low
    for k in range(max(0, m - n + most), 2 * most):  # from row n + most up to row m
        score -= (up >> k & 1) - (down >> k & 1)
    return score <= most


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of that length; the later ones are longer by one if they must."""
    size, more = length // (edits + 1), length % (edits + 1)
    longer = np.maximum(0, i - (edits + 1 - more))
    return i * size + longer, size + (i >= edits + 1 - more)


class LineBytes:
    """Substring hashes of many lines: sums of byte values times powers, counted from each line's start."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        remember("lines")
        powers = np.full(int(size.max(initial=0)) + 1, _R, np.uint64)
        inverse = np.full(len(powers), pow(_R, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        powers, self.inverse = np.cumprod(powers), np.cumprod(inverse)
        self.start, self.size = start, size
        at = np.arange(len(data)) - np.repeat(start, size) if len(data) else np.empty(0, np.int64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers[at])])

    def hashes(self, line: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        lo = self.start[line] + place
        return (self.sums[lo + size] - self.sums[lo]) * self.inverse[place]


def line_keys(lines: LineBytes, edits: int, least: int) -> tuple[np.ndarray, ...]:
    """Keys, their lines, whether each is the line's segment (1) or a substring that may equal another's (0), its place and size, by
    how much the line is longer than the segment's, and the segment's number."""
    found: list[tuple[np.ndarray, ...]] = []

    def put(line, length, i, place, size, role, longer):
        salt = mix((length.astype(np.uint64) << np.uint64(4)) + np.uint64(i))
        found.append((mix(lines.hashes(line, place, size) ^ salt) & ~np.uint64(1), line, np.full(len(line), role, np.int64), place, size, np.full(len(line), longer, np.int64), np.full(len(line), i, np.int64)))

    every = np.flatnonzero(lines.size >= least)
    for i in range(edits + 1):
        place, size = segment(lines.size[every], i, edits)
        put(every, lines.size[every], i, place, size, 1, 0)
    for longer in range(edits + 1):
        line = np.flatnonzero(lines.size - longer >= least)
        length = lines.size[line] - longer
        for i in range(edits + 1):
            place, size = segment(length, i, edits)
            for shift in shifts(i, longer, edits):
                ok = (place + shift >= 0) & (place + shift + size <= lines.size[line])
                put(line[ok], length[ok], i, (place + shift)[ok], size[ok], 0, longer)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shifts(i: int, longer: int, edits: int) -> range:
    """Where segment i may begin, from its own place, in a line that is longer by so much."""
    return range(max(-i, longer - (edits - i)), min(i, longer + edits - i) + 1)


def line_words(lines: pa.Array, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lines have at least `per` words, how many, and the hashes of all these words."""
    words = [x.split() for x in lines.cast(pa.binary()).to_pylist()]
    long = [i for i, x in enumerate(words) if len(x) >= per]
    return np.array(long, np.int64), np.array([len(words[i]) for i in long], np.int64), WORDS.of([x for i in long for x in words[i]])


def shared_run(n: int, per: int) -> int:
    """Words in a row that a line of n words certainly has in common with one within n // per edits."""
    return -(-(n - n // per) // (n // per + 1))


def word_keys(line: np.ndarray, n: np.ndarray, words: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their lines (odd; those of line_keys() are even): lines within n // per edits of words have one in common.

    Both lines have keys for the class of the shorter one's length, from the runs that all lines of that class certainly share.
    """
    if not len(line):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.cumsum(n)
    shortest = np.maximum(n - n // (per + 1), per)  # of the lines that this one is at most one in `per` longer than
    own, below = (np.floor(np.log(x) / math.log(CLASS)).astype(np.int64) for x in (n, shortest))
    classes = np.unique(np.concatenate([own, below])).tolist()
    widths = {}  # hashes of a run that both lines have, by class
    for c in classes:
        low, high = max(per, math.floor(CLASS**c) - 1), math.ceil(CLASS ** (c + 1)) + 1
        widths[c] = min(shared_run(x, per) for x in range(low, min(high, low + 20 * per) + 1)) - RUN + 1
    total = np.zeros(max(0, len(words) - RUN + 1), np.uint64)
    for i in range(RUN):
        total = mix(total ^ words[i : len(total) + i]) + np.uint64(i)
    keys, lines = [], []
    least, done = total.copy(), 1
    for width in sorted(set(widths.values())):
        for i in range(done, width):
            least = np.minimum(least[:-1], total[i : i + len(least) - 1])
        done = max(done, width)
        at = np.arange(len(least))
        owner = np.searchsorted(ends, at, "right")
        inside = at + width + RUN - 1 <= ends[owner]
        for of, skip in ((own, None), (below, own)):
            wanted = np.array([widths[c] == width for c in of.tolist()]) & (True if skip is None else of != skip)
            keep = inside & wanted[owner]
            who, what = distinct_pairs(owner[keep], least[keep])
            keys.append(mix(what ^ mix(of[who].astype(np.uint64))) | np.uint64(1))
            lines.append(line[who])
    return np.concatenate(keys), np.concatenate(lines)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and where each value starts and how long it is."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], np.diff(offsets)


def numbered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, line_no, line for lines with a non-space character."""
    split = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.filter(F.col("line").rlike(r"[^\s]"))


def near_lines(docs: DataFrame, firsts: DataFrame, edits: int, least: int, per: int = 0) -> DataFrame:
    """node of each distinct line that is within the distance of an earlier one."""
    if per and per // 2 < RUN:
        raise ValueError("too few words for each edit")
    blocks = max(64, math.ceil(firsts.filter(F.col("size") >= least).count() * (3 * edits + 9 + (18 if per else 0)) / BLOCK))

    def deal(batches):
        seen, held, n = set(), [], 0

        def out():
            k, v = distinct_pairs(*(np.concatenate([x[c] for x in held]) for c in (0, 1)))
            bucket = ((k >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            # Of a key that meets here already, its first and last entry tell other tasks; the others go to any block, as met.
            first, length = runs(k)
            node, role = v & ~np.int64(1), v & 1
            many = np.repeat((length > HOT) & _meets(k, node, role, first), length)
            many[first] = many[first + length - 1] = False
            return scatter(np.where(many, np.arange(len(k)) % blocks, bucket), {"k": k, "v": v, "met": many.astype(np.uint8)})

        for batch in batches:
            for part in text_slices(batch, "line", 1 << 20):
                h = part.column("h").to_numpy()
                new = np.unique(h, return_index=True)[1]
                new = new[[x not in seen for x in h[new].tolist()]]
                seen.update(h[new].tolist())
                lines = part.column("line").take(pa.array(new))
                if not len(new):
                    continue
                keys, owners, roles, *_ = line_keys(LineBytes(*_buffer(pc.fill_null(lines, ""))), edits, least)
                if per:
                    more, of = word_keys(*line_words(lines, per), per)
                    keys, owners, roles = np.concatenate([keys, more]), np.concatenate([owners, of]), np.concatenate([roles, np.zeros(len(of), np.int64)])
                held.append((keys, (h[new][owners] & ~np.int64(1)) | roles))
                n += len(keys)
                if n > HELD:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def meet(batches):
        x = gather(batches, {"k": np.uint64, "v": np.int64, "met": np.uint8})
        order = np.argsort(x["k"], kind="stable")
        k, v, met = x["k"][order], x["v"][order], x["met"][order] == 1
        first, length = runs(k)
        if not len(first):
            return
        keep = met | np.repeat(_meets(k, v & ~np.int64(1), v & 1, first), length)
        found = distinct_pairs(k[keep], v[keep])
        yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1] & ~np.int64(1)), pa.array(found[1] & 1)], ["k", "node", "role"])

    lines = numbered_lines(docs).filter(F.octet_length("line") >= least).select(F.xxhash64("line").alias("h"), "line")
    dealt = lines.mapInArrow(tidy(deal), "bucket long, k binary, v binary, met binary").repartition(blocks, "bucket")
    met = cut(dealt.mapInArrow(tidy(meet), "k long, node long, role long"), 2)
    reclaim(docs.sparkSession)  # the largest shuffle of all
    # The lines that met any other, with their text from the place of their first occurrence.
    nodes = met.select("node").distinct().join(firsts.select("node", "first", F.least("times", F.lit(1 << 30)).cast("int").alias("times")), "node")
    places = cut(nodes.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.doc_key").alias("doc_key")).agg(F.collect_list(F.struct("node", "first", "times")).alias("found")))
    here = docs.select("doc_id", "text", F.xxhash64("text").alias("doc_key"))
    there = bounded_broadcast(places).withColumnsRenamed({"doc_id": "d", "doc_key": "e"})
    texts = here.join(there, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_key") == F.col("e"))).select(F.split("text", "\n", -1).alias("lines"), F.explode("found").alias("x"))
    texts = texts.select("x.node", "x.first", "x.times", F.element_at("lines", F.col("x.first.line_no") + 1).alias("line"))

    def parities(batches):
        for batch in batches:
            for part in text_slices(batch, "line", 1 << 20):
                data, start, size = _buffer(part.column("line"))
                one = np.uint64(1) << (data.astype(np.uint64) * np.uint64(37) % np.uint64(64))
                pairs = one.copy()
                pairs[:-1] = np.uint64(1) << (mix(data[:-1].astype(np.uint64) * np.uint64(256) + data[1:]) >> np.uint64(58))
                pairs[start + size - 1] = 0  # a line's last byte starts no pair
                columns = [pa.array(np.bitwise_xor.reduceat(x, start).view(np.int64)) for x in (one, pairs)] if len(start) else [pa.array([], pa.int64())] * 2
                n, odd = np.zeros(len(start), np.int64), np.zeros(len(start), np.uint64)
                long, sizes, words = line_words(part.column("line"), per) if per else (n[:0], n[:0], odd[:0])
                if len(long):
                    n[long], odd[long] = sizes, np.bitwise_xor.reduceat(np.uint64(1) << (mix(words) >> np.uint64(58)), np.cumsum(sizes) - sizes)
                columns += [pa.array(n), pa.array(odd.view(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("first"), part.column("times"), part.column("line"), *columns], ["node", "first", "times", "line", "p", "q", "n", "o"])

    first_type = firsts.schema["first"].dataType.simpleString()
    known = cut(texts.mapInArrow(tidy(parities), f"node long, first {first_type}, times int, line string, p long, q long, n long, o long").dropDuplicates(["node"]), 2)
    discard(places)
    reclaim(docs.sparkSession)
    return _earlier(met, known, edits, per)


def _meets(k: np.ndarray, node: np.ndarray, role: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By run of a key: whether it has two nodes, and both roles or is a key of words."""
    both = (k[first] & np.uint64(1) == 1) | (np.maximum.reduceat(role, first) == 1) & (np.minimum.reduceat(role, first) == 0)
    return (np.minimum.reduceat(node, first) != np.maximum.reduceat(node, first)) & both


def distinct_pairs(k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs."""
    order = np.lexsort((v, k))
    k, v = k[order], v[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])]) if len(k) else np.empty(0, bool)
    return k[new], v[new]


def _earlier(met: DataFrame, known: DataFrame, edits: int, per: int) -> DataFrame:
    marks = known.select("node", "first", "times", "p", "q", "n", "o")
    placed = cut(met.join(marks, "node"))
    discard(met)
    reclaim(known.sparkSession)
    by_words = F.col("k").bitwiseAND(F.lit(1)) == 1

    def alike():
        bytes_ = (F.bit_count(F.col("p").bitwiseXOR(F.col("p2"))) <= 2 * edits) & (F.bit_count(F.col("q").bitwiseXOR(F.col("q2"))) <= 4 * edits)
        if not per:
            return bytes_
        most = F.floor(F.least("n", "n2") / per)
        return F.when(by_words, (F.abs(F.col("n") - F.col("n2")) <= most) & (F.bit_count(F.col("o").bitwiseXOR(F.col("o2"))) <= 2 * most)).otherwise(bytes_)

    def near(x: bytes, y: bytes) -> bool:
        if within(x, y, edits):
            return True
        if not per:
            return False
        x, y = x.split(), y.split()
        most = min(len(x), len(y)) // per
        return most > 0 and within(x, y, most)

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                keep = [near(x.encode(), y.encode()) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(keep, pa.bool_()))], ["node"])

        x = known.select("node", F.col("line").alias("x"))
        y = known.select(F.col("node").alias("other"), F.col("line").alias("y"))
        return pairs.join(x, "node").join(y, "other").select("node", "x", "y").mapInArrow(tidy(run), "node long").distinct()

    # Per key, the earliest line and the one with most copies: of a group of near copies, this is the text that the others come from.
    one = F.struct("first", "node", "p", "q", "n", "o")
    both = placed.groupBy("k").agg(F.min(one).alias("c"), F.max_by(one, F.struct("times", "node")).alias("d"))
    both = both.select("k", F.explode(F.array_distinct(F.array("c", "d"))).alias("c"))
    both = both.select("k", F.col("c.node").alias("other"), F.col("c.first").alias("before"), *(F.col(f"c.{x}").alias(f"{x}2") for x in "pqno"))
    tried = placed.join(both, "k").filter((F.col("before") < F.col("first")) & alike()).select("node", "other").distinct()
    done, n = cut(verified(tried)), known.count()
    # Then against the earliest that is still open, as long as that finds many: groups of near copies shrink fast. Each round reads what the
    # one before left open, so its table is smaller.
    left, closed = placed, done
    while True:
        rest = cut(left.join(closed, "node", "left_anti"))
        if left is not placed:
            discard(left)
        left = rest
        of = left.groupBy("k").agg(F.min(F.struct("first", "node", "p", "q", "n", "o")).alias("c"), F.count("*").alias("size")).filter("size > 2")
        of = of.select("k", F.col("c.node").alias("other"), *(F.col(f"c.{x}").alias(f"{x}2") for x in "pqno"))
        closed = cut(verified(left.join(of, "k").filter((F.col("node") != F.col("other")) & alike()).select("node", "other").distinct()))
        reclaim(known.sparkSession)
        open_, found = n - done.count(), closed.count()
        if not found:
            break
        done = cut(done.union(closed))
        if found * 3 < open_:
            break
    discard(left)
    pairs = cut(open_pairs(placed, done, known, edits, per, by_words, alike))
    reclaim(known.sparkSession)
    return done.union(verified(pairs)).distinct()


def open_pairs(placed: DataFrame, done: DataFrame, known: DataFrame, edits: int, per: int, by_words, alike) -> DataFrame:
    """node, other: pairs of lines that no line before is known for (placed without done) and earlier ones of one of their keys, if alike()."""
    left = cut(placed.join(done, "node", "left_anti"))
    open_ = left.groupBy("k").agg(F.count("*").alias("open")).filter(F.col("open") > OPEN)
    sizes = placed.groupBy("k").agg(F.count("*").alias("size")).filter(F.col("size") > HOT)
    hot = cut(sizes.join(open_, "k").select("k", by_words.alias("words")))
    kinds = {r["words"] for r in hot.select("words").distinct().collect()}
    theirs = [F.col("first").alias("before"), *(F.col(x).alias(f"{x}2") for x in "pqno")]
    others = placed.select("k", F.col("node").alias("other"), F.col("role").alias("role2"), *theirs)
    few = left.join(bounded_broadcast(hot.select("k")), "k", "left_anti") if kinds else left
    earlier = F.col("before") < F.col("first")
    pairs = few.join(others, "k").filter(earlier & (by_words | (F.col("role") != F.col("role2"))) & alike()).select("node", "other")
    nodes, marks = left.select("node").distinct(), known.select("node", "first", *"pqno")
    if False in kinds:
        rows = placed.select("k", "node", "role", "first", "p", "q").join(bounded_broadcast(hot.filter("not words").select("k")), "k", "left_semi")
        found = narrowed(rows.join(known.select("node", "line"), "node"), nodes, edits).join(marks, "node")
        found = found.join(marks.select(F.col("node").alias("other"), *theirs), "other").withColumn("k", F.lit(0).cast("long"))
        pairs = pairs.union(found.filter(earlier & alike()).select("node", "other"))
    if True in kinds:
        some = placed.join(bounded_broadcast(hot.filter("words").select("k")), "k", "left_semi").select("node").distinct()
        rows = cut(bucketed(known.join(some, "node", "left_semi"), per).join(marks, "node"))
        found = rows.join(nodes, "node", "left_semi").join(rows.select("k", F.col("node").alias("other"), F.col("ahead").alias("ahead2"), *theirs), "k")
        # Near copies share most buckets: a pair is only made in one of them that none of the AHEAD before it is shared.
        new = ~F.coalesce(F.exists(F.zip_with("ahead", "ahead2", lambda a, b: a == b), lambda x: x), F.lit(False))
        pairs = pairs.union(found.filter(new & earlier & alike()).select("node", "other"))
    return pairs.distinct()


def bucketed(lines: DataFrame, per: int) -> DataFrame:
    """node, k, ahead: lines within m edits of words differ in at most 2m words, so of 2m + 1 buckets of words one holds the same: a key for each.

    ahead: the keys of the AHEAD buckets before it. A line of n words has keys for each m that n // per is for a partner not longer than it.
    """

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "line", 1 << 16):
                nodes, keys, ahead = [], [], []
                for node, line in zip(part.column("node").to_pylist(), part.column("line").cast(pa.binary()).to_pylist(), strict=True):
                    words = WORDS.of(line.split())
                    n = len(words)
                    for m in range((n - n // (per + 1)) // per, n // per + 1):
                        total = np.zeros(2 * m + 1, np.uint64)
                        np.add.at(total, (mix(words ^ np.uint64(m)) % np.uint64(2 * m + 1)).astype(np.int64), mix(words))
                        own = (mix(total ^ mix(np.arange(2 * m + 1, dtype=np.uint64) + np.uint64(m << 20))) | np.uint64(1)).view(np.int64).tolist()
                        keys += own
                        ahead += [own[max(0, j - AHEAD) : j] for j in range(len(own))]
                        nodes += [node] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.int64()), pa.array(ahead, pa.list_(pa.int64()))], ["node", "k", "ahead"])

    return lines.select("node", "line").mapInArrow(tidy(run), "node long, k long, ahead array<long>")


def subsequences(x: bytes, n: int) -> set[bytes]:
    return {bytes(c) for c in combinations(x, n)}


def narrower(rest: bytes, role: int, longer: int, key: int, edits: int):
    """(key, what is then left of the text, whether all of the key are near each other, outer()) of a line's rest under each key that a near line's has.

    The rest of the segment's line (role 1) is cut as lines are; of one not longer than the edits, some characters are the same.
    """
    n = len(rest) - (0 if role else longer)
    if n > edits:
        step, more = divmod(n, edits + 1)
        for i in range(edits + 1):
            place, size = i * step + max(0, i - (edits + 1 - more)), step + (i >= edits + 1 - more)
            for shift in (0,) if role else shifts(i, longer, edits):
                at = place + shift
                if at >= 0 and at + size <= len(rest):
                    key_ = xxhash.xxh3_64_intdigest(b"%d %d %d " % (key, n, i) + rest[at : at + size])
                    yield key_, rest[:at] + rest[at + size :], False, outer(rest, n, i, edits)
    elif n >= 0:
        for d in range(edits + 1) if role else (longer,):
            same = max(0, n - (edits - d))
            for x in subsequences(rest, same):
                yield xxhash.xxh3_64_intdigest(b"%d %d %d short " % (key, n, d) + x), None, not same, (None,) * 4


def outer(rest: bytes, n: int, i: int, edits: int) -> tuple:
    """What else a near line may share, whose pairs this key can leave to that one's: the first segment unless i is it, and the last one reversed
    unless i is either. Each with the characters after it, as many as the edits. These two have one place in any line."""
    step, more = divmod(n, edits + 1)
    a = b = (None, None)
    if i:
        a = rest[:step], rest[step : step + edits]
        if i < edits:
            step += more > 0
            b = rest[-step:][::-1], rest[:-step][-edits:][::-1] if edits else b""
    return *a, *b


def begins(a: bytes, b: bytes, most: int) -> bool:
    """Whether some beginning of b is within `most` edits of a."""
    n = common(a, b)
    if n == len(a):
        return True
    if not most:
        return False
    a, b = a[n:], b[n:]
    return begins(a[1:], b[1:], most - 1) or begins(a[1:], b, most - 1) or (len(b) > 0 and begins(a, b[1:], most - 1))


def common(a: bytes, b: bytes) -> int:
    """How many characters both begin with, by bisection."""
    lo, n = 0, min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    while n - lo > 1:
        mid = (lo + n) // 2
        lo, n = (mid, n) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def narrowed(rows: DataFrame, left: DataFrame, edits: int) -> DataFrame:
    """node, other: pairs of a line in `left` and an earlier one with which it has a key, by keys of few lines each.

    rows: k, node, role, first, line and the parities p and q, which a pair must have alike. A level drops what all of a key's rests begin and end with, which is in their least and greatest, and
    deals the rests out by the segments of what stays, so each level has shorter rests. Of a key of many lines, those that have the most frequent
    end (outer(): pairs of equal ones are another key's) are only paired with those whose end is near it, and go no further.
    """
    rest_kinds = "longer long, rest binary, tser binary, near boolean, la binary, ea binary, lb binary, eb binary"
    passing = ["node", "role", "first", "p", "q", "left"]
    types = {x.split()[0]: pa.int64() if x.endswith("long") else pa.bool_() if x.endswith("boolean") else pa.binary() for x in rest_kinds.split(", ")}
    kinds = f"k long, node long, role long, first {rows.schema['first'].dataType.simpleString()}, p long, q long, left boolean, {rest_kinds}"

    stripped = ["k", *passing, "longer", "rest", "head", "tail"]
    stripped_kinds = f"{kinds.split(', tser')[0]}, head long, tail long"

    def batch_of(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        """found: row, key and the columns of rest_kinds."""
        of, k, *columns = zip(*found, strict=True) if found else [()] * (len(types) + 2)
        of = pa.array(of, pa.int64())
        made = [pa.array(k, pa.int64()), *(batch.column(c).take(of) for c in passing), *(pa.array(c, t) for c, t in zip(columns, types.values(), strict=True))]
        return pa.RecordBatch.from_arrays(made, ["k", *passing, *types])

    def start(batches):
        for batch in batches:
            for part in text_slices(batch, "line", 1 << 18):
                keys, line, role, place, size, longer, number = line_keys(LineBytes(*_buffer(part.column("line"))), edits, 0)
                wanted, wanted_role = part.column("k").to_numpy().view(np.uint64), part.column("role").to_numpy()
                texts, found = part.column("line").cast(pa.binary()).to_pylist(), []
                for j in np.flatnonzero((keys == wanted[line]) & (role == wanted_role[line])).tolist():
                    i, at, d = int(line[j]), int(place[j]), int(longer[j])
                    rest = texts[i][:at] + texts[i][at + int(size[j]) :]
                    found.append((i, int(wanted.view(np.int64)[i]), d, rest, rest[::-1], False, *outer(texts[i], len(texts[i]) - d, int(number[j]), edits)))
                yield batch_of(part, found)

    def ends(batches):
        for batch in batches:
            of = zip(*(batch.column(c).to_pylist() for c in ("k", "lo", "hi", "ol", "ih", "shortest")), strict=True)
            found = [(k, (n := common(lo, hi)), min(common(ol, ih), shortest - n)) for k, lo, hi, ol, ih, shortest in of]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], ["k", "head", "tail"])

    def mark(batches):
        """a, b: 1 for the key's most frequent end, 2 for one near it, 0 for others."""
        for batch in batches:
            states = []
            for end, more, most in (("la", "ea", "da"), ("lb", "eb", "db")):
                of = zip(*(batch.column(c).to_pylist() for c in (end, more, most)), strict=True)
                states.append(pa.array([0 if x is None else 1 if x == d else 2 if begins(d, x + e, edits) else 0 for x, e, d in of], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stripped), *states], [*stripped, "a", "b"])

    def narrow(batches):
        for batch in batches:
            found = []
            of = zip(*(batch.column(c).to_pylist() for c in ("k", "role", "longer", "rest", "head", "tail")), strict=True)
            for i, (k, role, longer, rest, head, tail) in enumerate(of):
                for key, less, near, others in narrower(rest[head : len(rest) - tail], role, longer, k, edits):
                    found.append((i, (key & ~1) - (1 << 64) * (key >> 63), longer, less, less and less[::-1], near, *others))
                    if len(found) > 20_000:
                        yield batch_of(batch, found)
                        found = []
            yield batch_of(batch, found)

    def both(x: DataFrame, y: DataFrame) -> DataFrame:
        """node, other: pairs of an open line of x and a line of y of the same key before it that may be near it."""
        y = y.select("k", *(F.col(c).alias(d) for c, d in (("node", "other"), ("role", "role2"), ("first", "before"), ("p", "p2"), ("q", "q2"))))
        alike = (F.bit_count(F.col("p").bitwiseXOR(F.col("p2"))) <= 2 * edits) & (F.bit_count(F.col("q").bitwiseXOR(F.col("q2"))) <= 4 * edits)
        return x.filter("left").join(y, "k").filter((F.col("before") < F.col("first")) & (F.col("role") != F.col("role2")) & alike).select("node", "other")

    def most_frequent(rows: DataFrame, end: str, name: str) -> DataFrame:
        counts = rows.filter(F.col(end).isNotNull()).groupBy("k", end).agg(F.count("*").alias("n"))
        return counts.groupBy("k").agg(F.max_by(end, F.struct("n", end)).alias(name))

    opened = rows.join(left.withColumn("left", F.lit(True)), "node", "left")
    at, pairs = cut(opened.select("k", *passing, "line").mapInArrow(tidy(start), kinds)), None
    while True:
        # What a key's lines are: both roles, at least two, one of them open.
        of = at.groupBy("k", "near").agg(
            F.count("*").alias("size"), F.min("role").alias("r"), F.max("role").alias("s"), F.min("node").alias("x"), F.max("node").alias("y"), F.count("left").alias("open"),
            F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.min("tser").alias("ol"), F.max("tser").alias("ih"), F.min(F.octet_length("rest")).alias("shortest"),
            *(F.min(F.when(F.col("role") == r, F.struct("first", "node"))).alias(f"first{r}") for r in (0, 1)),
        ).filter("r < s and x < y and open > 0")
        of = cut(of)
        more = (F.col("size") > HOT) & (F.col("open") > OPEN) & ~F.col("near") & F.col("lo").isNotNull()
        hot = of.filter(more).select("k", "lo", "hi", "ol", "ih", "shortest").mapInArrow(tidy(ends), "k long, head long, tail long")
        hot = cut(hot.join(most_frequent(at, "la", "da"), "k", "left").join(most_frequent(at, "lb", "db"), "k", "left"))
        known = of.select("k", F.when(F.col("near"), F.col("first0")).alias("first0"), F.when(F.col("near"), F.col("first1")).alias("first1")).join(hot, "k", "left")
        at = cut(at.join(bounded_broadcast(cut(known)), "k"))
        # Near ones are compared with the earliest of the other role, those of few lines, or of short rests, with all.
        one = at.filter("left and near").withColumn("c", F.when(F.col("role") == 1, F.col("first0")).otherwise(F.col("first1")))
        one = one.filter(F.col("c.first") < F.col("first")).select("node", F.col("c.node").alias("other"))
        few = at.filter("not near and head is null")
        found = one.union(both(few, few))
        many = hot.limit(1).count() > 0
        if many:
            marked = cut(at.filter("head is not null").select(*stripped, "la", "ea", "lb", "eb", "da", "db").mapInArrow(tidy(mark), f"{stripped_kinds}, a long, b long"))
            # Lines of the most frequent end go no further where few ends are near it, by the first end or else by the last.
            by_first = F.count_if(F.col("a") == 2) <= STARS
            by_last = F.count_if((F.col("b") == 2) & (F.col("a") != 1)) + F.when(by_first, 0).otherwise(F.count_if((F.col("a") == 1) & (F.col("b") == 2))) <= STARS
            ways = cut(marked.groupBy("k").agg(by_first.alias("by_first"), by_last.alias("by_last")))
            marked = marked.join(bounded_broadcast(ways), "k")
            marked = cut(marked.withColumn("alone", F.when(F.col("by_first") & (F.col("a") == 1), 1).when(F.col("by_last") & (F.col("b") == 1), 2).otherwise(0)))
            for alone, end in ((1, "by_first and a = 2"), (2, "by_last and b = 2 and alone != 1")):
                x, y = marked.filter(F.col("alone") == alone), marked.filter(end)
                found = found.union(both(x, y)).union(both(y, x))
        found = cut(found.distinct())
        pairs = found if pairs is None else pairs.union(found)
        if not many:
            return pairs.distinct()
        at = cut(marked.filter("alone = 0").mapInArrow(tidy(narrow), kinds).distinct())
        reclaim(rows.sparkSession)


def dropped_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, per: int = 0) -> DataFrame:
    """doc_id, doc_key, dropped (numbers of the lines that go) for documents that lose lines; docs is read several times."""
    place = F.struct("doc_id", "doc_key", "line_no")
    lines = cut(numbered_lines(docs).select("doc_id", "doc_key", "line_no", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"), F.octet_length("line").alias("size")), 2)
    firsts = lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.first("size").alias("size"))
    firsts = cut(firsts.withColumn("node", F.col("h").bitwiseAND(F.lit(-2))))
    near = near_lines(docs, firsts, edits, least, per).withColumn("near", F.lit(True))
    some = firsts.join(near, "node", "left").filter("times > 1 or near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.join(some, ["h", "g"]).filter(F.col("near") | ~place.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "doc_key").agg(F.collect_set("line_no").alias("dropped"))


@scoped
def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, per: int = 0) -> DataFrame:
    """docs with the lines that stay as text, n_lines and n_dropped (of all lines)."""
    gone = bounded_broadcast(cut(dropped_lines(docs, edits, least, per)))
    docs = docs.drop("n_lines", "n_dropped")
    d, e, dropped, whole = own_names(docs, 4)
    gone = gone.select(F.col("doc_id").alias(d), F.col("doc_key").alias(e), F.col("dropped").alias(dropped))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(e)), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    text = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    others = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    out = joined.select(*others, F.col("text").alias(whole), text.alias("text"), dropped)
    n = F.when(F.col(whole).isNull(), 0).otherwise(F.length(whole) - F.length(F.replace(F.col(whole), F.lit("\n"), F.lit(""))) + 1)
    return out.select(*map(quoted, docs.columns), n.cast("long").alias("n_lines"), F.greatest(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"))


@scoped
def without_repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, per: int = 0) -> DataFrame:
    """docs with the lines that stay, n_chars counted anew, and without documents that have lost all they held."""
    mine = dict(zip(("n_lines", "n_dropped"), own_names(docs, 2), strict=True))  # a caller's columns of these names pass by
    found = dedup_lines(docs.withColumnsRenamed(mine), edits, least, per)
    empty = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\s]")
    columns = [F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(quoted(mine.get(c, c))).alias(c) for c in docs.columns]
    return found.filter(~F.coalesce(empty, F.lit(False))).select(*columns)


@scoped
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE_OP8 = """
WITH l AS (
  SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents
), f AS (
  SELECT line, min(doc_id * 1000000 + line_no) AS first, strlen(line) AS size FROM l WHERE regexp_matches(line, '[^\\s]') GROUP BY line
), near AS (
  SELECT DISTINCT b.line FROM f a JOIN f b ON a.first < b.first AND a.size >= 24 AND b.size >= 24 AND a.size BETWEEN b.size - 2 AND b.size + 2
  WHERE levenshtein(a.line, b.line) <= 2
), m AS (
  SELECT l.doc_id, l.line_no, l.line, f.line IS NOT NULL AND (near.line IS NOT NULL OR f.first <> l.doc_id * 1000000 + l.line_no) AS gone
  FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near ON l.line = near.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM m GROUP BY doc_id
"""
