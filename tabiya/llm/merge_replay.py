"""Byte-level BPE encoding and decoding with a rank file, by corpus-level merge replay.

Each match of a pattern is encoded by itself: as one token if it is one, else from its bytes, of whose neighbouring pairs the one with the lowest rank
(the leftmost of several) is merged until no pair has a rank. The replay does so for many distinct words at once: an inverted index lists for each rank
the places of all words where a pair has it, ranks are applied in ascending order, and a merge only changes the entries of its two neighbours.

Over a corpus: texts are cut into chunks before spaces that certainly begin a match (tokens.ChunkEncoder has the rules; a text with white space that
leaves a doubt is replayed whole). Chunks are counted over all texts; of the frequent ones (at most FREQUENT, each of at most LONGEST bytes) each is
replayed once for the whole corpus, and their ids are sent to all workers. What a slice of texts holds besides is replayed together within the slice and
remembered while there is room. No chunk's ids depend on which are frequent.

Null texts count as '' and have no ids. Texts are encoded whole, whatever their length; repeated rows each have their result; an empty table gives no rows.
Other columns are left out.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import MEMORIES, cut, remember, scoped, slices, table, text_slices, tidy
from tabiya.llm.tokens import CACHE_CHUNKS, ENCODED_BYTES, WHOLE, ChunkEncoder, Entries, chunk_hashes

#: Chunks that are replayed for the whole corpus, and the bytes of the longest of them.
FREQUENT, LONGEST = 150_000, 48
#: Distinct chunks that a worker counts before it sends the counts on.
COUNTED = 1_000_000
#: Bytes of distinct words that are replayed together.
REPLAYED = 4 << 20
#: Places of a rank from which on they are merged together.
MANY = 150


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from start[k] on, length[k] of them, for one k after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Ranks:
    """A rank file: tokens by id, ids by token, and the ranks of pairs."""

    def __init__(self, content: bytes, pattern: str):
        rows = [line.split() for line in content.splitlines() if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens: list[bytes] = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.pattern = regex.compile(pattern)
        singles = [bytes([b]) for b in range(256)]
        self.of_byte = np.array([self.ids[x] for x in singles], np.int32)
        self.of_bytes = np.array([self.ids.get(x + y, -1) for x in singles for y in singles], np.int32)
        self.size = np.array([len(x) for x in self.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pairs: dict[int, int] = {}

    def pair(self, left: int, right: int) -> int:
        """The rank of two neighbouring tokens, or -1."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            found = self.pairs[key] = self.ids.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has; words aren't empty."""
        known = np.array([self.ids.get(x, -1) for x in words], np.int64)
        rest = np.flatnonzero(known < 0)
        length = np.ones(len(words), np.int64)
        ids = known
        if len(rest):
            merged, length[rest] = self._merged([words[k] for k in rest.tolist()])
            start = np.cumsum(length) - length
            ids = np.empty(int(length.sum()), np.int64)
            ids[start[known >= 0]] = known[known >= 0]
            ids[ragged(start[rest], length[rest])] = merged
        return ids.astype(np.uint32), length

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(x) for x in words], np.int64)
        ends, n = np.cumsum(size), len(data)
        # By place: the token that begins there (-1: none does any more), the rank of it and the next, the places of the next and the one before.
        rank = np.full(n, -1, np.int32)
        rank[:-1] = self.of_bytes[data[:-1].astype(np.int64) * 256 + data[1:]]
        rank[ends - 1] = -1
        after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        after[ends - 1], before[ends - size] = -1, -1
        # The inverted index: from a rank to the places where a pair has it.
        order = np.argsort(rank, kind="stable")
        order = order[np.searchsorted(rank[order], 0) :]
        found, first = np.unique(rank[order], return_index=True)
        index = {int(r): array("q", x.tobytes()) for r, x in zip(found.tolist(), np.split(order.astype(np.int64), first[1:]), strict=True)} if len(found) else {}
        heap = sorted(index)
        token, rank, after, before = (array("q", x.astype(np.int64).tobytes()) for x in (self.of_byte[data], rank, after, before))
        columns = tuple(np.frombuffer(x, np.int64) for x in (token, rank, after, before))  # the same memory
        pair, known, push = self.pair, self.pairs.get, heapq.heappush
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            if len(places) >= MANY:
                places = self._together(r, np.frombuffer(places, np.int64), columns, ends, index, heap)
            held, waiting = -1, []
            for i in sorted(places) if len(places) > 1 else places:
                if rank[i] != r:
                    continue
                if i < held:  # its word has a pair of a lower rank first
                    waiting.append(i)
                    continue
                gone, token[i] = after[i], r
                token[gone] = rank[gone] = -1
                after[i] = k = after[gone]
                new, least = -1, r
                if k >= 0:
                    before[k] = i
                    if (new := known(r << 32 | token[k])) is None:
                        new = pair(r, token[k])
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = array("q", (i,))
                            push(heap, new)
                        if new < least:
                            least = new
                rank[i] = new
                k = before[i]
                if k >= 0:
                    if (new := known(token[k] << 32 | r)) is None:
                        new = pair(token[k], r)
                    rank[k] = new
                    if new >= 0:
                        if new in index:
                            index[new].append(k)
                        else:
                            index[new] = array("q", (k,))
                            push(heap, new)
                        if new < least:
                            least = new
                if least < r:
                    held = int(ends[bisect_right(ends, i)])
            if waiting:
                index.setdefault(r, array("q")).extend(waiting)
                push(heap, r)
        left = np.frombuffer(token, np.int64) >= 0
        return np.frombuffer(token, np.int64)[left], np.add.reduceat(left.astype(np.int64), ends - size)

    def _together(self, r: int, places: np.ndarray, columns: tuple, ends: np.ndarray, index: dict, heap: list) -> list[int]:
        """Merges the pairs of rank r at many places at once, but for those of words in which the order matters: these are returned."""
        token, rank, after, before = columns
        places = np.unique(places)
        at = places[rank[places] == r]
        gone = after[at]
        right, left = after[gone], before[at]
        beyond = np.where(right >= 0, right, at)
        # Neighbours that are merged themselves, and merges that make a pair of a lower rank.
        taken = np.isin(left, gone) | np.isin(gone, at) | ((right >= 0) & (rank[beyond] == r))
        of_right = self._ranks_of(np.full(len(at), r), token[beyond], right >= 0)
        of_left = self._ranks_of(token[np.where(left >= 0, left, at)], np.full(len(at), r), left >= 0)
        ordered = taken | ((of_right >= 0) & (of_right < r)) | ((of_left >= 0) & (of_left < r))
        rest = []
        if ordered.any():
            word = np.searchsorted(ends, at, "right")
            ordered = np.isin(word, word[ordered])
            rest = at[ordered].tolist()
            at, gone, right, left, of_right, of_left = (x[~ordered] for x in (at, gone, right, left, of_right, of_left))
        token[at], token[gone], rank[gone], after[at] = r, -1, -1, right
        before[right[right >= 0]] = at[right >= 0]
        rank[at] = of_right
        rank[left[left >= 0]] = of_left[left >= 0]
        made, where = np.concatenate([of_right, of_left]), np.concatenate([at, left])
        where, made = where[made >= 0], made[made >= 0]
        order = np.argsort(made, kind="stable")
        made, where = made[order], where[order]
        first = np.flatnonzero(np.diff(made, prepend=-1))
        for new, lo, hi in zip(made[first].tolist(), first.tolist(), np.append(first, len(made))[1:].tolist(), strict=True):
            if new not in index:
                index[new] = array("q")
                heapq.heappush(heap, new)
            index[new].frombytes(where[lo:hi].tobytes())
        return rest

    def _ranks_of(self, left: np.ndarray, right: np.ndarray, there: np.ndarray) -> np.ndarray:
        """pair() of each, -1 where there is none."""
        out = np.full(len(left), -1, np.int64)
        keys, which = np.unique(left[there] << 32 | right[there], return_inverse=True)
        out[there] = np.array([self.pair(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()], np.int64)[which]
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        place: dict[str, int] = {}
        at = [[place.setdefault(x, len(place)) for x in self.pattern.findall(unit)] for unit in units]
        words = [x.encode() for x in place]
        parts = [self.replay(words[lo:hi]) for lo, hi in slices(np.array([len(x) for x in words], np.int64), REPLAYED)]
        ids, length = (np.concatenate([x[c] for x in parts]) for c in (0, 1)) if parts else (np.empty(0, np.uint32), np.empty(0, np.int64))
        start = np.cumsum(length) - length
        flat = np.array([k for x in at for k in x], np.int64)
        counts = np.array([len(x) for x in at], np.int64)
        total = np.concatenate([[0], np.cumsum(length[flat])])
        ends = np.cumsum(counts)
        return ids[ragged(start[flat], length[flat])], total[ends] - total[ends - counts]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens."""
        return self.data[ragged(self.start[ids], self.size[ids])]


class ReplayEncoder(ChunkEncoder):
    """A ChunkEncoder whose ids come from the replay, and that knows the corpus' frequent chunks from the start."""

    def __init__(self, ranks: Ranks, frequent: tuple[list[str], np.ndarray, np.ndarray] | None = None):
        self.ranks, self.added = ranks, []
        feed = self.whole(["\n"])[0]
        # Only a pattern that cuts at a line feed, of which it makes one id, lets chunks stand alone.
        pairs = zip(self.whole(["a\nb", "a\n b", "a b"]), [["a", "\n", "b"], ["a", "\n", " b"], ["a", " b"]], strict=True)
        same = all(np.array_equal(x, np.concatenate(self.whole(y))) for x, y in pairs)
        self.feed = int(feed[0]) if len(feed) == 1 and same else None
        self.table, self.known = Entries(CACHE_CHUNKS), 4
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.columns(1 << 14)
        first, second, _ = chunk_hashes(pa.array([" ", "\n", self.BARE, ""], pa.large_string()))
        self.hash[:4], self.check[:4] = first, second
        self.table.put(first[1:], np.arange(1, 4))
        if self.feed is None:
            return
        self._put(np.array([self.END, self.FEED]), np.array([0, self.feed], np.uint32), np.array([1, 1]))
        self.length[self.DOUBT] = WHOLE
        if frequent and frequent[0]:
            chunks, ids, length = frequent
            h, check, _ = chunk_hashes(pa.array(chunks, pa.large_string()))
            entries = np.arange(self.known, self.known + len(chunks))
            self.columns(self.known + len(chunks), slice(self.known))
            self.hash[entries], self.check[entries], self.hits[entries] = h, check, 1000
            self.table.put(h, entries)
            self.known += len(chunks)
            self._put(entries, ids, length)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        ids, length = self.ranks.encode_units(texts)
        return np.split(ids, np.cumsum(length)[:-1])

    def _learn(self, new: pa.Array, names: list[str], entries: np.ndarray) -> None:
        units, at = [], []
        for i, x in zip(entries.tolist(), names, strict=True):
            bare = x.startswith(self.BARE)
            y = x[len(self.BARE) :] if bare else x
            if self.BARE in y or y[0].isspace() or y[-1].isspace():
                self.length[i] = WHOLE
            else:
                units.append(y if bare else " " + y)
                at.append(i)
        if at:
            self._put(np.array(at), *self.ranks.encode_units(units))


class RankFile:
    """A rank file's content and the pattern, sent to the executors once; the size doesn't depend on the data."""

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str | None = None):
        import public_tokenizers

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            self._value = spark.sparkContext.broadcast((f.read(), pattern or public_tokenizers.PATTERN))
        self.id = uuid.uuid4().hex

    def ranks(self) -> Ranks:
        """The worker's own."""
        remember("ranks")
        if self.id not in _RANKS:
            _RANKS.clear()
            _RANKS[self.id] = Ranks(*self._value.value)
        return _RANKS[self.id]

    def __getstate__(self):
        return {"_value": self._value, "id": self.id}


_RANKS: dict[str, Ranks] = {}
_ENCODERS: dict[str, ReplayEncoder] = {}
MEMORIES["ranks"] = lambda: (_RANKS.clear(), _ENCODERS.clear())


def chunk_counts(docs: DataFrame) -> DataFrame:
    """chunk, n: how often each chunk of at most LONGEST bytes occurs, over all texts, without those that begin or end with white space."""
    bare = ReplayEncoder.BARE

    def run(batches):
        held: list[pa.Table] = []

        def counts() -> pa.Table:
            return pa.concat_tables(held).group_by("chunk").aggregate([("n", "sum")]).rename_columns(["chunk", "n"])

        for batch in batches:
            for part in text_slices(batch):
                column = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                lead, nothing = pa.scalar(bare, column.type), pa.scalar("", column.type)
                chunks = pc.split_pattern(pc.binary_join_element_wise(lead, pc.replace_substring(column, "\n", f" \n {bare}"), nothing), " ").flatten()
                found = chunks.value_counts()
                held.append(pa.Table.from_arrays([found.field(0), found.field(1)], ["chunk", "n"]))
                if sum(map(len, held)) > COUNTED:
                    held = [counts()]
                    if len(held[0]) > COUNTED // 2:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from counts().to_batches()

    found = docs.select("text").mapInArrow(tidy(run), "chunk string, n long").filter(F.octet_length("chunk") <= LONGEST)
    plain = ~F.col("chunk").rlike(f"^{bare}?$|^{bare}?[\\s\x1c-\x1f]|[\\s\x1c-\x1f]$")
    return found.filter(plain).groupBy("chunk").agg(F.sum("n").alias("n"))


def frequent_chunks(docs: DataFrame, file: RankFile, most: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The chunks with the largest counts, at most `most`, and their ids: each is replayed once, by the tasks."""
    counted = cut(chunk_counts(docs).filter("n > 1").select("chunk", "n", F.floor(4 * F.log2("n")).cast("int").alias("size")))
    total, least = 0, 1 << 30
    for row in sorted(counted.groupBy("size").count().collect(), reverse=True):  # at most 252 classes of counts
        total += row["count"]
        if total > (FREQUENT if most is None else most):
            break
        least = row["size"]

    def run(batches):
        encoder = ReplayEncoder(file.ranks())
        for batch in batches:
            chunks = batch.column("chunk")
            names = chunks.to_pylist()
            kept = [k for k, x in enumerate(names) if encoder.BARE not in x[1:]]
            ids, length = encoder.ranks.encode_units([names[k][1:] if names[k].startswith(encoder.BARE) else " " + names[k] for k in kept])
            ends = np.cumsum(length)
            parts = [ids[a:b].tobytes() for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([chunks.take(pa.array(kept, pa.int64())), pa.array(parts, pa.binary())], ["chunk", "ids"])

    rows = counted.filter(F.col("size") >= least).select("chunk").mapInArrow(tidy(run), "chunk string, ids binary").collect()
    return [r["chunk"] for r in rows], np.frombuffer(b"".join(r["ids"] for r in rows), np.uint32), np.array([len(r["ids"]) // 4 for r in rows], np.int64)


def encode(docs: DataFrame, file: RankFile) -> DataFrame:
    """doc_id, ids (array of int); docs is read twice."""
    sent, key = docs.sparkSession.sparkContext.broadcast(frequent_chunks(docs, file)), uuid.uuid4().hex

    def run(batches):
        ranks = file.ranks()
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = ReplayEncoder(ranks, sent.value)
        for batch in batches:
            for part in text_slices(batch, most=ENCODED_BYTES):
                ids, length = _ENCODERS[key].encode(part.column("text"))
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, file: RankFile) -> DataFrame:
    """doc_id, ids and data: the bytes that the ids stand for."""

    def run(batches):
        ranks = file.ranks()
        for batch in batches:
            column = batch.column("ids")
            ids, ends = column.flatten().to_numpy(), np.cumsum(np.diff(column.offsets.to_numpy()))
            total = np.concatenate([[0], np.cumsum(ranks.size[ids])])
            offsets = total[np.concatenate([[0], ends])].astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(ranks.decode(ids))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, data], ["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids array<int>, data binary")


@scoped
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = RankFile(spark)
    found = decode(encode(table(spark, sf_dir, "documents"), file), file)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
