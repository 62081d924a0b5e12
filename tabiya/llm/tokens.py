"""Encoding whole texts with a vocabulary file of the tokenizers library.

A text is cut before each space that certainly starts a pre-token. Of each slice of texts the distinct chunks are found
first; a worker remembers the ids of those it meets most, by 128 bits of hash, so the library encodes each frequent chunk once.
The ids are those that the library's encode() gives for the whole text; texts whose white space leaves a doubt, and texts that
hold an added token (which the library finds anywhere in a text), go to it whole. Tests compare both.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tabiya.llm.common import MEMORIES, mix, remember, text_slices, tidy, trim

#: Chunks that a worker remembers, of about 60 bytes each, and how many of them stay, most used first, when they (or their ids) are too many.
CACHE_CHUNKS, CACHE_IDS, KEPT = 520_000, 5_200_000, 300_000
#: Bytes of the longest chunk that is remembered.
LONGEST = 64
#: Bytes of text that are encoded at a time, apart from one longer text.
ENCODED_BYTES = 1 << 19
#: No white space inside, by which the library and Python might differ.
_PLAIN = re.compile(r"\S+").fullmatch
#: ASCII marks other than the apostrophe, which starts pre-tokens of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word of Latin letters, which is one pre-token, and marks, which are another.
_LATIN = "^\\x00?[A-Za-zÀ-ÖØ-öø-ɏ]+[" + "".join("\\" + x for x in _MARKS) + "]*$"
WHOLE, CALL = -1, 4000


def _byte_letters() -> str:
    """The letters that stand for the bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return "".join(chr(b if b in own else 256 + b - sum(x < b for x in own)) for b in range(256))


def _listed(column: pa.Array) -> list[str]:
    """The values of a column of strings without spaces or nulls; much faster than one by one."""
    if not len(column):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(column)], pa.int64()), column)
    return pc.binary_join(whole, pa.scalar(" ", column.type))[0].as_py().split(" ")


_SEEDS = np.random.default_rng(1).integers(1, 1 << 63, (2, 256 + LONGEST), dtype=np.uint64) | np.uint64(1)


def chunk_hashes(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes (not 0) of each large string of at most LONGEST bytes, and which are that short."""
    offsets = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    sizes = np.diff(offsets)
    short = (sizes <= LONGEST) & (sizes > 0)
    out = np.zeros((2, len(sizes)), np.uint64)
    if short.any():
        n = sizes[short]
        starts = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(starts, n)
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[place + np.repeat(offsets[:-1][short], n)]
        for seeds, h in zip(_SEEDS, out, strict=True):
            h[short] = mix(np.add.reduceat(seeds[data] * seeds[place + 256], starts) + n.astype(np.uint64))
    return np.maximum(out[0], np.uint64(1)), out[1], sizes <= LONGEST


class Entries:
    """Entry numbers by two hashes: open addressing on the first, whose entry then must have the second."""

    def __init__(self, room: int):
        self.bits = max(10, (2 * room - 1).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out, rows, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), self._slot(h)
        while len(rows):
            key = self.keys[slot]
            hit = key == h[rows]
            out[rows[hit]] = self.at[slot[hit]]
            on = ~hit & (key != 0)
            rows, slot = rows[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def put(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Adds hashes that are not there; of equal ones, one stays."""
        rows, slot = np.arange(len(h)), self._slot(h)
        while len(rows):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[rows[free]]
            won = self.keys[slot] == h[rows]
            self.at[slot[won]] = entries[rows[won]]
            rows, slot = rows[~won], (slot[~won] + 1) & (len(self.keys) - 1)


class ChunkEncoder:
    """Ids of texts by way of remembered chunks, for a byte-level vocabulary without a normalizer.

    A chunk is what stands between two spaces, and is encoded with the space before it. A line feed is a chunk
    of its own; what follows it is encoded without a space and remembered with BARE before it. A chunk that is empty, or begins or
    ends with other white space, leaves a doubt where pre-tokens begin: its text goes to the library whole.
    """

    BARE = "\0"
    #: Entries that are always there.
    END, FEED, EMPTY, DOUBT = range(4)

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        form = json.loads(vocabulary)
        self.added = [x["content"] for x in form.get("added_tokens") or [] if x["content"]]
        level = (form.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not form["pre_tokenizer"].get("add_prefix_space")
        plain = level and form["model"]["type"] == "BPE" and form.get("normalizer") is None
        feed = self.whole(["\n"])[0]
        # Only a vocabulary that cuts at a line feed and gives it one id can do so; an added token with a space would span chunks.
        same = len(feed) == 1 and all(np.array_equal(x, y) for x, y in zip(self.whole(["a\nb", "a\n b"]), [np.concatenate([*self.whole(["a", "\n"]), z]) for z in self.whole(["b", " b"])], strict=True))
        self.feed = int(feed[0]) if plain and same and not any(c in x for x in self.added for c in " \n\0") else None
        self.letters = _byte_letters()
        self.model = self.tokenizer.model  # the same: a second one takes 40 MB
        self.marks: dict[str, list[int]] = {}
        # By entry: hashes, first id in flat, number of ids (or WHOLE), slices with the chunk. The END of a text, which is no chunk, has its id set by encode().
        self.table, self.known = Entries(CACHE_CHUNKS), 4
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.columns(1 << 14)
        first, second, _ = chunk_hashes(pa.array([" ", "\n", self.BARE, ""], pa.large_string()))
        self.hash[:4], self.check[:4] = first, second
        self.table.put(first[1:], np.arange(1, 4))
        if self.feed is not None:
            self._put(np.array([self.END, self.FEED]), np.array([0, self.feed], np.uint32), np.array([1, 1]))
            self.length[self.DOUBT] = WHOLE

    def columns(self, size: int, of: np.ndarray | slice = slice(0)) -> None:
        """Room for `size` entries, of which those `of` the present ones come first."""
        for name, kind in (("hash", np.uint64), ("check", np.uint64), ("start", np.int32), ("length", np.int32), ("hits", np.uint16)):
            column = np.zeros(size, kind)
            if hasattr(self, name):
                old = getattr(self, name)[of]
                column[: len(old)] = old
            setattr(self, name, column)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _put(self, entries: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        used = self.used + len(ids)
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(len(self.flat) // 2 + len(ids), np.uint32)])
        self.flat[self.used : used] = ids
        self.start[entries], self.length[entries] = np.cumsum(lengths) - lengths + self.used, lengths
        self.used = used

    def _words(self, words: pa.Array, entries: np.ndarray) -> None:
        """Words of one pre-token, besides marks, which are another: to the library's model at once."""
        bare = pc.starts_with(words, self.BARE).to_numpy(zero_copy_only=False)
        texts = _listed(words)
        stems = _listed(pc.utf8_rtrim(words, characters=_MARKS))
        space, lead = self.letters[32], len(self.BARE)
        pieces = [x[lead:] if b else space + x for x, b in zip(stems, bare.tolist(), strict=True)]
        wide = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)).tolist()
        if wide:  # the other letters of ASCII stand for themselves
            raw = "\n".join([stems[i][lead:] if bare[i] else " " + stems[i] for i in wide])
            for i, x in zip(wide, raw.encode().decode("latin-1").translate(self.letters).split(self.letters[10]), strict=True):
                pieces[i] = x
        lengths, parts = np.empty(len(pieces), np.int64), []
        for k in range(0, len(pieces), CALL):  # the library's tokens are large
            found = list(map(self.model.tokenize, pieces[k : k + CALL]))
            lengths[k : k + CALL] = list(map(len, found))
            parts.append(np.fromiter(map(attrgetter("id"), itertools.chain.from_iterable(found)), np.uint32, int(lengths[k : k + CALL].sum())))
        ids = np.concatenate(parts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) - np.fromiter(map(len, stems), np.int64, len(stems))
        marked = sizes > 0
        if marked.any():
            ends = np.cumsum(lengths)
            more, at = [], []
            for i, size, end in zip(np.flatnonzero(marked).tolist(), sizes[marked].tolist(), ends[marked].tolist(), strict=True):
                mark = texts[i][-size:]
                if mark not in self.marks:
                    if len(self.marks) > 10_000:
                        self.marks.clear()
                    self.marks[mark] = self.whole([mark])[0].tolist()
                own = self.marks[mark]
                more += own
                at += [end] * len(own)
                lengths[i] += len(own)
            ids = np.insert(ids, at, np.array(more, np.uint32))
        self._put(entries, ids, lengths)

    def _learn(self, new: pa.Array, names: list[str], entries: np.ndarray) -> None:
        """Encodes the new chunks, many in a call: a line feed between two of them is a pre-token of its own."""
        latin = pc.match_substring_regex(new, _LATIN).to_numpy(zero_copy_only=False)
        for content in self.added:
            latin &= ~pc.match_substring(new, content).to_numpy(zero_copy_only=False)
        if latin.any():
            self._words(new.filter(pa.array(latin)), entries[latin])
        groups: dict[str, list[tuple[int, str]]] = {" ": [], "": []}
        for k in np.flatnonzero(~latin).tolist():
            i, x = int(entries[k]), names[k]
            bare = x.startswith(self.BARE)
            y = x[len(self.BARE) :] if bare else x
            if self.BARE in y or any(content in y for content in self.added):
                self.length[i] = WHOLE
            elif _PLAIN(y):
                groups["" if bare else " "].append((i, y))
            elif y[0].isspace() or y[-1].isspace():
                self.length[i] = WHOLE
            else:
                ids = self.whole([y if bare else " " + y])[0]
                self._put(np.array([i]), ids, np.array([len(ids)]))
        for lead, items in groups.items():
            for k in range(0, len(items), CALL):
                part = items[k : k + CALL]
                ids = self.whole(["\n".join([lead + y for _, y in part])])[0]
                feeds = ids == self.feed
                ends = np.append(np.flatnonzero(feeds), len(ids))
                self._put(np.array([i for i, _ in part]), ids[~feeds], np.diff(ends, prepend=-1) - 1)

    def _shrink(self) -> None:
        """Keeps the chunks that occurred in most slices; how often counts less with time."""
        rank = self.hits[: self.known].astype(np.int64)
        rank[self.length[: self.known] > CACHE_IDS // KEPT] = -1  # long ones would fill the room for ids
        rank[: self.DOUBT + 1] = 1 << 20
        keep = np.sort(np.argpartition(-rank, KEPT)[:KEPT]) if self.known > KEPT else np.flatnonzero(rank >= 0)
        keep = keep[rank[keep] >= 0]
        sizes, start = np.maximum(self.length[keep], 0), self.start[keep]
        ends = np.cumsum(sizes, dtype=np.int32)  # as many as CACHE_IDS and a slice's at most
        place = np.repeat(start - ends + sizes, sizes)
        place += np.arange(ends[-1], dtype=np.int32)
        self.flat = self.flat[place]
        self.used = len(self.flat)
        self.columns(CACHE_CHUNKS, keep)
        self.start[: len(keep)] = ends - sizes
        self.hits //= 2
        self.known = len(keep)
        self.table = None  # before another takes its place
        self.table = Entries(CACHE_CHUNKS)
        self.table.put(self.hash[1 : self.known], np.arange(1, self.known))
        trim()

    def _entries(self, chunks: pa.Array) -> np.ndarray:
        """The entries of distinct chunks, of which new ones are learnt."""
        h, check, short = chunk_hashes(chunks)
        entry = self.table.find(h)
        entry[~short | ((entry >= 0) & (self.check[entry] != check))] = -1
        new = np.flatnonzero(entry < 0)
        if self.known > KEPT + self.DOUBT and self.known + len(new) > CACHE_CHUNKS or self.used > CACHE_IDS:
            self._shrink()
            return self._entries(chunks)
        if len(new):
            if (known := self.known + len(new)) > len(self.start):
                self.columns(max(known, min(2 * len(self.start), CACHE_CHUNKS)), slice(self.known))
            entry[new] = np.arange(self.known, known)
            self.hash[self.known : known], self.check[self.known : known] = h[new], check[new]
            keep = new[short[new]]
            keep = keep[self.table.find(h[keep]) < 0]  # a chunk whose first hash another has isn't remembered
            if known <= CACHE_CHUNKS:
                self.table.put(h[keep], entry[keep])
            self.known = known
            fresh = chunks.take(pa.array(new))
            self._learn(fresh, _listed(fresh), entry[new])
        self.hits[entry] = np.minimum(self.hits[entry], 60_000) + np.uint16(1)
        return entry

    def encode(self, texts: list[str] | pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has; with `end`, each text's ids end with it. Nulls count as ''."""
        column = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        if self.feed is None or not len(column):
            return self._joined([self._ended(x, end) for x in self.whole(column.to_pylist())])
        lead, nothing = pa.scalar(self.BARE, column.type), pa.scalar("", column.type)
        cut = pc.split_pattern(pc.binary_join_element_wise(lead, pc.replace_substring(column, "\n", f" \n {self.BARE}"), nothing), " ")
        distinct = cut.flatten().dictionary_encode()
        entry = self._entries(distinct.dictionary)
        at = entry[distinct.indices.to_numpy()]
        bounds = cut.offsets.to_numpy()
        bounds = bounds - bounds[0]
        # Two line feeds are two pre-tokens only if neither another nor white space nor the end follows.
        feed, empty = at == self.FEED, at == self.EMPTY
        odd = np.flatnonzero(feed[:-3] & empty[1:-2] & feed[2:-1] & empty[3:])
        odd = np.searchsorted(bounds, np.concatenate([odd, np.flatnonzero(self.length[at] < 0)]), "right") - 1
        odd = np.concatenate([odd, np.flatnonzero(pc.match_substring(column, self.BARE).to_numpy(zero_copy_only=False))])
        if end is not None:
            self.flat[self.start[self.END]] = end
            at = np.insert(at, bounds[1:], self.END)
            bounds = bounds + np.arange(len(bounds))
        counts = np.maximum(self.length[at], 0)
        ends = np.cumsum(counts, dtype=np.int64)
        kind = np.int32 if ends[-1] < 1 << 30 else np.int64
        place = np.repeat((self.start[at] - ends + counts).astype(kind), counts)
        place += np.arange(ends[-1], dtype=kind)
        ids = self.flat[place]
        lengths = np.diff(np.concatenate([[0], ends])[bounds])
        if len(odd):
            odd = np.unique(odd)
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for k, x in zip(odd.tolist(), self.whole(column.take(pa.array(odd)).to_pylist()), strict=True):
                parts[k] = self._ended(x, end)
            return self._joined(parts)
        return ids, lengths

    @staticmethod
    def _ended(ids: np.ndarray, end: int | None) -> np.ndarray:
        return ids if end is None else np.append(ids, np.uint32(end))

    @staticmethod
    def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), np.array([len(x) for x in parts], np.int64)


_ENCODERS: dict[int, ChunkEncoder] = {}
MEMORIES["tokens"] = _ENCODERS.clear


def encoder(vocabulary) -> ChunkEncoder:
    """The worker's encoder for a broadcast vocabulary file; it lives as long as the worker."""
    remember("tokens")
    if vocabulary.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.id] = ChunkEncoder(vocabulary.value)
    return _ENCODERS[vocabulary.id]


class Vocabulary:
    """A vocabulary file's content, sent to the executors once; its size doesn't depend on the data."""

    def __init__(self, spark, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as f:
            self._value = spark.sparkContext.broadcast(f.read())
        self.id = self._value.id if hasattr(self._value, "id") else id(self._value)

    @property
    def value(self) -> str:
        return self._value.value

    def __getstate__(self):
        return {"_value": self._value, "id": self.id}


def encoded(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch], end: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their texts' ids and lengths; with `end`, each text's ids end with it."""
    enc = encoder(vocabulary)
    for batch in batches:
        for part in text_slices(batch, most=ENCODED_BYTES):
            yield part, *enc.encode(part.column("text"), end)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def token_counts(docs: DataFrame, vocabulary: Vocabulary, end: int | None = None) -> DataFrame:
    """n_tokens of each document; null texts have those of ''. Other columns are left out but doc_id."""

    def run(batches):
        for part, _, lengths in encoded(vocabulary, batches, end):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long")
