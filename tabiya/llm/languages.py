"""Language id by multilingual mixture inference.

Each language has letter n-gram likelihoods (trigrams of lower-case words, with word ends), learned from labelled texts. A
document is a mixture of languages: expectation maximisation over its words, whose likelihoods come from their n-grams, estimates
the proportions. The set of languages is chosen by penalised likelihood: the most likely single language first, then with the next of the
full mixture's languages as long as that raises the log-likelihood by more than PENALTY + half the log of the number of words.
The prediction is the chosen language with the largest proportion; its score is that proportion.

Learning takes at most about `most` texts of each language, by hash of doc_id, whole; their n-grams are counted on the executors, so the driver gets at
most GRAMS counts a language. A word that a document repeats is one row with a weight, and documents are taken together as long as their rows by
languages are at most CELLS, so memory is bounded by the rows of one document, however many languages there are. Letters are what Unicode calls so (category L). Null texts, and texts without a letter, are `und` with score 0; so is every text if nothing was learned. Rows that repeat a doc_id are
predicted each. An empty table gives no rows. Extra columns pass by.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import MEMORIES, bounded_broadcast, cut, mix, remember, scoped, slices, strings, table, text_slices, tidy

GRAMS = 1 << 17
MOST_TEXTS = 1500
PENALTY = 3.0
#: Numbers (words by languages) that a worker works on at a time, apart from one longer document, and that it remembers.
CELLS, REMEMBERED = 2_000_000, 8_000_000
#: A document's proportions are fitted until a round changes none by more than this.
STILL = 1e-3
_WORDS = re.compile(r"[^\W\d_]+").findall


def letters(text: str) -> list[str]:
    """Lower-case runs of letters."""
    words = _WORDS(text.lower())
    if "".join(words).isalpha() or not words:
        return words
    return [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]  # number signs aren't letters


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all words' code points, with a mark at both ends, and where each word's begin."""
    data = np.frombuffer(("\0" + "\0\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)  # a word of n letters has n trigrams
    starts = np.cumsum(sizes + 2) - sizes - 2
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    grams = mix(data[at] * np.uint64(0x1F1F1F1F1F1F1F) ^ (data[at + 1] << np.uint64(21)) ^ (data[at + 2] << np.uint64(42))) % np.uint64(GRAMS)
    return grams.astype(np.int64), np.cumsum(sizes) - sizes


@dataclass
class Model:
    names: list[str]
    logs: np.ndarray  # GRAMS by language


class Scorer(dict):
    """Rows of relative word log-likelihoods by language; words get numbers as they come."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.most = model, min(300_000, REMEMBERED // len(model.names))
        self.new: list[str] = []
        self.rows = np.zeros((1 << 10, len(model.names)), np.float32)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def numbers(self, words: list[list[str]], n: int) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.rows = self.rows[: 1 << 10].copy()
        at = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(words)), np.int64, n)
        if self.new:
            grams, starts = word_grams(self.new)
            first = len(self) - len(self.new)
            if len(self) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(self) - len(self.rows), len(self.rows) // 2), self.rows.shape[1]), np.float32)])
            ends = np.append(starts[1:], len(grams))
            lo = 0
            while lo < len(starts):  # as many words at a time as their n-grams by languages allow
                hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CELLS // len(self.model.names), "right")))
                self.rows[first + lo : first + hi] = np.add.reduceat(self.model.logs[grams[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], axis=0)
                lo = hi
            self.new = []
        return at


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def mixtures(logs: np.ndarray, starts: np.ndarray, penalty: float = PENALTY, weights: np.ndarray | None = None) -> np.ndarray:
    """Proportions by document and language (0: not chosen), from log-likelihoods by word and how often it occurs (once); each document has words."""
    counts = np.diff(np.append(starts, len(logs)))
    of = np.repeat(np.arange(len(starts)), counts)
    weights = np.ones(len(logs)) if weights is None else weights.astype(np.float64)
    sizes = np.add.reduceat(weights, starts)
    top = logs.max(axis=1)
    like = np.exp(logs - top[:, None])
    floor = 1e-12

    def fitted(like, of, counts, weights, sizes, shares):
        shares, open_ = shares.copy(), np.arange(len(counts))
        starts = np.cumsum(counts) - counts
        some, some_of, some_starts, some_weights = like, of, starts, weights
        while len(open_):  # documents whose proportions stand still drop out
            before = shares[open_]
            for _ in range(2):
                after = before
                part = some * after[some_of]
                part *= (some_weights / np.maximum(part.sum(axis=1), floor))[:, None]
                before = _sums(part, some_starts) / sizes[open_][:, None]
            shares[open_] = before
            moving = np.abs(before - after).max(axis=1) > STILL
            if not moving.all():
                rows = moving[some_of]
                some, some_weights, open_ = some[rows], some_weights[rows], open_[moving]
                some_of = np.repeat(np.arange(len(open_)), counts[open_])
                some_starts = np.cumsum(counts[open_]) - counts[open_]
        return shares, _sums(weights * np.log(np.maximum(np.einsum("ij,ij->i", like, shares[of]), 1e-300)), starts)

    k = logs.shape[1]
    single = _sums((logs - top[:, None]) * weights[:, None], starts)
    best = single.argmax(axis=1)
    chosen = np.zeros((len(starts), k))
    chosen[np.arange(len(starts)), best] = 1
    value = single.max(axis=1)
    if k == 1:
        return chosen
    full, most = fitted(like, of, counts, weights, sizes, np.full((len(starts), k), 1 / k))
    # The best single language first, then by proportion.
    rank = np.argsort(-(full + 2 * chosen), axis=1, kind="stable")
    price = penalty + 0.5 * np.log(np.maximum(sizes, 2))
    open_ = np.flatnonzero(most - value > price)
    for size in range(2, k + 1):
        if not len(open_):
            break
        keep = np.isin(of, open_)
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, rank[open_, :size], 1.0, axis=1)
        part_of = np.repeat(np.arange(len(open_)), counts[open_])
        shares, found = fitted(like[keep], part_of, counts[open_], weights[keep], sizes[open_], allowed / size)
        better = found - value[open_] > price[open_]
        chosen[open_[better]] = shares[better]
        value[open_[better]] = found[better]
        open_ = open_[better]
    return chosen


def learn(docs: DataFrame, most: int = MOST_TEXTS) -> Model | None:
    """A model of the languages of docs (doc_id, text, lang); null texts and languages are left out. docs is read twice."""
    known = docs.filter("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.count("*"))
    shares = known.groupBy("lang").agg(share.alias("share"))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(bounded_broadcast(cut(shares, 1)), "lang").filter(hashed < F.col("share")).select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in text_slices(batch):
                langs = part.column("lang").to_pylist()
                words = [letters(x) for x in strings(part.column("text"))]
                for lang in set(langs):
                    own = [w for x, name in zip(words, langs, strict=True) if name == lang for w in x]
                    if own:
                        grams, counts = np.unique(word_grams(own)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    counts = chosen.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    if not names:
        return None
    n = np.full((GRAMS, len(names)), 0.2)
    place = {x: i for i, x in enumerate(names)}
    np.add.at(n, (counts.column("gram").to_numpy(), np.array([place[x] for x in counts.column("lang").to_pylist()])), counts.column("n").to_numpy())
    return Model(names, np.log(n / n.sum(axis=0)).astype(np.float32))


def proportions(scorer: Scorer, words: list[list[str]], sizes: np.ndarray) -> np.ndarray:
    """mixtures() of each document's words (zeros without words), of so many documents at a time that their rows by languages are at most CELLS."""
    k, n = len(scorer.model.names), int(sizes.sum())
    out = np.zeros((len(words), k))
    at = scorer.numbers(words, n)
    # A document's distinct words, with how often it has them.
    pairs, times = np.unique(np.repeat(np.arange(len(words)), sizes) * (len(scorer) + 1) + at, return_counts=True)
    of, word = np.divmod(pairs, len(scorer) + 1)
    some = np.flatnonzero(sizes)
    rows = np.bincount(of, minlength=len(words))[some]
    ends = np.cumsum(rows)
    for lo, hi in slices(rows * k, CELLS):
        first, last = int(ends[lo] - rows[lo]), int(ends[hi - 1])
        out[some[lo:hi]] = mixtures(scorer.rows[word[first:last]], (ends - rows)[lo:hi] - first, weights=times[first:last])
    return out


_SCORERS: dict[int, Scorer] = {}
MEMORIES["languages"] = _SCORERS.clear


def worker_scorer(model: Model | None) -> Scorer | None:
    """The worker's scorer of a model; it lives as long as the worker."""
    remember("languages")
    if model is not None and id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = Scorer(model)
    return None if model is None else _SCORERS[id(model)]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, languages (the chosen set with proportions, largest first) of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS numbers for each language
    schema = "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        model = sent.value
        scorer = worker_scorer(model)
        for batch in batches:
            for part in text_slices(batch):
                words = [letters(x) for x in strings(part.column("text"))]
                sizes = np.array([len(w) for w in words], np.int64)
                names, scores, sets = ["und"] * len(words), np.zeros(len(words)), [[] for _ in words]
                some = np.flatnonzero(sizes)
                if scorer is not None and len(some):
                    chosen = proportions(scorer, words, sizes)[some]
                    best = chosen.argmax(axis=1)
                    scores[some] = np.clip(chosen[np.arange(len(some)), best], 0, 1)
                    for row, doc, b in zip(chosen, some.tolist(), best.tolist(), strict=True):
                        names[doc] = model.names[b]
                        sets[doc] = [{"lang": model.names[i], "share": float(row[i])} for i in np.argsort(-row, kind="stable").tolist() if row[i] > 0]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(names), pa.array(scores), pa.array(sets, kind)], ["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


@scoped
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = predict(docs, learn(docs.select("doc_id", "text", "lang").filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")
