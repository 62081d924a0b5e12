"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its words in HASHED buckets with root counts, scaled to unit length; statistics of its structure
(sizes, shares of letters, capitals, digits, marks and other bytes, repeated words and lines), each as one of BINS quantile bins; and any
metadata columns, binned likewise. The score is the logistic of
    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)
so pairs of features interact at the cost of one pass over the features.

Training takes at most `most` labelled rows, those with the smallest hashes of doc_id, and as many of them as have MOST_BYTES of
features; these are computed on the executors, and the driver fits the model with Adam. Scoring reads every row and whole texts.
Null texts count as ''. Null labels are left out; with labels of one kind only, every score is their share, smoothed by one of each.
Rows that repeat a doc_id are scored each; a label for a repeated doc_id counts for each row. Extra columns pass by, whatever their
names; score replaces a column of that name. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabiya.llm.common import WORDS, cut, own_names, quoted, remember, scoped, strings, table, text_slices, tidy, trim

HASHED, BINS, FACTORS = 1 << 13, 16, 8
MOST_LABELLED, MOST_BYTES = 8000, 64 << 20
_KINDS = np.full(256, 8, np.uint8)  # bytes of letters beyond ASCII
_KINDS[:128] = 7  # other marks and controls
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"?()-", b"!")):
    _KINDS[list(_chars)] = _i
STATISTICS = ("bytes", "words", "word_size", "capitals", "digits", "spaces", "marks", "calls", "others", "beyond", "word_kinds", "line_kinds", "words_a_line")


def statistics(raw: bytes, words: int, kinds: int) -> list[float]:
    counts = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=9).astype(float)
    n, lines = max(1, len(raw)), raw.split(b"\n")
    letters = max(1.0, counts[0] + counts[1])
    return [
        np.log1p(len(raw)), np.log1p(words), len(raw) / max(1, words), counts[1] / letters, counts[2] / n, counts[3] / n, counts[5] / n, counts[6] / n,
        counts[7] / n, counts[8] / n, kinds / max(1, words), len(set(lines)) / len(lines), np.log1p(words / len(lines)),
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values, and statistics."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    buckets, counts = np.unique(WORDS.of(words) % np.uint64(HASHED), return_counts=True)
    values = np.sqrt(counts)
    return buckets.astype(np.int64), values / max(1.0, float(np.sqrt(counts.sum()))), statistics(raw, len(words), len(buckets))


@dataclass
class Machine:
    edges: np.ndarray  # statistic by edge
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def indices(self, stats: np.ndarray) -> np.ndarray:
        """The feature of each statistic's bin."""
        bins = (stats[:, :, None] >= self.edges[None]).sum(axis=2)
        return HASHED + np.arange(stats.shape[1]) * BINS + bins

    def scores(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows whose features start at `starts`, each with at least one."""
        v = self.factors[index] * value[:, None]
        inner = np.add.reduceat(v, starts, axis=0)
        pairs = 0.5 * ((inner**2).sum(axis=1) - np.add.reduceat((v**2).sum(axis=1), starts))
        z = self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _join(words: list[tuple[np.ndarray, np.ndarray]], bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = bins.shape[1]
    sizes = np.array([len(i) + width for i, _ in words], np.int64)
    index = np.concatenate([x for (i, _), b in zip(words, bins, strict=True) for x in (b, i)])
    value = np.concatenate([x for _, v in words for x in (np.full(width, 1 / np.sqrt(width)), v)])
    return index, value, np.cumsum(sizes) - sizes


def fit(words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray, epochs: int = 8, steps: int = 300, rate: float = 0.03, decay: float = 1e-5, seed: int = 6) -> Machine:
    """Adam on the logistic loss, in batches of 256 rows; few rows are gone through more often, for `steps` batches."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(stats, quantiles, axis=0).T
    random = np.random.default_rng(seed)
    size = HASHED + stats.shape[1] * BINS
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    m = Machine(edges, float(np.log(share / (1 - share))), np.zeros(size), random.normal(0, 0.05, (size, FACTORS)))
    bins = m.indices(stats)
    weights = np.zeros((size, FACTORS + 1))
    weights[:, 1:] = m.factors
    first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
    for _ in range(max(epochs, -(-steps // -(-len(labels) // 256)))):
        order = random.permutation(len(labels))
        for k in range(0, len(order), 256):
            rows = order[k : k + 256]
            index, value, starts = _join([words[r] for r in rows], bins[rows])
            m.linear, m.factors = weights[:, 0], weights[:, 1:]
            error = (m.scores(index, value, starts) - labels[rows]) / len(rows)
            of = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(index))))
            v = m.factors[index]
            inner = np.add.reduceat(v * value[:, None], starts, axis=0)
            gradient = np.empty((len(index), FACTORS + 1))
            gradient[:, 0] = error[of] * value
            gradient[:, 1:] = (error[of] * value)[:, None] * (inner[of] - v * value[:, None])
            total = decay * weights
            np.add.at(total, index, gradient)
            step += 1
            first = 0.9 * first + 0.1 * total
            second = 0.999 * second + 0.001 * total**2
            weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            m.bias -= rate * float(error.sum())
    m.linear, m.factors = weights[:, 0].copy(), weights[:, 1:].astype(np.float32)
    return m


def _columns(docs: DataFrame, metadata: tuple[str, ...]) -> tuple[DataFrame, str]:
    """docs with the metadata as one column, and its name."""
    (own,) = own_names(docs, 1)
    extra = [F.coalesce(F.col(quoted(c)).cast("double"), F.lit(-1.0)) for c in metadata]
    return docs.withColumn(own, F.array(*extra) if extra else F.array().cast("array<double>")), own


def _rows(part: pa.RecordBatch, metadata: str) -> tuple[list, np.ndarray]:
    remember("words")
    found = [features(x) for x in strings(part.column("text"))]
    stats = [f[2] + m for f, m in zip(found, part.column(metadata).to_pylist(), strict=True)]
    return [f[:2] for f in found], np.array(stats, float).reshape(len(found), -1)


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), most: int = MOST_LABELLED) -> Machine | float:
    """labels: doc_id, label (0 or 1). A share if the labels are of one kind."""
    chosen = labels.filter("doc_id is not null and label is not null").select("doc_id", F.col("label").cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    with_metadata, own = _columns(docs, metadata)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                words, stats = _rows(part, own)
                columns = [pa.array([i.astype(np.int32).tobytes() for i, _ in words], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in words], pa.binary()), pa.array(stats.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label"), *columns], ["doc_id", "label", "i", "v", "stats"])

    rows = with_metadata.select("doc_id", "text", own).join(F.broadcast(chosen), "doc_id")
    found = cut(rows.mapInArrow(tidy(run), "doc_id long, label double, i binary, v binary, stats array<double>"))
    # Rows of repeated ids or long texts may be too many for the driver: it takes ids in the order of their hashes as long as they fit.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("i") + F.octet_length("v") + 200).alias("bytes"))
    sizes = sizes.select("doc_id", F.sum("n").over(order).alias("n"), F.sum("bytes").over(order).alias("bytes"))  # at most `most` ids
    found = found.join(F.broadcast(sizes.filter((F.col("n") <= most) & (F.col("bytes") <= MOST_BYTES)).select("doc_id")), "doc_id", "left_semi").toArrow()
    y = found.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    order = np.lexsort((y, found.column("doc_id").to_numpy()))  # the order of rows must not matter
    i, v = ([np.frombuffer(x.as_buffer(), kind) for x in found.column(c)] for c, kind in (("i", np.int32), ("v", np.float32)))
    words = [(i[r], v[r]) for r in order]
    stats = np.array(found.column("stats").to_pylist())[order]
    del found
    model = fit(words, stats, y[order])
    trim()
    return model


def score(docs: DataFrame, model: Machine | float, metadata: tuple[str, ...] = (), column: str = "score") -> DataFrame:
    """docs with the score in a column, which replaces one of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on HASHED and BINS only
    docs = docs.drop(column)
    names = docs.columns
    if isinstance(model, float):
        return docs.withColumn(column, F.lit(model))
    with_metadata, own = _columns(docs, metadata)

    def run(batches):
        m = sent.value
        for batch in batches:
            for part in text_slices(batch):
                words, stats = _rows(part, own)
                values = m.scores(*_join(words, m.indices(stats))) if len(words) else np.empty(0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(values, pa.float64())], [*names, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return with_metadata.mapInArrow(tidy(run), schema)


def fold(doc_id: str, parts: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


@scoped
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(fold("doc_id", 4) != 2)
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
