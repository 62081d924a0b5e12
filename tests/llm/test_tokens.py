import tracemalloc

import hypothesis
import hypothesis.strategies as st
import numpy as np
import pyarrow.parquet as pq
import pytest

from tabiya.llm import binary, packing, token_counts, tokens
from tabiya.llm.tokens import ChunkEncoder, Vocabulary, crc32

import public_tokenizers

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as _f:
    ENCODER = ChunkEncoder(_f.read())
TEXTS = ["", " ", "  a", "a ", "a\n\nb", "a\n\n b", "\n", "don't 's . x., <|endoftext|> y", "été, naïve.\n\nfoo", "x" * 5000, "a\tb c\x1cd  e", "1. 22, 3.", "\0a b\n\0c", "😀 émoji, ok"]
ROWS = [(1, "one two three", "a"), (2, None, "b"), (3, "", None), (4, "same text here", "a"), (5, "same text here", "a"), (5, "same text here", "a"), (None, "no id", "c"), (6, "word " * 3000, "b")]
SCHEMA = "doc_id long, text string, n_tokens string"


@hypothesis.settings(max_examples=300, deadline=None)
@hypothesis.given(st.lists(st.text(alphabet="ab1 \n\t.,'é \r<|s!", max_size=14), max_size=4))
def test_chunks_give_the_librarys_ids(texts):
    _same(texts)


def test_chunks_on_odd_texts():
    _same(TEXTS)


def _same(texts):
    ids, lengths = ENCODER.encode(texts)
    parts = np.split(ids, np.cumsum(lengths)[:-1]) if len(texts) else []
    for text, part in zip(texts, parts, strict=True):
        assert part.tolist() == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids, text


def _ids(text):
    return [*ENCODER.whole([text or ""])[0].tolist(), 0]


@pytest.mark.parametrize("high", [1, 2, 60000, 1 << 20, 1 << 59, (1 << 64) - 1])
def test_simple8b_round_trip(high):
    random = np.random.default_rng(3)
    for n in (0, 1, 2, 239, 240, 241, 4000):
        ids = random.integers(0, high, n, dtype=np.uint64, endpoint=True)
        ids[random.random(n) < 0.3] = 0
        words, places, values = binary.pack_words(ids)
        out = binary.unpack_words(words, n)
        out[places.astype(np.int64)] = values
        assert np.array_equal(out, ids)


def test_segments_blocks_and_damage():
    ids = np.arange(200_000, dtype=np.uint64) % 50_000
    data = binary.encode_segment(np.array([7, 9]), np.array([150_000, 50_000]), ids) + b"\n"
    ((docs, lengths, out),) = binary.segments(data)
    assert docs.tolist() == [7, 9] and lengths.tolist() == [150_000, 50_000] and np.array_equal(out, ids)
    words, _, _ = binary.pack_words(ids)
    starts = np.concatenate([[0], np.cumsum(binary.COUNTS[(words >> np.uint64(60)).astype(np.int64)])])[:-1][:: binary.BLOCK]
    assert np.array_equal(binary.decode_block(words, starts, 2, len(ids)), ids[starts[2] : starts[3]])
    for bad in (data[:-9], data[:60] + b"x" + data[61:], b"nope" + data[4:]):
        with pytest.raises(ValueError):
            list(binary.segments(bad))


def test_token_files_match_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = str(tmp_path / "ids")
    binary.write_token_files(docs, path, Vocabulary(spark))
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.start, r.n_tokens, r.ids_crc32) for r in binary.read_token_files(spark, path).collect())
    want, at = [], 0
    for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = _ids(t)
        want.append((d if d is not None else -1, at, len(ids), crc32(np.array(ids))))
        at += len(ids)
    assert got == sorted(want)
    binary.write_token_files(docs.filter("false"), path + "2", Vocabulary(spark))
    assert binary.read_token_files(spark, path + "2").count() == 0


def test_packing_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = packing.pack_documents(docs, Vocabulary(spark), 64).collect()
    found = {}
    for r in rows:
        found.setdefault((r.doc_id, r.start), []).append((r.length, r.ids_crc32))
    for d, t, _ in ROWS:
        ids, first = _ids(t), (len(_ids(t)) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            assert (hi - lo, crc32(np.array(ids[lo:hi]))) in found[d, lo]
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack_documents(docs.filter("false"), Vocabulary(spark)).count() == 0


def test_packing_starts_workers_of_one_kind(spark):
    """A list of rows becomes a table through workers that serve nothing else; they would stay beside those of the encoder."""
    pieces = spark.range(5).selectExpr("id doc_id", "0 piece", "0L start", "id + 1 length", "id ids_crc32")
    packed = packing.pack(pieces)
    assert "ExistingRDD" not in packed._jdf.queryExecution().executedPlan().toString() and packed.count() == 5
    assert packing.pack(pieces.limit(0)).count() == 0


@hypothesis.settings(max_examples=60, deadline=None)
@hypothesis.given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=12))
def test_configurations_hold_each_piece_once(histogram):
    plan, chosen = packing.configurations(histogram, 40)
    total = {}
    for copies, times in plan:
        assert times > 0 and sum(k * n for k, n in copies.items()) <= 40
        for k, n in copies.items():
            total[k] = total.get(k, 0) + n * times
    assert total == histogram and 0 <= chosen <= len(plan)


def test_pricing_is_an_exact_knapsack():
    random = np.random.default_rng(5)
    for _ in range(20):
        lengths, values, supply = random.choice(np.arange(1, 20), 5, replace=False), random.random(5), random.integers(1, 4, 5)
        copies = packing.price(values, lengths, supply, 30, full=1.0)
        best = np.zeros(31)
        for v, k, n in zip(values, lengths, supply, strict=True):
            for _ in range(n):
                for c in range(30, k - 1, -1):
                    best[c] = max(best[c], best[c - k] + v)
        assert all(n <= supply[i] for i, n in copies.items()) and sum(lengths[i] * n for i, n in copies.items()) <= 30
        assert abs(sum(values[i] * n for i, n in copies.items()) - best[30]) < 1e-9


def test_program_covers_and_may_leave_room():
    lengths, supply = np.array([1024, 1500, 700]), np.array([1000, 300, 3])
    found = packing.program(lengths, supply, 2048)
    covered = {k: sum(x * n for c, x in found.items() for j, n in c if j == k) for k in lengths.tolist()}
    assert sum(min(covered[k], n) * k for k, n in zip(lengths.tolist(), supply.tolist(), strict=True)) >= (1 - packing.TOLERANCE) * int((lengths * supply).sum())


@pytest.mark.parametrize(("sf", "sequences"), [("0.01", 481), ("0.1", 4936)])
def test_program_chooses_most_sequences_and_these_are_fewest(sf, sequences):
    lengths = ENCODER.encode(pq.read_table(f"/root/testdata/sf{sf}/documents.parquet", columns=["text"]).column("text").combine_chunks(), 0)[1]
    first, more = (lengths - 1) % 2048 + 1, int(((lengths - 1) // 2048).sum())
    histogram = dict(zip(*(x.tolist() for x in np.unique(np.append(first, [2048] * more), return_counts=True)), strict=True))
    plan, chosen = packing.configurations(histogram, 2048)
    assert sum(t for _, t in plan) == sequences == -(-packing.tokens_of(histogram) // 2048)
    other = sum(k * n for k, n in histogram.items() if k < 2048)
    assert sum(k * n * t for copies, t in plan[:chosen] for k, n in copies.items()) >= 0.9 * other


def test_token_counts_answer_every_limit(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_counts(docs, Vocabulary(spark)))).cache()
    lengths = sorted(len(_ids(t)) - 1 for _, t, _ in ROWS)
    assert sum(r.n_docs for r in sums.collect()) == len(ROWS)
    for limit in (0, 1, 2, 3, 5, 100, 10_000):
        assert token_counts.truncated_total(sums, limit) == sum(min(limit, x) for x in lengths)
    assert token_counts.quantile(sums, 0.5) == lengths[len(lengths) // 2 - 1] and token_counts.quantile(sums, 1.0) == lengths[-1]
    for r in sums.collect():
        assert r.docs_ge == sum(x >= r.length for x in lengths) and r.tokens_ge == sum(x for x in lengths if x >= r.length) and r.docs_le == sum(x <= r.length for x in lengths)
    empty = token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_counts(docs.filter("false"), Vocabulary(spark))))
    assert empty.count() == 0 and token_counts.truncated_total(empty, 9) == 0


def test_a_full_memory_of_chunks_is_halved_in_little_memory():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = tokens.ChunkEncoder(f.read())
    n = tokens.CACHE_CHUNKS
    enc.columns(n)
    enc.known, enc.used, enc.flat = n, 8 * n, np.zeros(8 * n, np.uint32)
    enc.hash[:n] = np.random.default_rng(1).integers(1, 1 << 63, n, np.uint64)
    enc.start[:n], enc.length[:n] = np.arange(n) * 8, 8
    tracemalloc.start()
    enc._shrink()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert enc.known == tokens.KEPT and peak < 75e6
