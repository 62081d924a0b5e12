import base64
import hashlib
import random

import hypothesis
import hypothesis.strategies as st
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tabiya.llm import merge_replay

with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as _f:
    CONTENT = _f.read()
RANKS = merge_replay.Ranks(CONTENT, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}, special_tokens={})
ODD = ["", " ", "\n\n", "  a", "a  ", "a \n b", "don't 'S 's'll", "été naïve 12345 x1y2", "<|endoftext|> ok", "\x1c\x1fa\x85b\xa0\xa0c  d　", "x" * 5000, "ab" * 3000 + "!?" * 40, "\0 \x7f", "😀👩‍👩‍👧 ok", "日本語 テスト", "٣٤ ४५ Ⅷ ½"]


ENCODER = merge_replay.ReplayEncoder(RANKS)


def _same(texts):
    ids, length = ENCODER.encode(texts)
    for text, part in zip(texts, np.split(ids, np.cumsum(length)[:-1]), strict=True):
        assert part.tolist() == LIBRARY.encode_ordinary(text), text
        assert RANKS.decode(part.astype(np.int64)).tobytes() == text.encode()


def test_odd_texts_have_the_librarys_ids():
    _same(ODD)


@hypothesis.settings(max_examples=200, deadline=None)
@hypothesis.given(st.lists(st.text(max_size=20) | st.text(alphabet="abeThn's \n\t.,'é1\r\xa0 \x1c", max_size=30), min_size=1, max_size=4))
def test_texts_have_the_librarys_ids(texts):
    _same(texts)


@pytest.mark.parametrize("many", [1, 6, 10**9])
def test_ranks_below_the_one_applied_go_first(monkeypatch, many):
    """A file in which a merge makes pairs of lower ranks than its own; a word's remaining places must wait."""
    monkeypatch.setattr(merge_replay, "MANY", many)
    r = random.Random(3)
    singles = [bytes([b]) for b in range(256)]
    for _ in range(30):
        longer = sorted({"".join(r.choice("abc") for _ in range(r.choice((2, 2, 3, 3, 4, 5)))).encode() for _ in range(25)})
        r.shuffle(longer)
        content = b"\n".join(base64.b64encode(x) + b" %d" % i for i, x in enumerate([*singles, *longer]))
        ranks = merge_replay.Ranks(content, r"\S+|\s+")
        library = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=dict(ranks.ids), special_tokens={})
        words = [("".join(r.choice("abcd") for _ in range(r.randrange(1, 30)))) for _ in range(60)]
        ids, length = ranks.replay([x.encode() for x in words])
        for word, part in zip(words, np.split(ids, np.cumsum(length)[:-1]), strict=True):
            assert part.tolist() == library.encode_ordinary(word), word


def test_query_columns_match_the_library(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(merge_replay, "FREQUENT", 40)
    r = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "same text"), (51, "same text"), (None, "no id"), (52, "word " * 100_000)]
    rows += [(100 + i, " ".join(r.choice(("the", "and", "zyx", "Qualität", "1999", "\n", "don't")) + r.choice(("", ".", "s")) for _ in range(200))) for i in range(20)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ids string, data int").repartition(3).write.parquet(path)
    got = merge_replay.op12_byte_bpe(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    want = []
    for d, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((-1 if d is None else d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got.collect()) == sorted(want)
    file = merge_replay.RankFile(spark)
    docs = spark.read.parquet(path)
    chunks, ids, length = merge_replay.frequent_chunks(docs, file)
    assert 0 < len(chunks) <= 40 and len(ids) == length.sum() and "the" in chunks
    seeded = merge_replay.ReplayEncoder(RANKS, (chunks, ids, length))
    assert [x.tolist() for x in (seeded.encode(ODD)[0], ENCODER.encode(ODD)[0])] == [[i for t in ODD for i in LIBRARY.encode_ordinary(t)]] * 2
    assert merge_replay.decode(merge_replay.encode(docs.filter("false"), file), file).count() == 0
