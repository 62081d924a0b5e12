import hashlib
import io
import random
import struct
import wave
import zlib

import numpy as np
import pytest

from tabiya.llm import languages, media, mixing, quality

ODD = [(901, None, None), (902, "", "a"), (903, "12 34 !!", "a"), (904, "z" * 50_000, "b")]


def _word(r, alphabet):
    return "".join(r.choice(alphabet) for _ in range(r.randrange(3, 8)))


def test_factorisation_machine_identity_and_learning():
    r = np.random.default_rng(1)
    m = quality.Machine(np.zeros((1, 1)), 0.3, r.normal(size=50), r.normal(size=(50, 4)))
    index, value = r.integers(0, 50, 12), r.random(12)
    z = 0.3 + m.linear[index] @ value + sum(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b] for a in range(12) for b in range(a))
    assert abs(m.scores(index, value, np.array([0]))[0] - 1 / (1 + np.exp(-z))) < 1e-9


def _quality_rows(n=300):
    r = random.Random(2)
    rows = []
    for i in range(n):
        good = r.random() < 0.7
        words = [_word(r, "abcdefgh") for _ in range(r.randrange(5, 60))]
        rows.append((i, " ".join(words) + "." if good else "!! ".join(words).upper(), int(good)))
    return rows


def test_quality_classifier_held_out(spark):
    rows = _quality_rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows] + ODD, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows if d % 4] + [(None, 1), (5, None), (99999, 1)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [(got[d] >= 0.7) == bool(q) for d, _, q in rows if d % 4 == 0]
    assert sum(held) / len(held) > 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows) + 4
    one = quality.train(docs, labels.filter("label = 1"))
    assert isinstance(one, float) and quality.score(docs, one).filter("score > 0.9").count() == len(rows) + 4
    assert quality.train(docs, labels.filter("false")) == 0.5 and quality.score(docs.filter("false"), 0.5).count() == 0
    meta = docs.withColumn("size", quality.F.length("text"))
    assert quality.score(meta, quality.train(meta, labels, ("size",)), ("size",)).count() == len(rows) + 4


def test_languages_held_out_and_mixtures(spark):
    r = random.Random(3)
    alphabets = {"aa": "abcde", "bb": "uvwxyz", "cc": "ñéçabu"}
    rows = [(i, " ".join(_word(r, alphabets[k]) for _ in range(30)), k) for i, k in enumerate(list(alphabets) * 40)]
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string, lang string")
    model = languages.learn(docs.filter("doc_id % 5 != 0"))
    mixed = (500, " ".join(_word(r, "abcde") for _ in range(60)) + " " + " ".join(_word(r, "uvwxyz") for _ in range(40)), None)
    got = {x.doc_id: x for x in languages.predict(spark.createDataFrame(rows + ODD + [mixed], "doc_id long, text string, lang string"), model).collect()}
    held = [got[d].lang_pred == k for d, _, k in rows if d % 5 == 0]
    assert sum(held) / len(held) > 0.98
    assert [got[d].lang_pred for d in (901, 902, 903)] == ["und"] * 3 and got[904].lang_pred in (*alphabets, "a", "b")
    assert [x.lang for x in got[500].languages][:2] == ["aa", "bb"] and abs(got[500].languages[0].share - 0.6) < 0.1 and abs(got[500].score - 0.6) < 0.1
    assert languages.learn(docs.filter("false")) is None
    assert {x.lang_pred for x in languages.predict(docs, None).collect()} == {"und"} and languages.predict(docs.filter("false"), model).count() == 0


def _plain_mixture(words, penalty):
    """One document's proportions by a plain EM; words: rows of log-likelihoods."""
    k = len(words[0])

    def fitted(shares):
        while True:
            for _ in range(2):
                before = shares
                sums = [0.0] * k
                for row in words:
                    top = max(row)
                    part = [np.exp(x - top) * s for x, s in zip(row, shares, strict=True)]
                    for j in range(k):
                        sums[j] += part[j] / max(sum(part), 1e-12)
                shares = [x / len(words) for x in sums]
            if max(abs(a - b) for a, b in zip(shares, before, strict=True)) <= languages.STILL:
                return shares, sum(np.log(sum(np.exp(x - max(row)) * s for x, s in zip(row, shares, strict=True))) for row in words)

    single = [sum(row[j] - max(row) for row in words) for j in range(k)]
    best = int(np.argmax(single))
    shares, value = [float(j == best) for j in range(k)], single[best]
    full, _ = fitted([1 / k] * k)
    rank = sorted(range(k), key=lambda j: -(full[j] + 2 * (j == best)))
    price = penalty + 0.5 * np.log(max(len(words), 2))
    for size in range(2, k + 1):
        found, more = fitted([1 / size if j in rank[:size] else 0.0 for j in range(k)])
        if more - value <= price:
            break
        shares, value = found, more
    return shares


def test_mixtures_match_a_plain_em():
    r = np.random.default_rng(4)
    docs = []
    for n in (1, 3, 40, 120, 60, 9):
        own = r.integers(0, 4, n) if n > 30 else np.full(n, 2)
        rows = r.normal(0, 1, (n, 4))
        rows[np.arange(n), own] += 3
        docs.append(np.concatenate([rows, rows[: n // 2]]))  # some words twice
    starts = np.cumsum([0] + [len(d) for d in docs])[:-1]
    got = languages.mixtures(np.concatenate(docs), starts, 3.0)
    for row, d in zip(got, docs, strict=True):
        assert row == pytest.approx(_plain_mixture(d.tolist(), 3.0), abs=2e-3)
    once = [np.unique(d, axis=0, return_counts=True) for d in docs]
    weighted = languages.mixtures(np.concatenate([x for x, _ in once]), np.cumsum([0] + [len(x) for x, _ in once])[:-1], 3.0, np.concatenate([n for _, n in once]))
    assert weighted == pytest.approx(got, abs=1e-9)


def test_three_hundred_languages_in_bounded_memory():
    import tracemalloc

    r = np.random.default_rng(5)
    logs = r.normal(-9, 1, (languages.GRAMS, 300)).astype(np.float32)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(8_000)]
    grams, starts = languages.word_grams(words)
    logs[grams, np.repeat(np.arange(8_000) % 299 + 1, 6)] += 2  # each word is likely in one language, none in the first
    model = languages.Model([f"l{i:03}" for i in range(300)], logs)
    docs = [[words[i] for i in r.integers(0, 8_000, 100_000)], words[268:8_000:299], words[298:8_000:299] * 3, []]
    tracemalloc.start()
    try:
        got = languages.proportions(languages.Scorer(model), docs, np.array([len(d) for d in docs]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 300 << 20
    assert got[1].argmax() == 269 and got[2].argmax() == 299 and got[3].sum() == 0 and abs(got[:3].sum(axis=1) - 1).max() < 1e-6


def _sizes(rows):
    return {r.doc_id: r for r in rows}


def test_mixing_meets_targets_and_bounds(spark):
    r = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 60))), s) for i, s in enumerate(["big"] * 1500 + ["mid"] * 500 + ["tiny"] * 30 + [None] * 200)] + [(9000, None, "mid"), (9001, "", "nothing"), (9002, "a b c", "mid"), (9002, "a b c", "mid")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, size int, n int").repartition(4)
    once, again = (sorted((x.doc_id, x.size, x.source_size, x.target, x.copies, x.taken) for x in mixing.mix_sources(docs).collect()) for _ in range(2))
    assert once == again and len(once) == len(rows)
    by = {}
    source = {d: s for d, _, s in rows}
    for d, size, total, target, copies, taken in once:
        assert 0 <= copies <= 3 and taken == size * copies
        x = by.setdefault(source[d], [0, total, target])
        x[0] += taken
    names = sorted((s for s in by if s is not None)) + [None]
    words, left = sum(x[1] for x in by.values()), set(names)
    want, weight = {}, {s: 1 + i % 3 for i, s in enumerate(names)}
    rest = words
    while True:  # targets by the rule itself
        level = rest / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 3 * by[s][1]}
        if not over:
            break
        for s in over:
            want[s] = 3 * by[s][1]
            rest -= want[s]
        left -= over
        if not left:
            break
    want |= {s: weight[s] * level for s in left}
    for s, (taken, total, target) in by.items():
        assert abs(target - want[s]) < 1e-6 * max(1, words) and abs(taken - target) <= max(60, 0.02 * target), s
    took = mixing.take_mix(docs)
    assert took.columns == docs.columns and took.count() == sum(x[4] for x in once)
    assert mixing.mix_sources(docs.filter("false")).count() == 0


PNG = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))
GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\0\x08\1\1\0\0\x3f\0\x12\xff\x00\x34\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
GZIP = zlib.compressobj(wbits=31)
GZIP = GZIP.compress(b"hello" * 50) + GZIP.flush()
MP4 = b"\0\0\0\x10ftypisom\0\0\0\0\0\0\0\x08moov\0\0\0\x0cmdatabcd"
TIFF = b"II*\0\x08\0\0\0\1\0\0\1\3\0\1\0\0\0\1\0\0\0\0\0\0\0"


def _zip():
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text" * 10)
    return out.getvalue()


def _ogg():
    page = b"OggS\0\2" + bytes(8) + b"\1\0\0\0" + bytes(4) + bytes(4) + b"\1\5hello"
    crc = 0
    for x in page:
        crc = (crc << 8 & 0xFFFFFFFF) ^ media._OGG[crc >> 24 ^ x]
    return page[:22] + struct.pack("<I", crc) + page[26:]


FILES = {"image/png": PNG, "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "application/pdf": PDF, "application/gzip": GZIP, "application/zip": _zip(), "audio/ogg": _ogg(), "audio/wav": media.wave(b"abcd"), "video/mp4": MP4, "image/tiff": TIFF}


@pytest.mark.parametrize("kind", FILES)
def test_sniffing_confirms_lengths_and_refuses_damage(kind):
    data = FILES[kind]
    assert media.sniff(data)[:2] == (kind, len(data))
    assert media.sniff(data + b"tail")[:2] == (kind, len(data))
    assert media.sniff(b"text " + data + b" more")[0] == media.UNKNOWN
    assert media.sniff(b"text " + data + b" more")[2] == [(kind, 5, len(data))]
    if kind not in ("image/jpeg", "image/gif", "video/mp4"):
        assert media.sniff(data[: len(data) - 1])[0] == media.UNKNOWN
    assert media.sniff(data[:8])[0] == media.UNKNOWN


def test_sniffed_column_corrects_declared_types(spark):
    rows = [(1, PNG, "image/png", 7), (2, GIF, "image/png", 7), (3, None, None, 7), (4, b"", "text/plain", 7), (5, b"ab" + PNG + b"cd" + GIF, "x", 7), (6, b"BM GIF89a RIFF %PDF-", "x", 7)]
    df = spark.createDataFrame([(a, bytearray(b) if b is not None else None, c, d) for a, b, c, d in rows], "id int, media binary, declared string, carved int")
    got = {r.id: r for r in media.sniff_column(df, "media", "declared").collect()}
    assert [got[i].media_type for i in range(1, 7)] == ["image/png", "image/gif", *[media.UNKNOWN] * 4]
    assert [got[i].corrected for i in range(1, 7)] == [False, True, True, True, True, True]
    assert [(c.type, c.offset, c.length) for c in got[5].carved] == [("image/png", 2, len(PNG)), ("image/gif", 4 + len(PNG), len(GIF))] and got[6].carved == []
    assert media.sniff_column(df.filter("false"), "media").count() == 0


def test_texts_as_samples_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 33), (5, "x" * 64), (6, "y" * 100_000)]
    got = {r.doc_id: r for r in media.media_digests(media.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.wave(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        with wave.open(io.BytesIO(stored)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(1 << 20)) == (1, 1, padded)
    assert got[3].feature == got[5].feature
    with pytest.raises(ValueError):
        media.samples(b"RIFF")
