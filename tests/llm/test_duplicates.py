import hashlib
import random
import re

import hypothesis
import hypothesis.strategies as st
import pytest
import xxhash

from tabiya.llm import components, fingerprints, line_dedup, ngram_join
from tabiya.llm.common import cut

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three four"), (6, "One two three four"), (7, "a b c d e f g"), (7, "a b c d e f g"), (8, "x " * 4000)]


def _near_copies(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(55)]
    bases = [[word() for _ in range(r.choice((30, 80, 120)))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 2, 4, 8))):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.4:
            at = r.randrange(len(w))
            w[at:at] = passage
        rows.append((100 + i, " ".join(w)))
    return rows


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [len(s) for s in sets], [least[find(i)] for i in range(len(rows))]


def test_jaccard_components_match_brute_force(spark):
    rows = ODD + _near_copies(1)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sign string, label int").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    sizes, least = _components(rows)
    assert got == sorted((d, n, c) for (d, _), n, c in zip(rows, sizes, least, strict=True))
    assert ngram_join.jaccard_components(docs.filter("false")).count() == 0


def test_links_run_through_rows_with_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    middle, far = [*words[:54], *"abcdef"], [*"uvwx", *words[4:54], *"abcdef"]  # the first links with the second, the second with the third
    rows = [(9, " ".join(words)), (None, " ".join(middle)), (4, " ".join(far)), (None, "alone " + " ".join("pqrstu")), (None, None)]
    sizes, least = _components([(d if d is not None else 1000 + i, t) for i, (d, t) in enumerate(rows)])
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert least[:3] == [4, 4, 4] and got == {(9, 56): 4, (None, 56): 4, (4, 56): 4, (None, 3): None, (None, 0): None}


def test_one_document_of_each_group_stays(spark):
    rows = ODD + _near_copies(2)
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    sizes, least = _components(rows)
    want = sorted({c for n, c in zip(sizes, least, strict=True) if n} | {d for (d, _), n in zip(rows, sizes, strict=True) if not n})
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 9)] + [(20, 20 + i) for i in range(1, 9)] + [(40, 41), (41, 42), (42, 40), (50, 50)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 10)} == {1} and {got[i] for i in range(20, 29)} == {20} and {got[i] for i in (40, 41, 42)} == {40} and 50 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@hypothesis.settings(max_examples=1500, deadline=None)
@hypothesis.given(st.text(alphabet="ab", max_size=9), st.text(alphabet="ab", max_size=9), st.integers(0, 4))
def test_banded_distance(a, b, most):
    assert line_dedup.within(a.encode(), b.encode(), most) == (_distance(a, b) <= most)


def _dedup(rows, edits, least):
    seen, out = [], {}
    keys = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: r[0])
    for d, t in keys:
        kept = []
        for line in t.split("\n"):
            raw = line.encode()
            if not re.search(r"[^\s]", line):
                kept.append(line)
                continue
            near = any(raw == x or (len(raw) >= least and len(x) >= least and _distance(raw, x) <= edits) for x in seen)
            seen.append(raw)
            if not near:
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(4)
    lines = ["".join(r.choice("abc é") for _ in range(r.choice((3, 8, 26, 30, 31, 60)))) for _ in range(12)]

    def edited(x):
        x = list(x)
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            at = r.randrange(len(x))
            x[at : at + r.choice((0, 1))] = r.choice(("", "z", "q"))
            x = x or ["a"]
        return "".join(x)

    rows = [(i, "\n".join(edited(r.choice(lines)) for _ in range(r.randrange(1, 6)))) for i in range(30)] + [(90, None), (91, ""), (92, "\n \n"), (93, lines[3]), (94, "y" * 20000 + "\n" + lines[2])]
    docs = spark.createDataFrame([(d, t, 5, "keep") for d, t in rows], "doc_id long, text string, n_lines int, first string").repartition(3)
    got = line_dedup.dedup_lines(docs, 2, 24)
    assert got.columns == ["doc_id", "text", "first", "n_lines", "n_dropped"]
    want = _dedup(rows, 2, 24)
    for x in got.collect():
        source = dict(rows)[x.doc_id]
        assert x.text == (None if source is None else want[x.doc_id]) and x.first == "keep"
        assert x.n_lines == (0 if source is None else source.count("\n") + 1)
    assert line_dedup.dedup_lines(docs.filter("false")).count() == 0


def _alike_lines(r, n, kind):
    """Lines of one template: a number inside, numbers at two places, or short ends; among them near copies."""
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    make = {
        "inside": lambda: "https://example.org/some/long/path?id=" + digits(8) + "&lang=en&page=1",
        "two": lambda: digits(5) + " is a line with some words that all of them share " + digits(5),
        "end": lambda: "a line that only differs at its end: " + digits(3),
    }[kind]
    out = []
    for _ in range(n):
        x = list(r.choice(out)) if out and r.random() < 0.1 else list(make())
        for _ in range(r.choice((0, 0, 1, 2, 3)) if kind != "end" else 0):
            at = r.randrange(len(x))
            x[at : at + r.choice((0, 1))] = r.choice(("", "7", "q"))
        out.append("".join(x))
    return out


@pytest.mark.parametrize("kind", ["inside", "two", "end"])
def test_lines_that_begin_alike_match_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 6)
    monkeypatch.setattr(line_dedup, "OPEN", 4)
    lines = _alike_lines(random.Random(8), 180, kind)
    rows = [(i, "\n".join(lines[i : i + 6])) for i in range(0, len(lines), 6)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2, 24).collect()}
    assert got == _dedup(rows, 2, 24)


def test_lines_that_begin_alike_have_few_candidates(spark, monkeypatch):
    lines = _alike_lines(random.Random(9), 20_000, "inside")
    seen = []
    whole = line_dedup.open_pairs

    def counted(*a):
        found = cut(whole(*a).distinct())
        seen.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "open_pairs", counted)
    rows = [(i, "\n".join(lines[i : i + 50])) for i in range(0, len(lines), 50)]
    kept = sum(len(x.text.split("\n")) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.text)
    assert 5_000 < kept < 20_000 and sum(seen) < 50 * len(lines)


@pytest.mark.parametrize("hot", [None, 3])
def test_bound_in_words_grows_with_the_line(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "OPEN", 0)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.choice((2, 5, 7))))
    bases = [[word() for _ in range(n)] for n in (19, 20, 21, 39, 40, 41, 63, 130)]
    shared = [word() for _ in range(30)]

    def edited(x):
        x = list(x)
        for _ in range(r.choice((0, 1, 1, 2, 3, len(x) // 20, len(x) // 20 + 1))):
            at = r.randrange(len(x) + 1)
            x[at : at + r.choice((0, 1, 1))] = r.choice(([], [word()], [word()]))
        return " ".join(x if r.random() < 0.8 else x + shared)

    rows = [(i, "\n".join(edited(r.choice(bases)) for _ in range(6))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, want, by_words = [], {}, 0
    for d, text in rows:
        kept = []
        for line in text.split("\n"):
            words = line.split()
            bytes_ = any(_distance(line.encode(), x) <= 2 for x, _ in seen if abs(len(x) - len(line)) <= 2)
            near = bytes_ or any(_distance(words, x) <= min(len(words), len(x)) // 20 for _, x in seen)
            by_words += near and not bytes_
            seen.append((line.encode(), words))
            if not near:
                kept.append(line)
        want[d] = "\n".join(kept)
    assert by_words > 20
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(docs, 2, 24, 20).collect()} == want


def test_pipeline_drops_long_lines_with_a_replaced_word(spark):
    from corpus_pipeline import line_stage

    words = [f"word{i}" for i in range(30)]
    other = [*words[:12], "replacement", *words[13:]]
    docs = spark.createDataFrame([(1, " ".join(words), 1), (2, " ".join(other) + "\nown line", 1), (3, "short " + " ".join(words[:10]), 1), (4, "brief " + " ".join(words[:10]), 1)], "doc_id long, text string, n_chars int")
    assert {r.doc_id: r.text for r in line_stage(spark, docs, None).collect()} == {1: " ".join(words), 2: "own line", 3: "short " + " ".join(words[:10]), 4: "brief " + " ".join(words[:10])}


def test_repeated_rows_get_one_decision_and_empty_ones_go(spark):
    rows = [(1, "a line that is kept here"), (1, "a line that is kept here"), (2, "a line that is kept here"), (3, "a line that is kept here\nown"), (4, ""), (5, None)]
    got = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) as n_chars"))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.filter("text is not null").collect()) == [(1, rows[0][1], 24), (1, rows[0][1], 24), (3, "own", 3), (4, "", 0)]


def _simhash(text):
    words = re.sub("^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", text)
    words = re.split("[\x20\x09-\x0d]+", words) if words else []
    runs = [words[k : k + 5] for k in range(len(words) - 4)] if len(words) >= 5 else [words] if words else []
    votes = [0] * 64
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


def test_fingerprints_match_brute_force(spark):
    rows = [(d, t) for d, t in ODD if d != 7] + [(7, "a b c d e f g"), (5000, "é" * 11 + " x y z w"), (-3, "neg id text")] + _near_copies(3, 30)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, k int").repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = _simhash(t), _simhash(edited), _simhash(nxt)
        assert (r.fingerprint, r.edited_fingerprint) == (f"{a:016x}", f"{b:016x}")
        assert r.near_edited == 1 - (a ^ b).bit_count() / 64 and r.near_next == 1 - (a ^ c).bit_count() / 64
    assert fingerprints.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(twice).count() == 4


def test_block_tables_find_all_near_fingerprints(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(20)]
    values = set(base)
    for x in base:
        for _ in range(6):
            y = x
            for i in r.sample(range(64), r.randrange(0, 6)):
                y ^= 1 << i
            values.add(y)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    for radius, blocks in ((3, 6), (0, 1), (2, 5)):
        got = {(x.a, x.b) for x in fingerprints.near_fingerprints(spark.createDataFrame(signed, "fp long"), radius, blocks).collect()}
        flat = [v[0] for v in signed]
        want = {(a, b) for a in flat for b in flat if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        assert got == want


def test_near_counts_match_brute_force(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(120):
        y = r.choice(base)
        for b in r.sample(range(64), r.choice((0, 0, 1, 2, 3, 4, 5))):
            y ^= 1 << b
        rows.append((i, y - (1 << 64) if y >> 63 else y))
    rows += [(None, rows[0][1]), (300, rows[5][1]), (300, rows[5][1])]
    got = fingerprints.with_near(cut(spark.createDataFrame(rows, "doc_id long, fp long")), 3, 6, 3).collect()
    distinct = {f for _, f in rows}
    near = lambda f: sum(0 < ((f ^ g) & (1 << 64) - 1).bit_count() <= 3 for g in distinct)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(d, f, near(f) if d is not None and d % 3 == 0 else None) for d, f in rows]
    assert sorted(((x.doc_id, x.fp, x.n_near) for x in got), key=key) == sorted(want, key=key)
    assert any(x[2] for x in want)


@pytest.mark.parametrize("rows", [[], [(1, "one line that is longer than the least")], [(1, "no line of these is near"), (2, "to any of the other ones, is it?\nshort")]])
def test_tables_without_near_lines_end(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for per in (0, line_dedup.PER):
        assert sorted((x.doc_id, x.text, x.n_dropped) for x in line_dedup.dedup_lines(docs, 2, 24, per).collect()) == [(d, t, 0) for d, t in rows]


def test_whole_sets_are_not_shuffled_to_lose_repeats_or_to_get_their_sizes(spark):
    rows = _near_copies(5)
    docs = spark.createDataFrame([*rows, *rows[:7]], "doc_id long, text string")
    known = cut(ngram_join.shingle_classes(docs))
    wanted = known.select("doc_id", "text_key", "sign").dropDuplicates(["sign"])
    found = ngram_join.shingle_rows(docs, wanted)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["sign"] for r in found.collect()) == sorted(r["sign"] for r in wanted.collect())
    plan = ngram_join.leading_columns(found, 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan
