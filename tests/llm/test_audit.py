import re
from itertools import permutations

from tabiya.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(250))


def _fails(rows):
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = WORDS.findall(t)
        f = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "")
        f += ("C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else "") + ("D" if re.search(r"[#$%&*|]", t) else "")
        f += "E" if d is not None and any(e is not None and e < d and (x or "") == t for e, x, _ in rows) else ""
        out.append(f)
    return out


def _brute(rows, labels):
    fails, good, toxic = _fails(rows), {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    found, shapley = {}, {}
    parts = {s or "" for _, _, s in rows}
    for order in permutations("ABCDE"):
        for part in parts:
            left = [(d, f) for (d, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
            everyone = left
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                failing = [r for r in everyone if x in r[1]]
                alone = sum(r[1] == x for r in everyone)
                found[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, None, "a"), (4, "", None), (5, " \n\t", ""), (6, LONG + " #", "a"), (7, "x " * 300, "a"), (7, "x " * 300, "a"), (8, "X " * 300, "b"),
    (None, LONG, "a"), (None, None, "b"), (9, LONG[:-1] + "X", "b"), (10, "é" * 40 + LONG + " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2, "a"), (11, "ab " * 200_000, "c"), (12, "ab " * 200_000, "c"), (13, "ab " * 199_999 + "abc", "c"),
    (14, LONG, None), (15, "y" * 70 + "1", "c"), (16, "y" * 70 + "2", "c"), (17, "y" * 70 + "1", "a"), (-4, "y" * 70 + "2", "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (6, 1, 0), (7, 0, 1), (12, 1, 1), (14, 0, 0), (14, 1, 0), (99, 1, 1), (None, 1, 1)]


def _run(spark, rows):
    docs = spark.createDataFrame([(d, t, s, 1, "m", "t") for d, t, s in rows], "doc_id long, text string, source string, class int, mask string, part string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    counts = filter_audit.mask_counts(filter_audit.filter_masks(docs), labels)
    return filter_audit.audit(counts)


def _found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_matches_brute_force(spark):
    got = _run(spark, ROWS)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys("kept removed redundant unique_fails good_lost toxic_lost shapley".split(), "bigint")
    assert got.count() == 600 * 4 and _found(got) == _brute(ROWS, LABELS)


def test_hashes_decide_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit, "block_hashes", lambda text: F.array(F.octet_length(text).cast("long") * 0))
    assert _found(_run(spark, ROWS)) == _brute(ROWS, LABELS)


def test_empty_table_has_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    masks = filter_audit.filter_masks(docs)
    assert filter_audit.audit(filter_audit.mask_counts(masks, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))).count() == 0
