"""What replaces one task for each book, folder or machine: against forms that take them one by one."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from tabiya import session
from tabiya.functions import sql
from tabiya.operators import graph, integrity, running
from tabiya.plans import books as P
from tabiya.sources import books as S
from tests.test_books import CODES, NUMBERS, _after, _ctg, _record, _six_edges


def _fold(rows, most_files, most_bytes):
    out, by = [], {}
    for group, name, size in rows:
        by.setdefault(group, []).append((name.lower(), name, size))
    for group, files in by.items():
        batch = n = total = 0
        for _, name, size in sorted(files):
            if n and (n >= most_files or total + size > most_bytes):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + size
            out.append((group, name, size, batch))
    return sorted(out)


@pytest.mark.parametrize(("most_files", "most_bytes", "block"), [(8, 1000, 16), (3, 50, 4), (1, 10, 2)])
def test_batches_equal_the_fold(spark, most_files, most_bytes, block):
    r = random.Random(block)
    rows = [(r.choice(("a", "a", "a", "b", "c")), f"F{i:04}" if r.random() < 0.5 else f"f{i:04}", r.choice((0, 1, 30, 120, 400, 2000))) for i in range(150)] + [("d", "one", 5)]
    df = spark.createDataFrame(rows, "folder string, name string, size long").repartition(3)
    got = integrity.batches(df, ["folder"], "name", "size", most_files, most_bytes, block)
    assert sorted(map(tuple, got.select("folder", "name", "size", "batch").collect())) == _fold(rows, most_files, most_bytes)


def test_ordinals_number_each_group(spark):
    rows = [("a" if i % 3 else "b", (i * 7919) % 1000) for i in range(1000)]
    got = running.ordinals(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], ["v"]).collect()
    for g in "ab":
        assert [x.ordinal for x in sorted((x for x in got if x.g == g), key=lambda x: x.v)] == list(range(sum(x[0] == g for x in rows)))


def test_nearest_sample_equals_all_pairs(spark):
    r = random.Random(2)
    samples = [(r.choice("mn"), int(2 ** (r.random() * 12)), r.randrange(1, 99)) for _ in range(60)] + [("m", 0, 5)]
    wanted = [(m, s) for m in "mnx" for s in {int(2 ** (r.random() * 14)) for _ in range(60)}]
    got = integrity.nearest_sample(spark.createDataFrame(samples, "m string, s long, t long"), spark.createDataFrame(wanted, "m string, s long"), "m", "s", "t")
    want = {}
    for m, s in wanted:
        fits = [(abs(math.log(s / x)), x, t) for k, x, t in samples if k == m and x > 0 and 0.5 <= s / x <= 2]
        if fits:
            _, x, t = min(fits)
            want[m, s] = t * (s / x)
    assert {(x.m, x.s): x.estimate for x in got.collect()} == pytest.approx(want)


def test_expected_seconds_prefer_the_same_source(spark):
    samples = spark.createDataFrame([("m", 100, "f", 1, 10.0), ("m", 100, "f", 2, 20.0), ("m", 120, "g", 3, 6.0)], "m string, s long, f string, o int, t double")
    wanted = spark.createDataFrame([("m", 100, "f"), ("m", 110, "z"), ("m", 900, "z"), ("k", 100, "f")], "m string, s long, f string")
    got = {(x.m, x.s): x.seconds for x in integrity.expected_seconds(samples, wanted, "m", "s", "f", "o", "t").collect()}
    assert got == pytest.approx({("m", 100): (10 / 2 + 20) / 1.5, ("m", 110): 6 * 110 / 120, ("m", 900): None, ("k", 100): None})


def _random_book(seed, n=9):
    r, rows, boards = random.Random(seed), [], [[]]
    seen = set()
    for _ in range(n):
        sans = r.choice(boards)
        b = _after(*sans)
        for m in r.sample(b.legal(), 2):
            if (b.fen(), m) not in seen:
                seen.add((b.fen(), m))
                rows.append(_record(b, b.san(m), r.randrange(1, 50)))
                boards.append([*sans, b.san(m)])
    return b"".join(rows)


def test_spread_lines_cover_and_are_about_as_many(spark, tmp_path):
    there = ["Nf3", "Nf6", "Ng1", "Ng8"]
    cycle = b"".join([_record(_after(*there[:i]), san, 100) for i, san in enumerate(there)] + [_record(_after(), "e4", 50)])
    woven = b"".join(_record(_after(*x), s, w) for x, s, w in (((), "Nf3", 9), ((), "Nc3", 8), (("Nf3",), "Nf6", 7), (("Nc3",), "Nf6", 7), (("Nf3", "Nf6"), "Nc3", 1), (("Nc3", "Nf6"), "Nf3", 3), (("Nf3", "Nf6", "Nc3"), "d6", 2), (("Nf3", "Nf6", "Nc3"), "e6", 2)))
    for k, (data, depth) in enumerate(((_six_edges(), 10), (cycle, 6), (woven, 10), (_random_book(1), 10))):
        (tmp_path / f"{k}.bin").write_bytes(data)
        nodes, edges = P.polyglot_graph(spark, S.read_polyglot(spark, str(tmp_path / f"{k}.bin")), NUMBERS, depth)
        lines = P.spread_lines(nodes, edges, depth)
        got, greedy = [tuple(x.line) for x in lines.collect()], P.covering_lines(nodes, edges, depth).count()
        assert len(set(got)) == len(got) <= greedy + 1 and max(map(len, got)) <= depth
        assert P.missed_edges(edges, lines).count() == 0


def test_sampled_games_follow_the_weights(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(_six_edges())
    _, edges = P.polyglot_graph(spark, S.read_polyglot(spark, str(tmp_path / "b.bin")), NUMBERS, 10)
    edges = edges.cache()
    n = 4000
    games = P.sampled_games(edges, n, 10)
    first = {x.m: x.n for x in games.groupBy(F.col("line")[0].alias("m")).agg(F.count("*").alias("n")).collect()}
    second = {x.m: x.n for x in games.filter("line[0] = 'e4'").groupBy(F.col("line")[1].alias("m")).agg(F.count("*").alias("n")).collect()}
    chi = lambda seen, odds: sum((seen[k] - sum(seen.values()) * p) ** 2 / (sum(seen.values()) * p) for k, p in odds.items())
    assert chi(first, {"e4": 100 / 180, "d4": 80 / 180}) < 10.8 and chi(second, {"e5": 100 / 190, "c5": 90 / 190}) < 10.8
    rows = sorted((x.walker, tuple(x.line), x.result) for x in games.collect())
    assert rows == sorted((x.walker, tuple(x.line), x.result) for x in P.sampled_games(edges, n, 10).collect())
    assert [r[1][0] for r in rows[:2]] == ["e4", "d4"] and {r[2] for r in rows} == {"*"} and len(rows) == n
    odds = edges.filter("problem is null").select("dst_key").distinct().withColumns({"w": F.lit(1), "d": F.lit(1), "l": F.lit(2)})
    results = {x.result: x["count"] for x in P.sampled_games(edges, n, 10, odds).filter("size(line) = 3").groupBy("result").count().collect()}
    assert chi(results, {"1-0": 0.25, "1/2-1/2": 0.25, "0-1": 0.5}) < 13.8


def test_merging_fails_at_the_first_bad_record(spark, tmp_path):
    from tabiya.sources.pgn import read_games

    good = '[Event "x"]\n[Result "*"]\n\n1. e4 e5 *\n\n'
    (tmp_path / "a.pgn").write_text(good + good.replace("1. e4 e5", "1. d4 d5 2. c4"))
    (tmp_path / "b.pgn").write_text(good)
    books_ = [read_games(spark, str(tmp_path / f)) for f in ("a.pgn", "b.pgn")]
    assert sorted(tuple(x.line) for x in P.merge_written_books(books_).collect()) == [("d4", "d5", "c4"), ("e4", "e5")]
    for k, bad in enumerate((good.replace('[Result "*"]', '[Result "?"]'), good.replace("[Result", '[FEN "x"]\n[Result'), good.replace("e5", "e6x"), good.replace(" *\n", "\n"), good + "1. e4 { e5")):
        (tmp_path / f"bad{k}.pgn").write_text(good + bad)
        with pytest.raises(Exception, match=rf"bad{k}.pgn, record 1: "):
            P.merge_written_books([read_games(spark, str(tmp_path / f"bad{k}.pgn"))]).count()


def test_sql_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "1. e4 {x} e5 2. Ngf3 1-0"), (2, "1. e4 e4"), (3, None)], "id int, movetext string").createOrReplaceTempView("t_sql_games")
    got = spark.sql("SELECT id, ply, san, uci, white FROM t_sql_games, LATERAL mainline(movetext) ORDER BY id, ply").collect()
    assert [tuple(x) for x in got] == [(1, 0, "e4", "e2e4", True), (1, 1, "e5", "e7e5", False), (1, 2, "Nf3", "g1f3", True)]
    got = spark.sql("SELECT id, canonical_moves(main_moves(movetext)) AS san FROM t_sql_games ORDER BY id").collect()
    assert [x.san for x in got] == [["e4", "e5", "Nf3"], None, None]
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"
    assert spark.sql(f"SELECT count(*) AS n, min(uci) AS u FROM legal_moves('{start}')").first() == (20, "a2a3")
    assert spark.sql("SELECT count(*) FROM legal_moves('no position')").first()[0] == 0


def test_scopes_of_threads_are_their_own(spark):
    ready, done, found = threading.Event(), threading.Event(), []

    @session.scoped
    def slow():
        table = session.cut(spark.range(5))
        ready.set()
        done.wait(30)
        return table

    thread = threading.Thread(target=lambda: found.append(slow().count()))
    thread.start()
    ready.wait(30)
    session.scoped(lambda: session.release(spark.range(3)))()
    session.release(spark.range(1))
    done.set()
    thread.join()
    assert found == [5]


def test_release_keeps_what_it_cannot_tell(spark):
    @session.scoped
    def make():
        table = session.cut(spark.range(7))
        return table.cache()

    assert make().count() == 7


def test_ctg_books_spread(spark, tmp_path):
    nodes, edges = P.ctg_graph(spark, S.read_ctg(spark, _ctg(tmp_path, ["e2e4 e7e5 g1f3", "g1f3 e7e5 e2e4", "d2d4 d7d5"])), CODES)
    lines = P.spread_lines(nodes, edges, 20)
    assert P.missed_edges(edges, lines).count() == 0 and graph.ranked_out(edges.withColumnsRenamed({"san": "label"})).count() == edges.count()
