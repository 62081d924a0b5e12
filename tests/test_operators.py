import datetime

import duckdb
import pytest

from pyspark.sql import functions as F
from tabiya import catalog
from tabiya.functions import text as X
from tabiya.operators import dedup, graph, integrity, preference, reject, running
from tabiya.plans import integrity as scans
from tabiya.plans import reports
from tabiya.streaming import games as streams

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_match_their_sql(spark, con, name):
    found = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = catalog.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple(str(round(x, 9) if isinstance(x, float) else x) for x in row)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, found.fetchall()))


def test_tags_hold_whole_texts(spark, tmp_path):
    plain = "x" * 50 + ' "quoted" \\ and \\" to the end'
    rows = [(1, 0, "user", plain + "\n\n" + plain), (1, 1, "assistant", "\nsecond line"), (2, 0, "user", ""), (2, 1, "user", 'a "' * 20000 + "\r"), (3, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["unescape_text"](spark, str(tmp_path)).collect())
    want = [(c, t, i, role, x) for c, t, role, text in rows if text is not None for i, x in enumerate(text.split("\n"))]
    assert got == sorted([*want, (3, 0, 0, None, None)])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_selection_by_hand(spark):
    rows = [("p", "a", 30, 2, 0), ("p", "b", 29, 4, 0), ("p", "c", 29, 4, 0), ("p", "d", 31, 0, 0), ("p", "e", 2, 29, 2), ("p", "f", 0, 40, 3), ("q", "g", 0, 0, 32)]
    stats = preference.with_score(spark.createDataFrame(rows, "position string, move string, w long, d long, l long"))
    got = [(r.position, r.move, r.rn) for r in preference.preferred(stats, ["position"], "move").orderBy("position", "rn").collect()]
    assert got == [("p", "a", 1), ("p", "b", 2), ("q", "g", 1)]
    assert preference.model_counts(stats, ["position"], "move").first().asDict() == {"positions": 2, "candidates": 7, "qualified": 5, "anchor_positions": 2, "anchor_signals": 3}
    empty = preference.model_counts(stats.filter("false"), ["position"], "move").first()
    assert (empty.positions, empty.qualified, empty.anchor_signals) == (0, 0, 0)


@pytest.mark.parametrize(("seen", "bad", "warns"), [(99, 99, False), (100, 10, True), (100, 9, False)])
def test_error_threshold(spark, seen, bad, warns):
    df = spark.range(seen).selectExpr("0 as src", "id as seq", f"id >= {seen - bad} as bad")
    assert (running.error_alerts(df, ["src"], "seq", "bad").count() > 0) == warns
    assert (running.running_totals(df.selectExpr("*", "1 as one"), ["src"], "seq", {"n": "one"}, block=16).filter("n != seq + 1").count()) == 0


def test_keep_first_is_independent_of_partitions(spark):
    df = spark.range(1000).selectExpr("id % 7 as key", "999 - id as seq", "id as payload")
    want = sorted(map(tuple, dedup.keep_first(df.repartition(1), ["key"], ["seq"]).collect()))
    assert want == sorted(map(tuple, dedup.keep_first(df.repartition(9), ["key"], ["seq"]).collect())) and len(want) == 7


def test_rejection_names_the_first_rule(spark):
    df = spark.createDataFrame([(1, None), (None, 5), (1, 1)], "a int, b int")
    got = reject.classify(df, [("no-a", df.a.isNull()), ("b", df.b > 0)])
    assert [r.reject for r in got.collect()] == [None, "no-a", "b"] and reject.accepted(got).count() == 1


def test_graph_with_cycle_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    got = {r.node: (r.depth, r.parent) for r in graph.reachable(edges, roots).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "e": (3, "d")}
    tree = graph.paths(edges, roots, 9)
    lines = graph.covering_lines(edges, tree)
    assert graph.uncovered_edges(edges.filter("src != 'x'"), lines).count() == 0
    assert sorted(tuple(r.line) for r in lines.collect()) == [("a", "b", "d", "a"), ("a", "b", "d", "e"), ("a", "c", "d")]
    assert graph.reachable(edges, roots, 1).count() == 3


def test_layered_steps_meet_one_edge_each(spark, monkeypatch):
    """Walkers of a crowded node are ranked by several tasks; steps pass what the lines pass, and no step's plan joins walkers with all of a node's edges."""
    pairs = [("r", f"a{i}") for i in range(40)] + [(f"a{i}", "hub") for i in range(40)] + [("hub", f"b{i}") for i in range(25)] + [(f"b{i}", "hub") for i in range(25)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    tree = graph.paths(edges, spark.createDataFrame([("r",)], "node string"), 6).withColumn("path", F.slice("path", 2, 99))
    labelled = edges.select("src", "dst", F.col("dst").alias("label"), F.lit(1).alias("weight"))
    want = None
    for most in (1 << 16, 3):
        monkeypatch.setattr(graph, "RANKED", most)
        steps = graph.layered_steps(labelled, tree, 6)
        by_level = {r.level: r.n for r in steps.groupBy("level").agg(F.count("*").alias("n")).collect()}
        assert by_level == dict.fromkeys(range(6), 40) and steps.filter("born").count() == 40
        assert steps.filter("level = 2").select("label").distinct().count() == 25  # each of the hub's edges is taken
        lines = graph.layered_cover(labelled, tree, 6).select(F.concat(F.array(F.lit("r")), "line").alias("line"))
        roots = tree.filter("node = 'r'").select(F.array("node").alias("line"))
        assert graph.uncovered_edges(edges, lines).count() == graph.uncovered_edges(edges, roots, steps).count() == 0
        got = sorted(map(tuple, (r.line for r in lines.collect())))
        assert len(set(got)) == 40 and (want is None or len(got) == len(want))
        want = got
    assert graph.uncovered_edges(edges, roots, steps.filter("level <> 3")).count() == 24  # on level 5 all pass the edge of the heaviest again


def test_lines_held_as_paths_and_last_edges_pass_the_same(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("x", "y")], "src string, dst string")
    tree = graph.paths(edges, spark.createDataFrame([("a",)], "node string"), 9)
    reached = graph.reached_edges(edges, tree)
    assert {(r.src, r.dst): r.ends for r in reached.collect()} == {("a", "b"): False, ("a", "c"): False, ("b", "d"): False, ("c", "d"): True, ("d", "a"): True, ("d", "e"): True}
    begun = tree.join(reached.filter("ends").select(F.col("src").alias("node")).distinct(), "node", "left_semi").select(F.col("path").alias("line"))
    assert graph.uncovered_edges(reached, begun, reached.filter("ends")).count() == 0
    assert [tuple(r) for r in graph.uncovered_edges(reached, begun.filter("size(line) = 2"), reached.filter("ends")).collect()] != []


def test_text_functions(spark):
    df = spark.createDataFrame([('[White "A \\"B\\" \\\\"]', " +2600 ", 0b000000000000_0000_00000, 2)], "line string, elo string, date int, code int")
    r = df.select(X.tag_name(df.line).alias("n"), X.tag_value(df.line).alias("v"), X.rating(df.elo).alias("e"), X.packed_date(df.date).alias("d"), X.result_code(df.code).alias("r")).first()
    assert (r.n, r.v, r.e, r.d, r.r) == ("White", 'A "B" \\', 2600, "????.??.??", "1-0")
    codes = spark.createDataFrame([(0x031C,), (5 << 12,), (4 << 12 | 52 << 6 | 60,)], "c int")
    assert [x.u for x in codes.select(X.book_move(codes.c).alias("u")).collect()] == ["e2e4", None, "e7e8q"]


def test_batches_and_history(spark):
    files = spark.createDataFrame([("", f"f{i:02}", s) for i, s in enumerate([5, 5, 11, 1, 1, 1, 1, 1, 1, 1, 1, 1])], "folder string, name string, bytes long")
    got = [r.batch for r in integrity.batches(files, ["folder"], "name", "bytes", 8, 10).orderBy("name").collect()]
    assert got == [0, 0, 1, *[2] * 8, 3]
    samples = spark.createDataFrame([("m", 100, 10.0), ("m", 300, 33.0), ("m", 5000, 1.0)], "machine string, size long, seconds double")
    wanted = spark.createDataFrame([("m", 200), ("m", 20), ("z", 1)], "machine string, size long")
    assert [(r.size, round(r.estimate, 9)) for r in integrity.nearest_sample(samples, wanted, "machine", "size", "seconds").collect()] == [(200, 22.0)]


def test_scan_resumes_from_its_checkpoint(spark, tmp_path):
    files = spark.createDataFrame([(f"T{i}.rtbw", 100 + i) for i in range(20)], "name string, bytes long")
    home = str(tmp_path / "cp")

    def first(names):
        return [f"{n}: {'FAIL' if n == 'T3.rtbw' else 'OK'}!" for n in names if n != "T5.rtbw" and n != "T7.rtbw"]

    got = {r.name: r.status for r in scans.run_scan(spark, files, first, home).collect()}
    assert got["T3.rtbw"] == "FAIL" and got["T5.rtbw"] == "ERROR" and sum(s == "OK" for s in got.values()) == 17
    results = spark.createDataFrame([(n, s, 0, "") for n, s in got.items()], scans.RESULTS)
    assert sorted(r.name for r in scans.plan(files, results).collect()) == ["T5.rtbw", "T7.rtbw"]
    again = {r.name: r.status for r in scans.run_scan(spark, files, lambda names: [f"{n.lower()}: OK!" for n in names], home).collect()}
    assert again["T5.rtbw"] == "OK" and again["T3.rtbw"] == "FAIL" and len(again) == 20
    with pytest.raises(RuntimeError):
        scans.run_scan(spark, files, first, home, probe=lambda names: ["intentional: OK!"])
    text = spark.createDataFrame([("a: OK!",), ("  b c: FAIL! ",), ("noise",)], "line string")
    assert sorted((r.name, r.status) for r in integrity.engine_results(text).collect()) == [("a", "OK"), ("b c", "FAIL")]


def test_metrics_and_status(spark):
    counts = spark.createDataFrame([(3, 1)], "seen long, kept long")
    assert [(r.stage, r.name, r.value) for r in reports.metrics("raw", counts).collect()] == [("raw", "seen", 3.0), ("raw", "kept", 1.0)]
    assert reports.report_lines(reports.metrics("raw", counts)).count() == 2


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("s1" if i % 2 else "s2", f"k{i % 30}", t + datetime.timedelta(minutes=i), i % 4 == 1, 1 + i % 3) for i in range(240)]
    spark.createDataFrame(rows, "source string, key string, ts timestamp, bad boolean, outcome int").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("source string, key string, ts timestamp, bad boolean, outcome int").parquet(str(tmp_path / "in"))

    def collected(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(collected(streams.first_of_each(source(), ["key"], "ts"), "firsts", "append")) == 30
    assert sum(r.n for r in collected(streams.windowed_tally(source(), ["source"], "key", "outcome", "ts"), "tally", "complete")) == 240
    assert [(r.source, r.seen, r.bad_seen) for r in collected(streams.error_alerts(source(), "source", "bad"), "alerts", "append")] == [("s1", 120, 60)]
