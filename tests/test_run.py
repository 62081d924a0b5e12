import pytest
from pyspark.sql import functions as F

from tabiya.operators import preference
from tabiya.plans import books as B
from tabiya.plans import run as R
from tabiya.plans.games import Config
from tabiya.sources import books as S
from tests.test_books import CODES, NUMBERS, _ctg, _six_edges


def _game(moves, result="1-0"):
    return f'[Event "t"]\n[Result "{result}"]\n\n{moves} {result}\n\n'


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "OVERLAY-PGN").mkdir(parents=True)
    (root / "a.pgn").write_text(_game("1. e4 e5 2. Nf3 Nc6") * 3 + _game("1. d4 d5 2. c4 e6"))
    (root / "OVERLAY-PGN" / "o.pgn").write_text(_game("1. e4 e5", "*") + _game("1. e4 e5 2. Nf3 Nc6", "*"))
    (root / "b.bin").write_bytes(_six_edges())
    _ctg(root, ["e2e4 e7e5 g1f3", "d2d4 d7d5"], "c")
    (root / "c.cto").write_bytes(bytes(20))
    (root / "c.ctb").write_bytes(bytes(12))
    return root


OPTIONS = R.Options(anchors=True, games=Config(least_plies=2, least_matched=1, evidence=preference.Evidence(1, 1)), numbers=NUMBERS, codes=CODES, book_depth=10)


def test_run_over_all_kinds(spark, folder, tmp_path):
    got = R.run(spark, str(folder), str(tmp_path / "out"), OPTIONS)
    assert got.status == "ok" and got.problems == []
    values = {(r.stage, r.name): r.value for r in got.metrics.collect()}
    assert values["raw", "sum(seen)"] == 4 and values["raw", "sum(accepted)"] == 2 and values["books", "lines"] == 5
    assert values["metal", "games"] == 2 and values["overlay", "contributed"] == 1 and values["overlay", "covered"] == 1
    count = lambda p: spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out" / p)).filter("value like '[Result%'").count()
    assert [count(p) for p in ("RAW/GAMES", "RAW/MERGED-BOOKS", "RAW/ALL", "METAL/GAMES", "METAL/CTG-c", "METAL/FINAL")] == [2, 5, 7, 2, 2, 4 + values["overlay", "contributed"]]
    assert [values["final", x] for x in ("games", "book_lines", "overlay_lines")] == [2, 2, values["overlay", "contributed"]]
    report = spark.read.json(str(tmp_path / "out/REPORTS/COVERAGE-CTG-c")).first()
    assert (report.positions, report.edges, report.missing, report.lines) == (6, 5, 0, 2)
    assert "notice: " in spark.read.text(str(tmp_path / "out/REPORTS/RUN")).filter("value like 'notice%no anchors'").first()[0]
    assert {r.depth: r.legal for r in spark.read.json(str(tmp_path / "out/REPORTS/DEPTHS-BIN-b")).collect()} == {0: 2, 1: 3, 2: 1}
    assert {(r.kind, r.name) for r in spark.read.json(str(tmp_path / "out/REPORTS/INVENTORY")).collect()} == {("PGN", "a"), ("OVERLAY-PGN", "o"), ("BIN", "b"), ("CTG", "c")}
    assert {r.name: r.value for r in spark.read.json(str(tmp_path / "out/REPORTS/SETTINGS")).collect()}["book_depth"] == "10"
    statistics = spark.read.json(str(tmp_path / "out/REPORTS/STATISTICS-CTG-c"))
    assert statistics.count() == 6 and {"key", "depth", "wins", "footer"} <= set(statistics.columns)
    assert spark.read.text(str(tmp_path / "out-CHECKSUMS")).count() > 5


def test_run_reports_failures(spark, folder, tmp_path):
    (folder / "b.bin").write_bytes(b"123456")
    (folder / "d.cbh").write_bytes(b"x")
    got = R.run(spark, str(folder), str(tmp_path / "out"), OPTIONS)
    assert got.status == "bin-failed" and any(p.startswith("skipped") for p in got.problems)


def test_book_anchors(spark, tmp_path):
    entries = S.read_ctg(spark, _ctg(tmp_path, ["e2e4 e7e5", "d2d4 d7d5"]))
    nodes, edges = B.ctg_graph(spark, entries, CODES)
    assert R.book_anchors(nodes, edges, entries).count() == 0
    some = entries.withColumns({"wins": F.lit(2).cast("long"), "losses": F.lit(20).cast("long"), "total": F.lit(22).cast("long")})
    assert {r.policy for r in R.book_anchors(nodes, edges, some).collect()} == {"small"}
    assert B.ctg_graph(spark, entries, CODES, pawnless=False)[1].count() == edges.count()  # there are pawns everywhere
    assert {r.reason: r.n for r in R.anchor_diagnostics(nodes, edges, entries).collect()} == {"below-games": 4}
    assert {r.depth: (r.positions, r.legal) for r in R.depth_histogram(edges).collect()} == {0: (1, 2), 1: (2, 2)}
