from pyspark.sql import functions as F

from tabiya import sinks
from tabiya.operators import preference
from tabiya.plans import games as G
from tabiya.sources.pgn import read_games


def _read(spark, tmp_path, *texts):
    out = None
    for i, t in enumerate(texts):
        p = tmp_path / f"g{len(list(tmp_path.iterdir()))}.pgn"
        p.write_text(t, encoding="utf-8")
        df = read_games(spark, str(p)).withColumn("src_rank", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def _game(moves, result="1-0", **tags):
    head = "".join(f'[{k} "{v}"]\n' for k, v in {"Event": "t", "Result": result, **tags}.items())
    return f"{head}\n{moves} {result}\n\n"


LONG = "1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Ba4 Nf6 5. O-O Be7 6. Re1 b5 7. Bb3 d6 8. c3 O-O 9. h3 Nb8 10. d4 Nbd7 11. Nbd2 Bb7 12. Bc2 Re8"


def test_raw_self_test(spark, tmp_path):
    text = _game("1. e4 {c} e5 2. Nf3 (2. f4) Nc6 3. Bb5 a6 4. Ba4 Nf6 5. O-O Be7 6. Re1 b5 7. Bb3 d6 8. c3 O-O 9. h3", White="A", Black="B", WhiteElo=2600, BlackElo=2600)
    raw = G.raw_games(_read(spark, tmp_path, text), G.Config(most_plies=12, least_plies=4)).collect()
    assert len(raw) == 1 and raw[0].status == "kept" and len(raw[0].toks) == 12 and (raw[0].vars, raw[0].comments) == (1, 1)


def test_rejection_order_and_duplicates(spark, tmp_path):
    one = _game("1. e4 e5") + _game("1. e4 e5 2. d4", FEN="8/8/8/8/8/8/8/8 w - -") + _game("1. e4") + _game("1. e4 e5", "*") + _game("1. e4 e5") + _game("1. d4 d5", WhiteElo=2000, BlackElo=2600)
    two = _game("1. e4 e5") + _game("1. c4 c5", WhiteElo=2500, BlackElo=2550)
    raw = G.raw_games(_read(spark, tmp_path, one, two), G.Config(least_plies=2, least_elo=0, most_gap=300))
    got = [(r.src_rank, r.seq, r.reject, r.status) for r in raw.orderBy("src_rank", "seq").collect()]
    assert got == [(0, 0, None, "kept"), (0, 1, "setup", None), (0, 2, "short", None), (0, 3, "no-result", None), (0, 4, None, "local"), (0, 5, "elo-gap", None), (1, 0, None, "cross"), (1, 1, None, "kept")]
    counts = {r.src_rank: r for r in G.raw_counts(raw).collect()}
    assert counts[0].seen == 6 and counts[0].accepted + counts[0].local + counts[0].short + counts[0].setup + counts[0].no_result + counts[0].elo_gap == 6


def test_many_bad_records_warn_and_do_not_block(spark, tmp_path):
    raw = G.raw_games(_read(spark, tmp_path, _game("1. e4 e5", "*") * 100 + _game("1. e4 e5"), _game("1. d4 d5", "0-1")), G.Config(least_plies=2))
    assert raw.count() == 102 and raw.filter("status = 'kept'").count() == 2
    assert [r.src_rank for r in G.error_warnings(raw).collect()] == [0]


def test_damaged_source_keeps_games_in_raw_and_fails_metal(spark, tmp_path):
    games = _read(spark, tmp_path, _game("1. e4 e5") + '[Event "x"]\n\n1. d4 {\n')
    assert G.raw_games(games, G.Config(least_plies=2)).count() == 1 and G.damaged_sources(games).count() == 1
    try:
        G.legal_games(games)
        raise AssertionError("damage must fail")
    except ValueError:
        pass


def test_evidence_of_32_games(spark, tmp_path):
    tails = [f"13. {w} {b}" for w in ("a3", "a4", "b3", "Nf1") for b in ("a5", "h6", "g6", "Bf8", "Rb8", "Rc8", "Qc8", "c5")]
    text = "".join(_game(f"{LONG} {t}", WhiteElo=2600, BlackElo=2600) for t in tails)
    chosen, models = G.metal_games(_read(spark, tmp_path, text))
    rows = chosen.collect()
    assert len(rows) == 24 and {(r.w, r.d, r.l, r.n) for r in rows} == {(32, 0, 0, 32), (0, 0, 32, 32)}
    assert {round(r.score, 12) for r in rows} == {round(33 / 34, 12), round(1 / 34, 12)}
    assert models.count() == 32 and models.agg(F.min("matched")).first()[0] == 24
    text = models.select(sinks.model_text().alias("t")).first().t
    assert '[PreferenceCoverage "24/24"]' in text and "12. Bc2 Re8 13." in text


def test_illegal_games_count_in_raw_only(spark, tmp_path):
    games = _read(spark, tmp_path, _game("1. e4 e5 2. Ke3 Ke6"))
    c = G.Config(least_plies=2)
    assert G.raw_games(games, c).filter("status = 'kept'").count() == 1 and G.legal_games(games, c).count() == 0


def test_overlay_validation_and_append(spark, tmp_path):
    lines = ["1. e4 e5 2. Nf3", "1. e4 e5 2. d4", "1. d4", "1. e4 e5 2. Ke5", "1. c4", "", "1. d4"]
    text = "".join(_game(m, "*") for m in lines[:5]) + _game("", "*") + _game("1. d4", "*", SetUp=1)
    overlay = G.overlay_lines(_read(spark, tmp_path, text), 2)
    got = [(r.reject, r.status) for r in overlay.orderBy("seq").collect()]
    assert got == [(None, "kept"), (None, "duplicate"), (None, "kept"), ("illegal", None), (None, "kept"), ("empty", None), ("setup", None)]
    base = overlay.filter("seq = 0").select("src_rank", "seq", "line", "edges")
    once = G.append_overlay(base, overlay)
    assert sorted(r.line for r in once.collect()) == ["c4", "d4", "e4 e5"]
    assert G.append_overlay(once, overlay).count() == 3
    assert G.overlay_contribution(base, overlay).first().asDict() == {"contributed": 2, "covered": 1, "new_edges": 2}


def test_transposed_overlay_counts_new_edges(spark, tmp_path):
    base = G.overlay_lines(_read(spark, tmp_path, _game("1. d4 Nf6 2. c4 e6 3. Nc3 Bb4", "*")), 100).filter("status = 'kept'")
    more = G.overlay_lines(_read(spark, tmp_path, _game("1. d4 Nf6 2. c4", "*") + _game("1. c4 Nf6 2. d4 e6 3. Nc3 Bb4", "*") + _game("1. d4 Nf6 2. c4 e6 3. Nc3 Bb4 4. e3 O-O", "*")), 100)
    got = G.overlay_contribution(base, more).first()
    assert (got.contributed, got.covered, got.new_edges) == (3, 0, 5)


def test_written_games_read_back(spark, tmp_path):
    raw = G.raw_games(_read(spark, tmp_path, _game("1. e4 e5", White='A \\"B\\"') + _game("1. d4 d5", "0-1", Foo="x")), G.Config(least_plies=2))
    out = str(tmp_path / "out")
    sinks.write_text(raw, sinks.raw_text(), ["src_rank", "seq"], out)
    sinks.require_count(spark, out, 2)
    back = read_games(spark, out + "/*.txt").orderBy("movetext").collect()
    assert [b.movetext for b in back] == ["1. d4 d5 0-1", "1. e4 e5 1-0"] and back[1].tags["White"] == 'A "B"' and back[0].tags["Foo"] == "x"
    wrapped = spark.range(1).select(sinks.wrapped(F.lit("aa bb cc dd"), 5).alias("t")).first().t
    assert wrapped == "aa bb\ncc dd"


def test_policy_regressions(spark):
    rows = [("thin", 10, 0, 0), ("robust", 40, 40, 20), ("small", 2, 6, 0)]
    s = preference.wilson(preference.with_score(spark.createDataFrame(rows, "move string, w long, d long, l long")))
    got = {r.move: r for r in s.select("*", preference.first_failure(preference.STRICT).alias("strict"), preference.first_failure(preference.SMALL).alias("small"), preference.evidence_weight(preference.SMALL).alias("weight")).collect()}
    assert got["thin"].strict == "below-games" and got["robust"].strict == "ok" and got["small"].strict == "below-games"
    assert got["small"].small == "ok" and 1 <= got["small"].weight <= 3
