import re
import shutil

import duckdb
import pytest
from jobs import move_evidence, queries, raw_records
from jobs.common import settings

SMALL = "/root/testdata/sf0.001"


def _key(row):
    return tuple(str(round(x, 9) if isinstance(x, float) else x) for x in row)


def _sql(name, **tables):
    con = duckdb.connect()
    for table, files in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet({files})")
    found = con.execute(queries.ORACLES[name])
    return [c[0] for c in found.description], sorted(map(_key, found.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_jobs_match_their_sql(spark, name):
    columns, want = _sql(name, documents=[f"{SMALL}/documents.parquet"], lineitem=[f"{SMALL}/lineitem.parquet"])
    before = dict(spark.conf.getAll) if hasattr(spark.conf, "getAll") else None
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(_key, got.select(*columns).collect())) == want
    if before is not None:
        assert {k: v for k, v in dict(spark.conf.getAll).items() if k != "spark.checkpoint.dir"} == {k: v for k, v in before.items() if k != "spark.checkpoint.dir"}


def _files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*.parquet"))


def test_evidence_grows_with_the_folder(spark, tmp_path):
    """Two runs over a folder that grows between them, and a third one over the same: only new files are read."""
    source, out = tmp_path / "games", tmp_path / "out"
    source.mkdir()
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_returnflag").toPandas()
    parts = [rows.iloc[:2000], rows.iloc[2000:2100], rows.iloc[2100:]]
    for k, part in enumerate(parts[:1]):
        part.to_parquet(source / f"{k}.parquet")
    config = settings("move_evidence") | {"files_a_batch": 1}
    move_evidence.run(spark, str(source), str(out), config)
    first = {r.batch for r in spark.read.parquet(str(out / "tallies")).select("batch").distinct().collect()}
    for k, part in enumerate(parts[1:], 1):
        part.to_parquet(source / f"{k}.parquet")
    move_evidence.run(spark, str(source), str(out), config)
    tallies = spark.read.parquet(str(out / "tallies"))
    assert first == {0} and {r.batch for r in tallies.select("batch").distinct().collect()} == {0, 1, 2}
    sizes = {r.batch: r.n for r in tallies.groupBy("batch").agg({"w": "sum"}).withColumnRenamed("sum(w)", "n").collect()}
    assert sizes[1] == int((parts[1].l_returnflag == "A").sum()) or sizes[2] == int((parts[1].l_returnflag == "A").sum())
    columns, want = _sql("job2_move_evidence", lineitem=[str(p) for p in source.glob("*.parquet")])
    got = move_evidence.read(spark, str(out)).select(*columns)
    assert sorted(map(_key, got.collect())) == want
    before = _files(out / "tallies")
    move_evidence.run(spark, str(source), str(out), config)
    assert _files(out / "tallies") == before and sorted(map(_key, move_evidence.read(spark, str(out)).select(*columns).collect())) == want


def test_a_broken_batch_is_made_again(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "games", tmp_path / "out"
    source.mkdir()
    shutil.copy(f"{SMALL}/lineitem.parquet", source / "0.parquet")
    config, whole = settings("move_evidence"), move_evidence.tallies
    calls = []

    def broken(games, config):
        calls.append(1)
        whole(games, config).limit(5).write.parquet(f"{out}/tallies/batch=0")  # what an attempt left behind
        raise RuntimeError("broken off")

    monkeypatch.setattr(move_evidence, "tallies", broken)
    with pytest.raises(Exception, match="broken off"):
        move_evidence.run(spark, str(source), str(out), config)
    monkeypatch.setattr(move_evidence, "tallies", whole)
    move_evidence.run(spark, str(source), str(out), config)
    columns, want = _sql("job2_move_evidence", lineitem=[f"{SMALL}/lineitem.parquet"])
    assert len(calls) == 1 and sorted(map(_key, move_evidence.read(spark, str(out)).select(*columns).collect())) == want


TEXT = " ".join(f"w{i}" for i in range(30))
ROWS = [
    (1, TEXT, "en", "b"), (2, TEXT, "en", "b"), (3, TEXT, "en", "a"), (4, TEXT + " more", None, None), (5, TEXT + " more", None, ""), (6, None, "en", "a"), (7, " \n", "en", "a"), (8, "few words", "en", "a"),
    (9, TEXT, "de", "a b/c"), (10, "x " * 50_000, "en", "a b/c"), (11, TEXT.upper(), "en", "ä"),
]


def test_records_of_all_kinds(spark, tmp_path):
    spark.createDataFrame([(*r, "seq", "sig") for r in ROWS], "doc_id long, text string, lang string, source string, shelf string, sig string").write.parquet(str(tmp_path / "documents.parquet"))
    out = str(tmp_path / "out")
    for _ in range(2):
        raw_records.run(spark, str(tmp_path / "documents.parquet"), out, settings("raw_records"))
        got = {r.seq: r for r in raw_records.read(spark, out).collect()}
        assert {k: r.fate for k, r in got.items()} == {1: "cross", 2: "local", 3: "kept", 4: "cross", 5: "kept", 6: "rejected", 7: "rejected", 8: "rejected", 9: "kept", 10: "kept", 11: "kept"} or {k: r.fate for k, r in got.items()} == {1: "cross", 2: "local", 3: "kept", 4: "kept", 5: "cross", 6: "rejected", 7: "rejected", 8: "rejected", 9: "kept", 10: "kept", 11: "kept"}
        assert [got[k].reject for k in (6, 7, 8)] == ["empty", "empty", "short"] and got[10].text == "x " * 50_000 and got[2].text is None and got[4].source is None and got[5].source == ""
        shelves = {r.shelf for r in got.values()}
        assert len(shelves) == 6 and all(re.fullmatch(r"[A-Za-z0-9._-]+", s) for s in shelves)
        report = {r.shelf: (r.seen, r.kept, r.local, r.cross, r.empty, r.short) for r in spark.read.json(out + "/report").collect()}
        assert report["a"] == (4, 1, 0, 0, 2, 1) and report["b"] == (2, 0, 1, 1, 0, 0)
    columns, want = _sql("job1_raw_records", documents=[str(p) for p in (tmp_path / "documents.parquet").glob("*.parquet")])
    assert sorted(map(_key, raw_records.read(spark, out).select(*columns).collect())) == want


def test_words_are_made_once_for_each_side(spark):
    """Of the comparison's two sides each makes words and signatures once: not again to filter nulls out, nor for a source's rank."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    plan = raw_records.records(docs, settings("raw_records"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 and plan.count("array_join(") == 2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    raw_records.run(spark, str(tmp_path / "documents.parquet"), str(tmp_path / "out"), settings("raw_records"))
    assert raw_records.read(spark, str(tmp_path / "out")).count() == 0


def test_settings_of_a_file_take_precedence(tmp_path):
    (tmp_path / "own.json").write_text('{"least_words": 3}')
    assert settings("raw_records", str(tmp_path / "own.json")) == settings("raw_records") | {"least_words": 3}
