from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tabiya.llm import registry
from tabiya.session import cut

SMALL = "/root/testdata/sf0.001"
TABLES = "documents labels".split()


def test_every_operator_has_one_query():
    names = list(registry.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 13)] and set(names) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = registry.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple(str(round(x, 9) if isinstance(x, float) else x) for x in row)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, found.fetchall()))


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    columns = docs.columns
    from tabiya.llm.common import cut

    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SMALL))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    kept = {r.doc_id for r in seen["quality classifier"].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) / len(good) > 0.97
    lines = [x for r in seen["line dedup"].collect() for x in (r.text or "").split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    pieces = seen["best-fit packing"]
    assert pieces.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_empty_documents_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_tables_have_no_file_of_success(spark):
    """Each file that the driver makes on a local file system costs a process, which counts as a second driver while it starts."""
    names = {p.name for x in cut(spark.range(3)).inputFiles() for p in Path(urlparse(x).path).parent.iterdir()}
    assert names and "_SUCCESS" not in names
