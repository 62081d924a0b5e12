import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabiya.sources import books, ranges


def _book(path, n, start=0):
    r = np.zeros(n, books._RECORD)
    r["key"], r["move"], r["weight"], r["learn"] = np.arange(start, start + n) * 7, np.arange(n) % 4096, 5, 9
    path.write_bytes(r.tobytes())


def test_ranges_equal_whole_files(spark, tmp_path, monkeypatch):
    _book(tmp_path / "a b.bin", 20_000)
    _book(tmp_path / "c.bin", 3, 10**6)
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(books.read_polyglot(spark, str(tmp_path)))
    monkeypatch.setattr(ranges, "TASK_BYTES", 16 * 4096 * 2)
    split = books.read_polyglot(spark, str(tmp_path))
    assert split.rdd.getNumPartitions() == 4 and rows(split) == whole and len(whole) == 20_003
    monkeypatch.setattr(ranges, "opened", lambda files: False)
    assert rows(books.read_polyglot(spark, str(tmp_path))) == whole
    assert rows(books.read_polyglot(spark, str(tmp_path), 100, 5000)) == [r for r in whole if 100 <= r[1] < 5000]


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """Sparse, so it takes no room; only the range that is asked for is read."""
    path, n = tmp_path / "large.bin", (3 << 30) // 16
    _book(path, 2)
    with open(path, "r+b") as f:
        f.truncate(n * 16)
        f.seek((n - 1) * 16)
        f.write((77).to_bytes(8, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(4))
    last = books.read_polyglot(spark, str(path), n - 1)
    assert [(r.seq, r.key, r.move, r.weight) for r in last.collect()] == [(n - 1, 77, 1, 2)]
    assert [r.seq for r in books.read_polyglot(spark, str(path), 0, 2).collect()] == [0, 1]


def test_filters_reach_the_file(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(bytes(range(100)))
    files = ranges.listed(spark, str(tmp_path))
    spark.conf.set(ranges.PUSHDOWN, "true")
    try:
        df = ranges.read_records(spark, files, 10, header=20).filter("seq >= 2 and seq < 4")
        assert [(r.seq, bytes(r.data)) for r in df.collect()] == [(2, bytes(range(40, 50))), (3, bytes(range(50, 60)))]
        reader = ranges.PushedReader(dict(files='[["/f", 100]]', size="10", header="20", per="1", task="100"))
        from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual

        left = list(reader.pushFilters([GreaterThan(("seq",), 1), LessThanOrEqual(("seq",), 5), IsNotNull(("seq",)), EqualTo(("path",), "x")]))
        assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"] and (reader.partitions()[0].first, reader.partitions()[-1].last) == (2, 6)
    finally:
        spark.conf.unset(ranges.PUSHDOWN)
    assert [r.seq for r in ranges.read_records(spark, files, 10, header=20).filter("seq = 7").collect()] == [7]


@pytest.mark.parametrize("ahead", [0, 7, 1000])
def test_bytes_by_slices(tmp_path, ahead):
    data = bytes(range(200))
    (tmp_path / "x").write_bytes(data)
    b = ranges.Bytes(str(tmp_path / "x"), ahead)
    assert len(b) == 200 and b[5] == 5 and all(b[i:j] == data[i:j] for i in range(0, 210, 13) for j in range(0, 230, 17))


def test_pages_are_shared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "TASK_BYTES", 4096)
    page = (1).to_bytes(2, "big") + bytes(2) + bytes([2, 9]) + bytes([3, 5, 0]) + bytes(33)
    (tmp_path / "p.ctg").write_bytes(bytes(4096) + b"".join(page.ljust(4096, b"\0") for _ in range(5)))
    got = books.read_ctg(spark, str(tmp_path / "p.ctg"))
    assert got.rdd.getNumPartitions() == 5 and sorted(r.page for r in got.collect()) == [0, 1, 2, 3, 4]
    r = books.preflight(spark, str(tmp_path / "p.ctg")).first()
    assert (r.pages, r.positions, r.moves, r.invalid_pages) == (5, 5, 5, 0)
    assert books.preflight(spark, str(tmp_path / "p.ctg")).agg(F.count("*")).first()[0] == 1
    assert isinstance(got.schema["signature"].dataType.typeName(), str) and pa.binary() == pa.binary()
