"""Games from PGN files.

A comment may hold anything, so where a record begins is known only from the file's start. read_games() shares a file among tasks all the same: Spark splits
it at line ends, each block's effect on the reader's state is found for whatever state it may be entered in (kernel.pgn_blocks), the effects are
folded in the order of blocks, and then each block yields its own records. Records that reach over a block's end are joined from their parts.
whole_games() reads a file in one task, up to 2 GB; both give the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.kernel import pgn
from tabiya.kernel.pgn_blocks import TAG, TEXT, Entry, effect, kind, turn
from tabiya.session import ship

SCHEMA = "path string, seq long, tags map<string,string>, tag_order array<string>, movetext string, error string"
_KINDS = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
_NAMES = ["path", "seq", "tags", "tag_order", "movetext", "error"]
BATCH = 2000
DAMAGED, UNCLOSED = "a comment or variation ends that didn't begin", "a comment or variation isn't closed"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _NAMES)


def parse_files(batches):
    """Rows of each (path, content); damage is a last row with an error, after the whole records before it."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows, seq = [], 0
            lines = iter((content.as_py() or b"").decode("utf-8", "replace").split("\n"))
            try:
                for tags, order, text in pgn.records(lines):
                    rows.append((path, seq, list(tags.items()), order, text, None))
                    seq += 1
                    if len(rows) >= BATCH:
                        yield _batch(rows)
                        rows = []
            except pgn.DamagedSource as e:
                rows.append((path, seq, None, None, None, str(e)))
            if rows:
                yield _batch(rows)


def whole_games(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, seq (place in the file), tags, tag_order, movetext, error; each file by one task."""
    files = ship(spark).read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    return files.mapInArrow(parse_files, SCHEMA)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of each block of the files, in order within a task."""
    found = ship(spark).read.option("lineSep", "\n").text(paths)
    # This column shows paths as URLs.
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    return found.select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _blocks(batches) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """(path, block) and the lines of each block of a task."""

    def rows():
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "block", "line"))
            for path, block, line in zip(*columns, strict=True):
                yield (path, block), line.decode("utf-8", "replace").rstrip("\r\n")

    for key, group in groupby(rows(), itemgetter(0)):
        yield key, (line.removeprefix("\ufeff") if not key[1] and not k else line for k, (_, line) in enumerate(group))


def block_entries(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, int], tuple[Entry, int, bool, str | None]]:
    """By path and block: how it is entered, the number of the file's record that isn't whole (-1: none), whether the block is the last, and then what is wrong.

    One small entry for each block, as the driver holds in its plan of the read, too.
    """

    def run(batches):
        for (path, block), lines in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([pickle.dumps(effect(lines))], pa.binary())], ["path", "block", "effect"])

    by: dict[str, list] = {}
    for r in _lines(spark, paths).mapInArrow(run, "path string, block long, effect binary").collect():
        by.setdefault(r["path"], []).append((r["block"], pickle.loads(r["effect"])))
    out = {}
    for path, blocks in by.items():
        entry, entries = Entry(), []
        for block, what in sorted(blocks, key=itemgetter(0)):
            entries.append((block, entry))
            entry = entry.after(what)
        wrong = DAMAGED if entry.damaged else UNCLOSED if entry.brace or entry.depth else None
        for k, (block, at) in enumerate(entries):
            out[path, block] = (at, entry.seq if wrong else -1, k == len(entries) - 1, wrong if k == len(entries) - 1 else None)
    return out


def read_games(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, seq (place in the file), tags, tag_order, movetext, error; the blocks of a file by many tasks.

    Damage is a last row with an error, after the whole records before it. The files must not change between this call and the use of its result.
    """
    entries = spark.sparkContext.broadcast(block_entries(spark, paths))

    def records(batches, parts: bool):
        """Whole records of each block; or the parts of others at its start and end."""
        for key, lines in _blocks(batches):
            if key not in entries.value:
                raise ValueError(f"{key[0]} was split otherwise before: it has changed, or the session's settings have")
            at, broken, last, wrong = entries.value[key]
            rows, held, head, seq, text = [], [], key[1] > 0, at.seq, at.text
            if wrong and not parts:
                rows.append((key[0], broken, None, None, None, wrong))

            def close(tail: bool):
                """The open record ends here, or (a tail) goes on in the next block."""
                if (head or tail) == parts and held and not at.damaged and seq != broken:
                    if parts:
                        rows.append((key[0], seq, key[1], "\n".join(held)))
                    else:
                        rows.extend((key[0], seq, list(t.items()), o, m, None) for t, o, m in pgn.records(held))

            brace, depth = at.brace, at.depth
            for line in lines:
                what = kind(line, brace, depth)
                if what == TAG and text:
                    close(False)
                    held, head, text, seq = [], False, False, seq + 1
                    if len(rows) >= BATCH:
                        yield rows
                        rows = []
                elif what == TEXT:
                    text = True
                    bad, brace, more, drop = turn(line, brace)
                    if bad or depth < drop:
                        break
                    depth += more
                if what:
                    held.append(line)
            else:
                close(not last)
            yield rows

    def whole(batches):
        for rows in records(batches, False):
            if rows:
                yield _batch(rows)

    def partly(batches):
        for rows in records(batches, True):
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "seq", "block", "lines"])

    def joined(batches):
        for batch in batches:
            rows = []
            for path, seq, lines in zip(*(batch.column(c).to_pylist() for c in ("path", "seq", "lines")), strict=True):
                rows += [(path, seq, list(t.items()), o, m, None) for t, o, m in pgn.records(lines.split("\n"))]
            yield _batch(rows)

    lines = _lines(spark, paths)
    parts = lines.mapInArrow(partly, "path string, seq long, block long, lines string")
    # A record's parts, one for each block that it reaches over.
    parts = parts.groupBy("path", "seq").agg(F.sort_array(F.collect_list(F.struct("block", "lines"))).alias("parts"))
    parts = parts.select("path", "seq", F.array_join(F.col("parts.lines"), "\n").alias("lines"))
    return lines.mapInArrow(whole, SCHEMA).unionByName(parts.mapInArrow(joined, SCHEMA))


def with_mainline(games: DataFrame) -> DataFrame:
    """Adds toks, text_result, vars and comments of each record's move text."""

    def run(batches):
        for batch in batches:
            found = [pgn.strip_mainline(x or "") for x in batch.column("movetext").to_pylist()]
            kinds = (pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64())
            extra = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "toks", "text_result", "vars", "comments"])

    from pyspark.sql import types as T

    more = T._parse_datatype_string("toks array<string>, text_result string, vars long, comments long")
    return games.mapInArrow(run, T.StructType([*games.schema.fields, *more.fields]))
