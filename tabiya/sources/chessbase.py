"""Games from CBH and 2CBH sets, in the columns of sources.pgn with a reason for records that aren't games.

A set's main file is cut into ranges of records (sources.ranges); each task reads its range and, at their offsets, the games, players and events that it points to.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.kernel import chessbase as K
from tabiya.kernel.board import Board
from tabiya.sources import ranges

SCHEMA = "path string, seq long, tags map<string,string>, tag_order array<string>, movetext string, error string, reason string, variations long"
_KINDS = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64())
_NAMES = ["path", "seq", "tags", "tag_order", "movetext", "error", "reason", "variations"]
RESULT = {2: "1-0", 1: "1/2-1/2", 0: "0-1"}
CBH, CBH2 = 46, 192
#: Names that a task remembers.
PEOPLE = 50_000


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1").strip()


def movetext(sans: list[str], result: str, black_first: bool = False, number: int = 1) -> str:
    out = []
    for i, san in enumerate(sans):
        ply = i + black_first
        if ply % 2 == 0:
            out.append(f"{number + ply // 2}.")
        elif i == 0:
            out.append(f"{number}...")
        out.append(san)
    return " ".join([*out, result])


def clean(value: str) -> str:
    """Control characters and runs of white space become one space; nothing becomes ?."""
    return re.sub(r"[\x00-\x20\x7f]+", " ", value).strip() or "?"


def _row(path, seq, tags, sans, result, variations=0, black_first=False, number=1):
    tags = [(k, clean(v)) for k, v in tags]
    return (path, seq, tags, [k for k, _ in tags], movetext(sans, result, black_first, number), None, None, variations)


def _none(path, seq, reason):
    return (path, seq, None, None, None, None, reason, 0)


def parse_2cbh(path: str, f: dict, first: int, last: int):
    """Records first to last of 192 bytes, of which the header is 0; games by offset; players by id from a file of 4234-byte records."""
    heads, games, people = f["2cbh"], f["2cbg"], f["2lid"]
    if len(heads) % CBH2 or len(heads) < 2 * CBH2:
        raise ValueError(f"{path}: records have 192 bytes")

    @lru_cache(PEOPLE)
    def person(i: int) -> str:
        rec = people[184 + i * 4234 : 184 + (i + 1) * 4234]
        n = int.from_bytes(rec[4:8], "little")
        if len(rec) < 4234 or 12 + n > len(rec):
            return "?"
        m = int.from_bytes(rec[8 + n : 12 + n], "little")
        parts = [x.decode("utf-8", "replace").replace("�", "?").strip() for x in (rec[8 : 8 + n], rec[12 + n : 12 + n + m])]
        return ", ".join(x for x in parts if x) if parts[1] else parts[0] or "?"

    for seq in range(first, min(last, len(heads) // CBH2)):
        rec = heads[seq * CBH2 : (seq + 1) * CBH2]
        at = int.from_bytes(rec[8:16], "little")
        head = games[at : at + 28]
        size = int.from_bytes(head[8:12], "little")
        reason = (
            "inactive" if not rec[0] & 1
            else "offset" if len(head) < 28
            else "header" if head[:8] != K.MAGIC
            else "length" if size < 4 or size % 2
            else "start" if head[24:28] != K.STANDARD
            else "cut" if at + 24 + size > len(games)
            else None
        )
        if reason:
            yield _none(path, seq, reason)
            continue
        try:
            sans = K.decode_tokens(games[at + 28 : at + 24 + size])
        except ValueError:
            yield _none(path, seq, "moves")
            continue
        x = int.from_bytes(rec[188:191], "little")
        y, m, d = x >> 9, x >> 5 & 15, x & 31
        date = f"{y:04}.{m:02}.{d:02}" if y and 1 <= m <= 12 and d else "????.??.??"
        result = RESULT.get(rec[88], "*")
        white, black = (int.from_bytes(rec[k : k + 8], "little") for k in (24, 32))
        tags = [("Event", "?"), ("Site", "?"), ("Date", date), ("Round", "?"), ("White", person(white)), ("Black", person(black)), ("Result", result)]
        tags += [(n, str(v)) for n, v in (("WhiteElo", int.from_bytes(rec[96:98], "little")), ("BlackElo", int.from_bytes(rec[112:114], "little"))) if v]
        yield _row(path, seq, tags, sans, result)


def parse_cbh(path: str, f: dict, tables: K.Tables, first: int, last: int):
    """Records first to last of 46 bytes, of which the header is 0; games by offset; players and events by id."""
    heads, games, people, events = f["cbh"], f["cbg"], f["cbp"], f["cbt"]
    if len(heads) % CBH or len(heads) < 2 * CBH:
        raise ValueError(f"{path}: records have 46 bytes")

    def fields(data: bytes, i: int, size: int, *cuts: tuple[int, int]) -> list[str] | None:
        base = 32 if len(data) > 24 and data[24] == 4 else 28
        rec = data[base + i * size : base + (i + 1) * size]
        return [_text(rec[a:b]) for a, b in cuts] if len(rec) == size else None

    @lru_cache(PEOPLE)
    def person(i: int) -> str:
        found = fields(people, i, 67, (9, 39), (39, 59))
        return "?" if not found else ", ".join(found) if found[1] else found[0] or "?"

    big = lambda x: int.from_bytes(x, "big")
    for seq in range(first, min(last, len(heads) // CBH)):
        rec = heads[seq * CBH : (seq + 1) * CBH]
        at = big(rec[1:5])
        word = big(games[at : at + 4])
        size = word & 0xFFFFFF
        skip = 32 if word & 0x40000000 else 4
        reason = (
            "inactive" if not rec[0] & 1 or rec[0] & 128
            else "offset" if len(games[at : at + 4]) < 4
            else "length" if size < skip
            else "not encoded" if word & 0x80000000
            else "special" if word & 0x04000000
            else "chess960" if word & 0x0A000000
            else "cut" if at + size > len(games)
            else None
        )
        if reason:
            yield _none(path, seq, reason)
            continue
        try:
            b, number = K.custom_start(games[at + 4 : at + 32]) if skip == 32 else (Board.start(), 1)
            fen, first = f"{b.fen()} 0 {number}" if skip == 32 else "", b.side < 0
            sans, variations = K.decode_stream(games[at + skip : at + size], b, tables)
        except ValueError as e:
            yield _none(path, seq, f"moves: {e}")
            continue
        x = big(rec[24:27])
        y, m, d = x >> 9, x >> 5 & 15, x & 31
        date = f"{y:04}.{f'{m:02}' if 1 <= m <= 12 else '??'}.{f'{d:02}' if d else '??'}" if y else "????.??.??"
        result = RESULT.get(rec[27], "*")
        event, site = fields(events, big(rec[15:18]), 99, (9, 49), (49, 79)) or ["?", "?"]
        round_ = f"{rec[29]}({rec[30]})" if rec[30] else str(rec[29])
        tags = [("Event", event), ("Site", site), ("Date", date), ("Round", round_), ("White", person(big(rec[9:12]))), ("Black", person(big(rec[12:15]))), ("Result", result)]
        tags += [(n, str(v)) for n, v in (("WhiteElo", big(rec[31:33])), ("BlackElo", big(rec[33:35]))) if v]
        tags += [("SetUp", "1"), ("FEN", fen)] if fen else []
        yield _row(path, seq, tags, sans, result, variations, first, number)


class _Parse:
    """What a task does with a range of a set."""

    def __init__(self, kind: str, tables: K.Tables | None = None):
        self.kind, self.tables = kind, tables

    def __call__(self, path: str, files: dict, first: int, last: int, lost: list[str]):
        if lost:
            return [_none(path, 0, "incomplete: " + ", ".join(lost))] if first == 1 else []
        return parse_2cbh(path, files, first, last) if self.kind == "2cbh" else parse_cbh(path, files, self.tables, first, last)


def _read(spark: SparkSession, paths, main: str, parse: _Parse) -> DataFrame:
    found = ranges.listed(spark, paths)
    if not ranges.opened(found):
        raise ValueError("sets are read at offsets, which this store doesn't allow: copy them to one of " + ", ".join(ranges.OPENED))
    needed = {"cbh": ("cbg", "cbp", "cbt"), "2cbh": ("2cbg", "2lid")}[main]
    by: dict[str, dict[str, tuple[str, int]]] = {}
    for path, size in found:  # a folder's listing
        stem, _, ext = path.rpartition(".")
        by.setdefault(stem.lower(), {})[ext.lower()] = (path, size)
    sets = [(*x[main], {e: p for e, (p, _) in x.items() if e in (main, *needed)}, [e for e in needed if e not in x]) for _, x in sorted(by.items()) if main in x]
    return ranges.read_sets(spark, sets, SCHEMA, (_KINDS, _NAMES, {"cbh": CBH, "2cbh": CBH2}[main], (main, needed[0]), parse))


def read_2cbh(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of all records of the sets among the files at paths; reason is null for games."""
    return _read(spark, paths, "2cbh", _Parse("2cbh"))


def read_cbh(spark: SparkSession, paths: str | list[str], tables: K.Tables) -> DataFrame:
    return _read(spark, paths, "cbh", _Parse("cbh", tables))


def games(rows: DataFrame) -> DataFrame:
    """The games, with the columns of read_games()."""
    return rows.filter("reason is null").drop("reason", "variations")


def reasons(rows: DataFrame) -> DataFrame:
    """How many records were left out, by reason; none converted from some is an error of its set."""
    return rows.groupBy("path", F.coalesce("reason", F.lit("converted")).alias("reason")).agg(F.count("*").alias("n")).orderBy("path", "reason")
