"""Expressions over game text: tags, results, ratings, move lists, dates and move codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESULTS = ("1-0", "0-1", "1/2-1/2")
#: A tag pair on a line of its own. The value's repetition is possessive: Java takes a stack frame for each step of any other.
TAG = r'^\[([A-Za-z0-9_]+)[ \t\n\f\r]+"((?:[^"\\]|\\["\\])*+)"[ \t\n\f\r]*\][ \t\n\f\r]*$'


def tag_name(line: Column) -> Column:
    return F.regexp_extract(line, TAG, 1)


def tag_value(line: Column) -> Column:
    return unescape(F.regexp_extract(line, TAG, 2))


def unescape(value: Column) -> Column:
    """Backslash quote first, then double backslash."""
    return F.replace(F.replace(value, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def rating(value: Column) -> Column:
    """A whole number, maybe signed, else null."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(r"^[+-]?[0-9]{1,18}$"), F.regexp_replace(trimmed, r"^\+", "").cast("bigint"))


def valid_result(value: Column) -> Column:
    return F.trim(value).isin(*RESULTS)


def result_of(movetext: Column, tag: Column) -> Column:
    """The move text's result if it has one, even *, else the tag's."""
    return F.coalesce(F.when(movetext != "", movetext), tag)


def outcome(result: Column, white_to_move: Column) -> Column:
    """1 won, 2 drawn, 3 lost, from the mover's side."""
    won = F.when(white_to_move, F.lit("1-0")).otherwise(F.lit("0-1"))
    return F.when(result == "1/2-1/2", 2).when(result == won, 1).otherwise(3)


def movetext(moves: Column) -> Column:
    """1. e4 e5 2. Nf3 ..."""
    numbered = F.transform(moves, lambda m, i: F.when(i % 2 == 0, F.concat((i / 2 + 1).cast("int").cast("string"), F.lit(". "), m)).otherwise(m))
    return F.array_join(numbered, " ")


def line_key(moves: Column) -> Column:
    return F.array_join(moves, " ")


def signature(moves: Column, result: Column) -> Column:
    """The first 128 bits, in hex, of the sha-256 of moves, result and start position."""
    return F.substring(F.sha2(F.concat(F.array_join(moves, chr(31)), F.lit("|"), result, F.lit("|standard")), 256), 1, 32)


def result_code(code: Column) -> Column:
    return F.when(code == 2, "1-0").when(code == 1, "1/2-1/2").when(code == 0, "0-1").otherwise("*")


def packed_date(packed: Column) -> Column:
    """YYYY.MM.DD of 12 bits of year, 4 of month and 5 of day, with question marks for zeros."""
    day, month, year = packed.bitwiseAND(F.lit(31)), F.shiftright(packed, 5).bitwiseAND(F.lit(15)), F.shiftright(packed, 9).bitwiseAND(F.lit(4095))
    part = lambda x, n: F.when(x == 0, F.lit("?" * n)).otherwise(F.lpad(x.cast("string"), n, "0"))
    return F.concat_ws(".", part(year, 4), part(month, 2), part(day, 2))


def square(index: Column) -> Column:
    """a1 is 0, h8 is 63."""
    return F.concat(F.substring(F.lit("abcdefgh"), index % 8 + 1, F.lit(1)), (F.floor(index / 8) + 1).cast("string"))


def book_move(code: Column) -> Column:
    """Coordinates of a book's 16-bit move: three bits each of to-file, to-row, from-file, from-row and promotion; null beyond a queen."""
    to, start = code.bitwiseAND(F.lit(63)), F.shiftright(code, 6).bitwiseAND(F.lit(63))
    promotion = F.shiftright(code, 12).bitwiseAND(F.lit(7))
    return F.when(promotion <= 4, F.concat(square(start), square(to), F.substring(F.lit("nbrq"), promotion, F.when(promotion > 0, 1).otherwise(0))))
