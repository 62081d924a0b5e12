"""Functions for SQL: register(session), then SELECT ... FROM games, LATERAL mainline(movetext)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tabiya.kernel import board, pgn
from tabiya.session import ship

MAINLINE = "ply int, san string, uci string, a long, b long, white boolean"
LEGAL = "uci string, san string, fen string"


@F.udtf(returnType=MAINLINE)
class Mainline:
    """A row for each move of a move text's main line, with the key of the position before it; none if any move is illegal."""

    def eval(self, movetext: str):
        found = board.mainline(pgn.strip_mainline(movetext or "")[0])
        for ply, (san, (a, b, move, white)) in enumerate(zip(*found, strict=True) if found else ()):
            yield ply, san, board.uci((move & 63, move >> 6 & 63, move >> 12)), a, b, white


@F.udtf(returnType=LEGAL)
class LegalMoves:
    """A row for each legal move of a position, with the position after it, by coordinates; none for what isn't a position."""

    def eval(self, fen: str):
        try:
            b = board.Board.from_fen(fen or "")
        except (ValueError, IndexError):
            return
        for m in sorted(b.legal(), key=board.uci):
            yield board.uci(m), b.san(m), b.apply(m).fen()


def canonical_moves(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical moves of each array of tokens, whole batches at once (kernel.replay); null if any is illegal."""
    from tabiya.kernel.replay import replay

    for batch in tokens:
        games = pa.array([None if x is None else list(x) for x in batch], pa.list_(pa.string()))
        yield pd.Series(replay(games).sans().to_pylist())


def main_moves(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The moves of each move text's main line, as spelled."""
    for batch in texts:
        yield batch.map(lambda x: pgn.strip_mainline(x or "")[0])


def register(spark: SparkSession) -> SparkSession:
    """Makes mainline, legal_moves (in FROM), canonical_moves and main_moves known to the session's SQL."""
    ship(spark)
    spark.udtf.register("mainline", Mainline)
    spark.udtf.register("legal_moves", LegalMoves)
    kind = "array<string>"
    spark.udf.register("canonical_moves", F.pandas_udf(canonical_moves, kind, F.PandasUDFType.SCALAR_ITER))
    spark.udf.register("main_moves", F.pandas_udf(main_moves, kind, F.PandasUDFType.SCALAR_ITER))
    return spark
