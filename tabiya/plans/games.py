"""Game pipelines: raw games, model games, overlays.

Sources come as a table of games (sources.pgn.read_games) with src_rank, the place of a game's source in the order of
sources. Order is (src_rank, seq) everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabiya.functions import text as X
from tabiya.kernel.replay import replay
from tabiya.operators import coverage, dedup, preference, reject
from tabiya.session import cut
from tabiya.sources.pgn import with_mainline


@dataclass(frozen=True)
class Config:
    most_plies: int = 100
    least_plies: int = 24
    least_elo: int = 0
    most_gap: int = 0
    evidence: preference.Evidence = preference.Evidence()
    least_matched: int = 3
    least_share: float = 0.80


def classified(games: DataFrame, c: Config) -> DataFrame:
    """games with moves, result, ratings, raw signature and reject (null: accepted)."""
    g = with_mainline(games.filter("error is null"))
    g = g.withColumn("result", F.trim(X.result_of(F.col("text_result"), F.col("tags")["Result"])))
    g = g.withColumn("white_elo", X.rating(F.col("tags")["WhiteElo"])).withColumn("black_elo", X.rating(F.col("tags")["BlackElo"]))
    g = reject.classify(g, reject.game_rules(c.least_plies, c.least_elo, c.most_gap))
    return g.withColumn("sig", X.signature(F.col("toks"), F.col("result")))


def raw_games(games: DataFrame, c: Config = Config()) -> DataFrame:
    """Every record with reject and status (kept, local, cross; null if rejected); moves are capped after the signature is taken.

    Legality isn't checked here. A damaged source keeps the records before the damage.
    """
    g = classified(games, c)
    good = dedup.duplicate_status(g.filter("reject is null").withColumn("seq_", F.struct("seq")), ["sig"], "src_rank", "seq_").drop("seq_")
    bad = g.filter("reject is not null").withColumn("status", F.lit(None).cast("string"))
    return good.unionByName(bad).withColumn("toks", F.slice("toks", 1, c.most_plies))


def raw_counts(raw: DataFrame) -> DataFrame:
    """Per source: seen, accepted, local and cross duplicates, and each reason's count."""
    when = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    reasons = [when(F.col("reject") == r).alias(r.replace("-", "_")) for r in ("no-result", "setup", "short", "elo", "elo-gap")]
    return raw.groupBy("src_rank").agg(F.count("*").alias("seen"), when(F.col("status") == "kept").alias("accepted"), when(F.col("status") == "local").alias("local"), when(F.col("status") == "cross").alias("cross"), *reasons)


def damaged_sources(games: DataFrame) -> DataFrame:
    return games.filter("error is not null").select("src_rank", "path", "seq", "error")


def error_warnings(raw: DataFrame) -> DataFrame:
    """src_rank of sources of which, at some bad record past the 100th, at least 10 % were bad."""
    from tabiya.operators.running import error_alerts

    bad = raw.select("src_rank", "seq", (F.col("reject") == "no-result").alias("bad")).fillna(False, ["bad"])
    return error_alerts(bad, ["src_rank"], "seq", "bad").select("src_rank").distinct()


def _mainlines(games: DataFrame, most_plies: int | None) -> DataFrame:
    """Adds san (canonical moves; null if any is illegal) and edges of the first most_plies."""

    def run(batches):
        for batch in batches:
            found = replay(batch.column("toks"), most_plies)
            yield pa.RecordBatch.from_arrays([*batch.columns, found.sans(), found.edges(most_plies)], [*batch.schema.names, "san", "edges"])

    more = T._parse_datatype_string("san array<string>, edges array<struct<a:bigint,b:bigint,move:int,white:boolean>>")
    return games.mapInArrow(run, T.StructType([*games.schema.fields, *more.fields]))


def with_edges(lines: DataFrame, most_plies: int | None = None) -> DataFrame:
    """lines (toks) with san and edges of the first most_plies (None: of all)."""
    return _mainlines(lines, most_plies)


def legal_games(games: DataFrame, c: Config = Config()) -> DataFrame:
    """Accepted games with only legal moves, first of each canonical signature, with game_id; damage in any source fails the query."""
    broken = games.filter("error is not null").limit(1).collect()
    if broken:
        raise ValueError(f"damaged source: {broken[0]['error']}")
    g = _mainlines(classified(games, c).filter("reject is null"), c.most_plies).filter("san is not null")
    g = dedup.keep_first(g.withColumn("sig", X.signature(F.col("san"), F.col("result"))).withColumn("tags", F.map_entries("tags")), ["sig"], ["src_rank", "seq"])
    return g.withColumn("tags", F.map_from_entries("tags")).withColumn("game_id", F.concat_ws(":", "src_rank", "seq"))


def observations(games: DataFrame) -> DataFrame:
    """game_id, a, b, move, outcome: each position and move once in a game, from the mover's side."""
    e = games.select("game_id", "result", F.explode(F.array_distinct("edges")).alias("e"))
    return e.select("game_id", "e.a", "e.b", "e.move", X.outcome(F.col("result"), F.col("e.white")).alias("outcome"))


def metal_games(games: DataFrame, c: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """The preferred moves, and the whole games that follow them, with covered and matched."""
    legal = cut(legal_games(games, c))
    seen = observations(legal)
    chosen = cut(preference.preferred(preference.tally(seen, ["a", "b"], "move", "outcome"), ["a", "b"], "move", c.evidence))
    found = coverage.model_games(coverage.game_coverage(seen, "game_id", ["a", "b"], "move", chosen), c.least_matched, c.least_share)
    return chosen, legal.join(found, "game_id")


def overlay_lines(games: DataFrame, most_plies: int = 100) -> DataFrame:
    """Every overlay record with reject (setup, empty, illegal), san (capped) and line, and status kept or duplicate.

    Neither length nor ratings count, and a legal line may end with any result; moves past the cap must be legal too.
    """
    g = with_mainline(games.filter("error is null"))
    setup = (F.coalesce(F.col("tags")["SetUp"], F.lit("")) == "1") | (F.coalesce(F.col("tags")["FEN"], F.lit("")) != "")
    g = _mainlines(g, most_plies)
    g = reject.classify(g, [("setup", setup), ("empty", F.size("toks") == 0), ("illegal", F.col("san").isNull())])
    g = g.withColumn("san", F.slice("san", 1, most_plies)).withColumn("line", X.line_key(F.col("san")))
    firsts = g.filter("reject is null").groupBy("line").agg(F.min(F.struct("src_rank", "seq")).alias("first"))
    joined = g.join(firsts, "line", "left")
    status = F.when(F.col("reject").isNull(), F.when(F.col("first") == F.struct("src_rank", "seq"), "kept").otherwise("duplicate"))
    return joined.withColumn("status", status).drop("first")


def append_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """base lines (line, edges, src_rank, seq) and the overlay's kept lines that base lacks; twice is the same as once."""
    new = overlay.filter("status = 'kept'").join(base.select("line").distinct(), "line", "left_anti")
    return base.select("src_rank", "seq", "line", "edges").unionByName(new.select("src_rank", "seq", "line", "edges"))


def overlay_contribution(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """One row: contributed (lines added), covered (lines that base has), new_edges (positions and moves that base lacks)."""
    kept = overlay.filter("status = 'kept'")
    known = base.select("line").distinct().withColumn("known", F.lit(True))
    lines = kept.join(known, "line", "left").agg(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("contributed"), F.sum(F.when(F.col("known"), 1).otherwise(0)).alias("covered"))
    edges = lambda df: df.select(F.explode("edges").alias("e")).select("e.a", "e.b", "e.move").distinct()
    fresh = edges(kept).join(edges(base), ["a", "b", "move"], "left_anti").agg(F.count("*").alias("new_edges"))
    return lines.crossJoin(fresh)  # one row each
