"""Job: keeps the win, draw and loss evidence of every position and move, and the preferred moves, as files of games arrive.

A stream over the input folder takes the files that no earlier run took (its checkpoint holds them) in batches. Each batch is reduced to tallies, which
replace whatever an earlier attempt at the same batch wrote; tallies add up, so the moves are made anew from them. Under `out`:
    checkpoint  the stream's own
    tallies     batch= : wins, draws and losses of each position and move in one batch
    moves       shard= : n, decisive, score and, for preferred moves, rank, over all batches
A run without new files changes nothing; one that was broken off is finished by the next. Rows without a position or move are tallied under null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from tabiya.operators import preference

TALLIES = "position long, move long, w long, d long, l long"
MOVES = "position long, move long, w long, d long, l long, n long, decisive long, score double, rn int, shard int"


def tallies(games: DataFrame, config: dict) -> DataFrame:
    outcome = F.when(F.col(config["outcome"]) == config["won"], 1).when(F.col(config["outcome"]) == config["drawn"], 2).otherwise(3)
    seen = games.select(F.col(config["position"]).cast("long").alias("position"), F.col(config["move"]).cast("long").alias("move"), outcome.alias("outcome"))
    return preference.tally(seen, ["position"], "move", "outcome").select("position", "move", "w", "d", "l")


def moves(parts: DataFrame, config: dict) -> DataFrame:
    """All moves over all batches, with the rank of preferred ones."""
    sums = parts.groupBy("position", "move").agg(*(F.sum(x).alias(x) for x in "wdl"))
    stats = preference.with_score(sums)
    evidence = preference.Evidence(config["least_games"], config["least_decisive"], config["window"], config["top"])
    best = preference.preferred(stats, ["position"], "move", evidence).select(F.col("position").alias("p"), F.col("move").alias("m"), "rn")
    found = stats.join(best, F.col("position").eqNullSafe(F.col("p")) & F.col("move").eqNullSafe(F.col("m")), "left")
    return found.select("position", "move", "w", "d", "l", "n", "decisive", "score", "rn", F.pmod(F.coalesce("position", F.lit(0)), F.lit(config["shards"])).cast("int").alias("shard"))


def read(spark: SparkSession, out: str) -> DataFrame:
    """The moves as they stand."""
    return spark.read.schema(MOVES).parquet(f"{out}/moves")


def run(spark: SparkSession, games: str, out: str, config: dict) -> None:
    """Adds the evidence of game files that no earlier run took, and ranks the moves."""
    taken = []

    def add(batch: DataFrame, k: int) -> None:
        path = f"{out}/tallies/batch={k}"
        tallies(batch, config).write.mode("overwrite").parquet(path)
        seen = batch.sparkSession.read.schema(TALLIES).parquet(path).agg(F.sum(F.col("w") + F.col("d") + F.col("l")), F.count("*")).first()
        taken.append(k)
        log.info("batch %d: read %d rows of %s, wrote %d tallies to %s", k, seen[0] or 0, games, seen[1], path)

    games = games.rstrip("/")
    found = f"{games[:-1]}[{games[-1]}]"  # as a pattern, which a stream also takes for a single file
    stream = spark.readStream.schema(spark.read.parquet(games).schema).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(found)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema(TALLIES).parquet(f"{out}/tallies")
    moves(parts, config).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{out}/moves")
    log.info("took %d new batches; wrote %d rows to %s/moves", len(taken), read(spark, out).count(), out)


if __name__ == "__main__":
    command_line("move_evidence", "games", run)
