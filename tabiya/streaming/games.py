"""Streams of game records: duplicates, evidence by window, error alerts.

State stays bounded: duplicates and windows by a watermark, alerts by one small row per source.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALERT = "source string, seen long, bad_seen long"


def first_of_each(stream: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_tally(stream: DataFrame, position: list[str], move: str, outcome: str, time: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """w, d, l and n of each position and move by window of event time; late rows up to the delay still count."""
    count = lambda k: F.sum(F.when(F.col(outcome) == k, 1).otherwise(0))
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), *position, move)
    return grouped.agg(count(1).alias("w"), count(2).alias("d"), count(3).alias("l"), F.count("*").alias("n"))


def error_alerts(stream: DataFrame, source: str, bad: str, least: int = 100, percent: int = 10) -> DataFrame:
    """A row for each batch of a source after which at least `least` rows were seen and at least `percent` of them were bad."""

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, wrong = state.get if state.exists else (0, 0)
        for frame in frames:
            seen, wrong = seen + len(frame), wrong + int(frame["bad"].sum())
        state.update((seen, wrong))
        if seen >= least and wrong * 100 >= seen * percent:
            yield pd.DataFrame({"source": [key[0]], "seen": [seen], "bad_seen": [wrong]})

    rows = stream.select(F.col(source).cast("string").alias("source"), F.col(bad).alias("bad"))
    return rows.groupBy("source").applyInPandasWithState(update, ALERT, "seen long, bad_seen long", "append", "NoTimeout")
