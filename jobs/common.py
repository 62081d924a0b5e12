"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings(name: str, path: str | None = None) -> dict:
    """A job's settings: the file of its name beside it, in which another file's entries take precedence."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as f:
        found = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            found |= json.load(f)
    return found


def command_line(name: str, source: str, run) -> None:
    """run(session, input path, output path, settings) in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__.split("\n")[0])
    parser.add_argument(source, help="path of the table that is read")
    parser.add_argument("out", help="folder that the job owns; later runs take the same")
    parser.add_argument("--config", help="JSON file with settings other than the job's own")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, getattr(given, source), given.out, settings(name, given.config))
    finally:
        spark.stop()
