"""The jobs as queries: each runs twice over a whole table into a new folder of the shared one; its output as it then stands is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import move_evidence, raw_records
from jobs.common import settings
from tabiya.session import shared_dir


def _twice(spark: SparkSession, job, name: str, source: str) -> DataFrame:
    out = f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"
    for _ in range(2):
        job.run(spark, source, out, settings(name))
    return job.read(spark, out)


def job1_raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, raw_records, "raw_records", f"{sf_dir}/documents.parquet")


def job2_move_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, move_evidence, "move_evidence", f"{sf_dir}/lineitem.parquet")


QUERIES = {f.__name__: f for f in (job1_raw_records, job2_move_evidence)}
ORACLES = {
    "job1_raw_records": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, coalesce(lang, '*') AS result, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), c AS (
  SELECT *, len(words)::INTEGER AS n_words, substr(sha256(array_to_string(words, chr(31)) || '|' || result || '|standard'), 1, 32) AS sig,
    CASE WHEN len(words) = 0 THEN 'empty' WHEN len(words) < 24 THEN 'short' END AS reject,
    CASE WHEN regexp_full_match(source, '[A-Za-z0-9._-]+') THEN source
      ELSE regexp_replace(coalesce(source, ''), '[^A-Za-z0-9._-]', '_', 'g') || '_' || substr(sha256(coalesce(source, 'null')), 1, 8) END AS shelf FROM w
), f AS (
  SELECT *, min(doc_id) OVER (PARTITION BY sig, shelf, reject) AS own, min(shelf) OVER (PARTITION BY sig, reject) AS best FROM c
), k AS (
  SELECT *, CASE WHEN reject IS NOT NULL THEN 'rejected' WHEN doc_id <> own THEN 'local' WHEN shelf = best THEN 'kept' ELSE 'cross' END AS fate FROM f
)
SELECT doc_id AS seq, source, n_words, reject, CASE WHEN reject IS NULL THEN sig END AS sig, CASE WHEN fate = 'kept' THEN text END AS text, fate, shelf FROM k
""",
    "job2_move_evidence": """
WITH o AS (
  SELECT l_suppkey AS position, l_linenumber AS move, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS outcome FROM lineitem
), t AS (
  SELECT position, move, count(*) FILTER (WHERE outcome = 1) AS w, count(*) FILTER (WHERE outcome = 2) AS d, count(*) FILTER (WHERE outcome = 3) AS l FROM o GROUP BY position, move
), s AS (
  SELECT *, w + d + l AS n, w + l AS decisive, (w + 0.5::DOUBLE * d + 1) / (w + d + l + 2)::DOUBLE AS score FROM t
), q AS (
  SELECT *, max(score) OVER (PARTITION BY position) AS best FROM s WHERE n >= 32 AND decisive >= 4
), p AS (
  SELECT position, move, row_number() OVER (PARTITION BY position ORDER BY score DESC, n DESC, move) AS rn FROM q WHERE score >= best - 0.035::DOUBLE
)
SELECT s.position::BIGINT AS position, s.move::BIGINT AS move, w, d, l, n, decisive, score, CASE WHEN rn <= 2 THEN rn::INTEGER END AS rn, (s.position % 16)::INTEGER AS shard
FROM s LEFT JOIN p ON s.position = p.position AND s.move = p.move
""",
}
