"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. run() applies them to the documents table and writes what each but the last returns to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm import common, line_dedup, mixing, ngram_join, packing, quality, tokens

#: A document stays if the classifier gives it at least this score.
LEAST_SCORE = 0.7


@common.scoped
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of documents that are there, doesn't reject.

    Null and empty texts are scored as ''; texts are scored whole. Equal texts have equal scores, so ties and repeated rows stay or go
    together. Without documents with labels every score is 0.5, so all go; an empty table stays empty. All columns stay as they are.
    """
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    (own,) = common.own_names(docs, 1)
    found = quality.score(docs, quality.train(docs, labels), column=own)
    return found.filter(F.col(own) >= LEAST_SCORE).select(*map(common.quoted, docs.columns))


@common.scoped
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, but for a few edits of bytes or words; those that held nothing else go.

    Null and empty texts stay. Lines are in order of (doc_id, a hash of the text, line number), so ties go by content, and rows that repeat
    doc_id and text get one decision. Lines and texts may be of any length. An empty table stays empty. All columns stay; only text and n_chars change.
    """
    common.ship(spark)
    return line_dedup.without_repeated_lines(docs, per=line_dedup.PER)


@common.scoped
def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, by (doc_id, a hash of the text), null ids first; of rows that repeat both, one.

    Rows without words (null or empty texts) all stay. Texts are compared whole. An empty table stays empty. All columns stay as they are.
    """
    common.ship(spark)
    return ngram_join.one_of_each(docs)


@common.scoped
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts have no words and go. Rows that repeat doc_id and size share their rank and stand together; null sources are one
    source. Texts may be of any length. An empty table stays empty. All columns stay as they are.
    """
    common.ship(spark)
    return mixing.take_mix(docs)


@common.scoped
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id alone; long texts have several pieces; repeated rows are packed each time. An empty
    table gives no rows. Other columns are left out.
    """
    common.ship(spark)
    return packing.pack_documents(docs, tokens.Vocabulary(spark))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


@common.scoped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.release(common.cut(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
