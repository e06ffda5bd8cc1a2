"""The corpus pipeline: quality rules, line deduplication, near-duplicate removal, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

Defined results
---------------
* Null and blank texts fail the quality rules and go in the first stage. A stage on its own takes them: a null text is one empty line,
  all blank texts are copies of one another, and they have no words to mix.
* Rows with null or repeated ids are rows like others; what tells them apart is their text. Repeated rows are near copies: one stays.
  Ties go by id, null last, then by a hash of the row.
* Texts are taken whole, however long. Further columns of documents come back as they were, whatever their names; n_chars follows the
  text where lines went. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines, mixing, quality, sentencepiece, simhash
from .common import checkpoint_dir, read_table, set_aside


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go from every text; n_chars follows."""
    own, back = set_aside(docs, ("doc_id", "text"))
    kept = [F.col("kept_text").alias("text") if c == "text" else F.col(c) for c in own.columns]
    found = lines.line_dedup(own).select(*kept).withColumnsRenamed(back)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return simhash.drop_near_duplicates(docs).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: a document comes as often as the mix takes it."""
    return mixing.take_mix(docs).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    ids = sentencepiece.encode(docs.select("doc_id", "source", "text"))
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece", token_stage),
]
#: The near-duplicate and token stages can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared checkpoint folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
