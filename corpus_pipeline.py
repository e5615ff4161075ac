"""Training-corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
A stage keeps the columns of documents, except the last, which returns the pieces of packed sequences.

A document is a row: rows that share a doc_id, or have none, are judged each by its own text. Where documents are
compared they come in order of doc_id, those without one last, and of the same id by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import quality_cnn, toxicity_cnn
from skyweave.llm.common import table, written
from skyweave.llm.jaccard_join import jaccard_components
from skyweave.llm.packing import pack
from skyweave.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 4)."""
    return quality_cnn.quality_scores(docs, table(spark, sf_dir, "labels"), carried=COLUMNS).where("predicted = 1").select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not flag (operator 9)."""
    return toxicity_cnn.toxicity_scores(docs, table(spark, sf_dir, "labels"), carried=COLUMNS).where("predicted = 0").select(COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with a number of their own (row), in order; written once, so that it stays the same."""
    order = [F.asc_nulls_last("doc_id"), F.asc(F.xxhash64("text"))]
    rows = docs.select(COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first document (operator 10)."""
    docs = _numbered(docs)
    kept = jaccard_components(docs.select(F.col("row").alias("doc_id"), "text")).where("doc_id = component_id")
    return docs.join(kept.select(F.col("doc_id").alias("row")), "row", "left_semi").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what earlier documents have (operator 1); a document of which nothing is left goes."""
    docs = _numbered(docs).select(F.col("row").alias("doc_id"), "text", F.col("doc_id").alias("id"), "lang", "source", F.col("text").isNull().alias("no_text"))
    kept = suffix_dedup(docs, texts=True, carried=("id", "lang", "source", "no_text")).where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    text = F.when(~F.col("no_text"), F.col("kept"))
    n_chars = F.coalesce(F.length(text).cast("long"), F.lit(0).cast("long"))
    return kept.select(F.col("id").alias("doc_id"), text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens (operator 8)."""
    return pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # fitted classifiers and a tokenizer: tested against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
