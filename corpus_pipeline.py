"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, tokenization.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last keep the columns of ``documents``; ``n_chars``
follows the text. The mix repeats the rows that it takes twice.

Defined cases, stage by stage: a null or empty text fails the quality rules' ten words and goes there, so later stages see
none; a text that loses all its lines is empty from then on, stays, and gives no tokens; rows without doc_id
stay through the stages (no copy is told without one); a null source is a source of its own; repeated rows stay or go
together, and the near-duplicate stage keeps them as one document's rows; an empty table passes through all stages; very long
texts are worked on whole; columns beside those of ``documents`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import jaccard, linededup, mixing, pieces, quality
from barweave.llm.common import written
from barweave.llm.queries import PIECES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the learned list go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return jaccard.keep_one(docs, k=5, num=80).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it."""
    mixed = mixing.mix(docs)
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return pieces.encode(docs, PIECES, with_ids=True)


STAGES = [
    ("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard", jaccard_stage),
    ("source_mixing", mixing_stage), ("sentencepiece", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned rules and the mix have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
