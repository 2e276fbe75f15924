"""A corpus pipeline: good documents, without shared lines, near copies and benchmark passages, mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's docs, so no lineage spans
two stages. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiercraft.llm import decontaminate, line_dedup, mixing, near_dedup, quality_crf
from tiercraft.llm.text import ship
from tiercraft.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the line classifier, fitted on ``labels``, rejects."""
    return quality_crf.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out lines that a document of a smaller id holds too; drop documents left without a word."""
    cut = line_dedup.dedup_lines(docs, n_lines_col="__n_lines", n_dropped_col="__n_dropped")
    emptied = (F.col("__n_dropped") > 0) & ~F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    return (cut.where(~emptied).withColumn("n_chars", F.when(
        F.col("__n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
        .select(*docs.columns))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8)."""
    ship(spark)
    return near_dedup.near_dedup(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    return decontaminate.decontaminate(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document taken twice is there twice."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", unique_lines),
    ("near dedup", no_near_copies),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
]
#: The classifier and the sketches cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
