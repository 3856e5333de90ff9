"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns the packed
pieces. Stages work on all that their predecessor kept. Null and empty texts, repeated rows, empty tables and further
columns are handled as the stages' operators say; further columns are kept.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportweave.llm import decontaminate, line_dedup, minhash_dedup, packing, quality
from reportweave.llm.common import materialize, read_table


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keeping_columns(stage):
    """The stage on documents whose further columns have names that can't clash with those of operators."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        inner = docs.toDF(*[n if n in COLUMNS else f"further_{i}" for i, n in enumerate(names)])
        return stage(spark, inner, sf_dir).select(*inner.columns).toDF(*names)

    return run_stage


@_keeping_columns
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model, keep=docs.columns).filter("predicted = 1")


@_keeping_columns
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that nearly repeat an earlier one; n_chars follows the text."""
    out = line_dedup.drop_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


@_keeping_columns
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.keep_one(docs)


@_keeping_columns
def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark"), keep=docs.columns).filter("not contaminated")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("leaks", leak_stage),
    ("packing", packing_stage),
]

#: None: SQL expresses neither the classifier nor best-fit; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
