"""Corpus pipeline: quality rules, line dedup, near-duplicate documents, personal data, packing.

Every stage takes odd rows: a null text counts as empty, a null doc_id is an id like any other, repeated rows are rows of their own, lang and
source may be null, texts may be as long as a column's rows and lie in one task whole, an empty table gives an empty one, and
other columns, whatever their names, are handed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import lines, packing, pii, quality, simhash
from netlens.llm.common import begin_scope, end_scope, materialise
from netlens.llm.queries import tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if {"n_chars", "text"} <= set(docs.columns) else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go: those with an empty or null text are among them."""
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line of the corpus matches go; every document stays, if without text; a null text stays null. Of repeated rows with
    one id all keep the same text."""
    return _counted(lines.deduplicated(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id; documents without words have one fingerprint, so one of them
    stays. Of rows that repeat an id one stays."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Addresses and numbers are replaced by their kinds in brackets; every row stays, a null text null."""
    return _counted(pii.masked(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a row without text is one piece of one token, its end."""
    return packing.pack(docs, tokenizer_path())


def _scoped(stage):
    """The stage, in a scope of its own for scratch tables: those of the stage before go, as its result is written by now."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        begin_scope(spark, "pipeline")
        try:
            return stage(spark, docs, sf_dir)
        finally:
            end_scope()

    return run


STAGES = [(name, _scoped(stage)) for name, stage in (("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack))]

#: Estimates, fingerprints and packings cannot be put as SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name, scoped=False)
    return docs
