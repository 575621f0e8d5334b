"""Corpus pipeline over ``documents``: every stage is written as Parquet and read again by the next one.

All stages but the last return the columns of ``documents``: toxic documents go, lines that repeat earlier ones go from
the texts, one document of each group of near duplicates stays, documents that hold benchmark items go, and the rest is
tokenised and packed.

A stage begins by deleting what the stages before it wrote for themselves, as their rows are written by then; tables that
its ``docs`` read are kept.

Every stage takes null and empty texts, null ids, repeated rows, texts of any length, empty tables and columns of any
name; what it then does is said below. Ties go to the smaller id or to the earlier line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spreadloom.llm import decontaminate, line_dedup, minhash, packing, toxicity
from spreadloom.llm.common import table, tidy, written
from spreadloom.llm.tokens import default_vocabulary


@tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted as toxic go. Null and empty texts have the score of no evidence and stay; repeated rows stay or go
    together; without labels of both kinds none goes."""
    return toxicity.keep_clean(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


@tidy
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go from texts; all rows stay. Rows without id or text are left as they are; rows
    that repeat an id share decisions, line by line."""
    return line_dedup.deduplicate_lines(docs)


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links join the one with the smallest id stays, of rows that repeat an id one; rows without words or
    without an id stay."""
    return minhash.keep_first(docs)


@tidy
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; rows without id or text stay; an empty benchmark drops none."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place; null and empty texts are their end id alone; null ids and
    repeated rows are packed as they are; no rows give none."""
    return packing.pack(docs, default_vocabulary()).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
