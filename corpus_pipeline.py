"""The corpus pipeline: clean, deduplicate, decontaminate and pack ``documents``.

Every stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept and returns the columns of ``docs``; the last returns the
packed pieces with their ids. Nulls, ties and repeated rows are treated as the
operators say: texts that are null or empty pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillscope.llm.common import land, table
from tillscope.llm.decontamination import drop_contaminated
from tillscope.llm.jaccard import keep_one
from tillscope.llm.line_dedup import line_dedup
from tillscope.llm.packing import pack_documents
from tillscope.llm.queries import TOKENIZER
from tillscope.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go."""
    return drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows are cut from the texts."""
    return line_dedup(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word n-grams, Jaccard 0.8."""
    return keep_one(spark, docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a template window with the benchmark go."""
    return drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences, with their ids."""
    return pack_documents(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier and the tokenizer have no SQL; tests/llm holds each stage
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each stage's rows are landed and
    read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
