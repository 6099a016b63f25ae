"""A training corpus from ``documents``: five stages, each one operator.

``run`` writes what a stage returns as Parquet in the shared folder and reads it back as
the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm import linededup, mixing, neardup, packing, quality
from palaver.llm.common import load, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Rows are judged one by one by their whole text, so repeated rows stay or go together and
    a null doc_id does no harm. Null and empty texts go, as do those under ten words. All
    columns pass through, whatever their names. An empty table gives no row.
    """
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the one with the largest doc_id.

    No row goes; a null text stays null, and n_chars follows the text. A null doc_id counts
    as the smallest; rows that share the largest doc_id all keep the line. Other columns pass
    through. An empty table gives no row.
    """
    return linededup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    A null doc_id comes last. Of rows with equal doc_id and text one stays. Texts without a
    word are near nothing; each of them stays. All columns pass through. An empty table
    gives no row.
    """
    return neardup.keep_first(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked probabilities.

    Null in source or lang is a level of its own. The draw depends on doc_id alone (on the
    text where that is null), so repeated rows stay or go together. Texts without a word have
    no tokens to weigh and stay. All columns pass through. An empty table gives no row.
    """
    return mixing.sample(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, not the columns of documents.

    Every row is packed, repeated ones each by itself; a null text is one end mark. Documents
    longer than a sequence are cut, with no id lost. An empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Trained trees and tokenizing have no SQL form; a test compares ``run`` with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
