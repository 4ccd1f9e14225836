"""A training corpus from documents: rejected texts, near duplicates and contaminated texts go, the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnpike.llm._shared import table, written
from tarnpike.llm.decontamination import decontaminated
from tarnpike.llm.jaccard import near_duplicates_dropped
from tarnpike.llm.piece_codec import encode_pieces
from tarnpike.llm.quality import accepted, fit_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from labelled rows of its input that are not held out; see ``accepted``
    for nulls, repeated rows and empty tables."""
    return accepted(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more: that of the smallest id. Null ids, texts without
    words and repeated rows of one id all stay; an empty table gives an empty one."""
    return near_duplicates_dropped(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items; null texts, null ids and repeated rows stay unless they are."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document, none for null and empty texts; null ids and repeated rows stay as they came."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: the classifier is no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
