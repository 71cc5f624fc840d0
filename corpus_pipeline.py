"""Corpus pipeline: quality, near-duplicates, personal data, packing.

Every stage works on what its predecessor kept. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import jaccard_join, packing, pii, quality_classifier, quality_rules
from palisade.llm.common import table
from palisade.llm.queries import BYTE_BPE
from palisade.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return quality_classifier.accepted(docs)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    return quality_rules.accepted(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near-copies stays."""
    return jaccard_join.without_copies(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens, none across documents."""
    return packing.pieces(docs, BYTE_BPE)


STAGES = [
    ("quality classifier", keep_good),
    ("quality rules", keep_by_rules),
    ("n-gram Jaccard join", keep_one_of_each),
    ("personal data", hide_personal_data),
    ("packing", pack),
]

#: No SQL: the classifier and the tagger are trained, the tokens come from a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
