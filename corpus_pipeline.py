"""A training-corpus pipeline of five stages, each over all that its predecessor kept.

quality -> exact dedup -> near dedup -> PII -> packing.  Each stage takes (spark, docs,
sf_dir); what it returns is written as Parquet and read again as the next one's docs.

Edge cases, for all stages: an empty table gives an empty result; columns go through unchanged, whatever their
names, up to the last stage; null and empty texts are documents like others (the classifier
scores them, they equal each other as exact copies, have no shingles, hold no personal data and
are one end id); a row without an id equals others by its text, and stays where it equals none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import exact_dedup, packing, parity_join, pseudonyms, quality
from quillstack.llm.common import job, pseudonym_key, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, accepts."""
    found = stored(quality.features(docs), "quality-features")
    return quality.kept(docs, quality.fit(found, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: the one with the smallest id."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more: the smallest id."""
    return parity_join.representatives(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms in place of personal data."""
    return pseudonyms.pseudonymised(docs, pseudonym_key(spark), counts=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs)).drop("row_key")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: A fitted classifier and a tokenizer are beyond SQL; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; tables that a stage leaves are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    with job() as tables:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            tables.forget(spark, docs)
    return docs
