"""From raw documents to packed sequences: language, toxicity, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import langid, near_dedup, packing, toxicity
from gridloom.llm.common import materialise, release, scratch, table


# What all stages share: the first three return the rows that stay with all their columns, extra ones and clashing names
# included. A null or empty text is decided on as stated below; very long texts are read whole; of an empty table nothing
# is left. What a stage decides does not depend on the order of the rows.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go: those without a letter (null and empty ones among them), and those
    whose n-grams fit no language that was learnt. Repeated rows and null ids are decided on by their text, like any."""
    return langid.identified_rows(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Null and empty texts have no evidence and stay, unless only toxic labels
    were there to learn from; without labels all stay. Repeated rows go or stay together."""
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles the document of the least id stays; of repeated
    rows one. Texts without words (null, empty) link with nothing and all stay. Null ids come after all others."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 1024 tokens: one row a piece. A null or empty text is its end mark alone,
    longer texts than a sequence are cut, repeated rows are packed each."""
    return packing.pack(docs, added=packing.default_added_tokens())


STAGES = [("language_id", language), ("toxicity", toxic), ("near_dedup", near_duplicates), ("packing", pack)]

#: SQL expresses no stage of this; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():  # what a stage wrote for itself goes as soon as its result is written
            found = stage(spark, docs, sf_dir)
            docs = materialise(found, name, keep=True)
        release(before)
        before = docs
    return docs
