"""A training-text pipeline of five corpus operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next. Null texts and empty tables
pass through every stage as its operator defines; columns beyond those of
``documents`` are carried along to the last stage, whose rows are the mix: how
many words of each document left it takes, repeats counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import decontam, langid, mixing, pii, simhash
from keelson.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is less likely than not, go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; every document stays."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document left, its sources weighing 3, 1, 2 in turn."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("language_id", identify_language), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", redact_personal_data), ("mixing", mix_sources)]

#: Fingerprint components and dependent draws are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each over all that the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
