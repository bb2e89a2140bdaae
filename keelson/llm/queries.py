"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import decontam, langid, media, mixing, ngram, paragraphs, pii, quality, simhash, warc
from keelson.llm.common import table


def op1_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by votes of labelled neighbours; nulls and empties as in ``quality.classify``."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their sources mixed to weights 3, 1, 2 in turn; nulls and empties as in ``mixing.mix``."""
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document; nulls and empties as in ``simhash.near_duplicates``."""
    m = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return m.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image, stored in archives and read back; nulls and empties as in ``media.media_columns``."""
    return media.media_columns(table(spark, sf_dir, "documents"))


def op5_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of every document by a trie of six folds of seven; smoothed by add-one words; nulls and empties as in ``ngram.score``."""
    return ngram.cross_scored(table(spark, sf_dir, "documents"))


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in two replicas, one of which decays in every 97th page, audited; nulls as in ``warc.fixity_drill``."""
    return warc.fixity_drill(table(spark, sf_dir, "pages"), F.coalesce(F.col("page_id") % 97 == 5, F.lit(False)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of four folds of five; nulls and empties as in ``langid.identify``."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 20 words or more that several documents have, with its class; nulls and empties as in ``paragraphs.repeats``."""
    return paragraphs.repeats(table(spark, sf_dir, "documents")).drop("rid")


def op9_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document; nulls and empties as in ``decontam.contamination``."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; nulls and empties as in ``pii.personal_data``."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_neighbours, op2_pivotal_mix, op3_simhash_near_dup, op4_media_archives, op5_elias_fano_lm, op6_merkle_fixity, op7_language_id, op8_paragraph_banding, op9_suffix_decontam, op10_contextual_pii)}

ORACLES: dict[str, str] = {
    "op6_merkle_fixity": """
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes, sha256(coalesce(html, '')) AS block_sha256,
               true AS intact, coalesce(page_id % 97 = 5, false) AS differs
        FROM pages
    """,
}
