"""From raw documents to shards of a training corpus.

Each stage takes what its predecessor kept, written as Parquet in the shared folder and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontamination, languages, mixing, near_duplicates, sharding
from ledgerloom.llm.common import is_held_out, stored, table
from ledgerloom.llm.queries import TARGETS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too far from every language, go."""
    return languages.keep_identified(docs, ~is_held_out(5, 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_duplicates.keep_first(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a share of benchmark passages go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Low and toxic documents are thinned to their shares; likely good ones all stay, once."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, labelled, TARGETS, anchor="good", protect="good", most=1.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, shards=40)


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

# centroids, signatures and fitted rates have no SQL; the tests hold a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
