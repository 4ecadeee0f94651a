"""From documents to training shards: filter, deduplicate, decontaminate, mix and shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm import (
    decontamination,
    minhash_dedup,
    mixing,
    quality,
    sharding,
)
from feedweave.llm.common import Aside, column, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels, does not reject."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*map(column, docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of the smallest doc_id, if any row has one."""
    return minhash_dedup.one_of_each(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that copies a test item."""
    marked = decontamination.mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("matches") == 0).select(*map(column, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, each task's documents by the mix's shards and their places there.

    A document cut at the end of a quota comes along if at least half of it is taken.
    """
    aside = Aside(docs.columns)
    mixed = mixing.mix(docs.select(*aside.out(), *map(column, ("source", "text", "doc_id"))), carry=aside.inner)
    return mixing.drawn(mixed, least_share=0.5, whole_shards=False).select(*aside.back())


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of nearly equal bytes, with each document's slot."""
    return sharding.shard_by_bytes(docs).drop("law", "grown_shard")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Learnt trees, signatures and alignment are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table `documents`; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
