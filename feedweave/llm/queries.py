"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm import (
    collocations,
    decontamination,
    minhash_dedup,
    mixing,
    neighbours,
    periodic_runs,
    quality,
    sharding,
    simhash_dedup,
    substring_dedup,
    suffix_dedup,
    token_counts,
    warc,
)
from feedweave.llm.common import table
from feedweave.llm.oracles import ORACLES  # noqa: F401


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digest(suffix_dedup.remove_repeats(docs))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.digest(substring_dedup.remove_repeated_words(docs))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.inline("matches"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.mark_near_duplicates(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    draws = {"blocks": "draws.block", "shards": "draws.shard", "places": "draws.place"}
    return mixed.select("doc_id", "size", "source_size", "target", "taken", *[F.col(c).alias(n) for n, c in draws.items()])


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.mark_simhash_duplicates(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digest(
        periodic_runs.collapse_runs(docs, key="doc_id", change=periodic_runs.with_periods)
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_substring_dedup,
        op3_quality,
        op4_sharding,
        op5_token_counts,
        op6_decontamination,
        op7_minhash_dedup,
        op8_warc,
        op9_mixing,
        op10_neighbours,
        op11_collocations,
        op12_simhash_dedup,
        op13_periodic_runs,
    )
}
