"""Per-feed high-water marks. They select what to read next; they never drop late data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "feed string, watermark_ts timestamp, watermark_key string, updated_at timestamp"


def newest_watermark(records: DataFrame) -> DataFrame:
    """Highest (clock, key) per feed over everything extracted, quarantined and repeated records included."""
    newest = F.max(F.struct("source_updated_at", "business_key"))
    return (
        records.groupBy("feed")
        .agg(newest.alias("_newest"))
        .select(
            "feed",
            F.col("_newest.source_updated_at").alias("watermark_ts"),
            F.col("_newest.business_key").alias("watermark_key"),
        )
    )


def advance_watermark(watermarks: DataFrame, candidates: DataFrame, at: datetime | Column) -> DataFrame:
    """Move marks forward only: a candidate wins if its clock is strictly newer, its key does not count.

    `candidates` (feed, watermark_ts, watermark_key): newest positions of runs that may move the mark.
    """
    now = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    held = watermarks.select("feed", F.struct("watermark_ts", "watermark_key", "updated_at").alias("_held"))
    offered = candidates.select(
        "feed", F.struct("watermark_ts", "watermark_key", now.alias("updated_at")).alias("_offered")
    )
    moves = F.col("_held").isNull() | (F.col("_offered.watermark_ts") > F.col("_held.watermark_ts"))
    chosen = F.when(F.col("_offered").isNotNull() & moves, F.col("_offered")).otherwise(F.col("_held"))
    return held.join(offered, "feed", "full_outer").select("feed", chosen.alias("_mark")).select("feed", "_mark.*")


def may_advance(mode: Column, status: Column, extracted: Column) -> Column:
    """Only incremental runs that did not fail and read at least one record move the mark."""
    return (mode == "INCREMENTAL") & status.isin("SUCCEEDED", "PARTIAL") & (extracted > 0)
