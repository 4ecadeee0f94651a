"""In-run dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.functions.keyed import last, walk_keys


def mark_repeats(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Add `is_repeat`: the record has the same version as the record of its key just before it in the run.

    Only the immediately preceding record counts: a version that comes back after another one is not a repeat.
    """

    def body(walk, rows: DataFrame) -> DataFrame:
        rows = walk.before(rows, _previous=last(F.col("source_updated_at")))
        repeat = F.coalesce(F.col("source_updated_at") == F.col("_previous"), F.lit(False))
        return rows.withColumn("is_repeat", repeat).drop("_previous")

    return walk_keys(records, ["feed", "business_key"], "arrival_seq", body, limit)


def dedup_in_run(records: DataFrame, limit: int | None = None) -> DataFrame:
    """The records a run processes: repeats are counted as skipped and go no further."""
    return mark_repeats(records, limit).where(~F.col("is_repeat")).drop("is_repeat")
