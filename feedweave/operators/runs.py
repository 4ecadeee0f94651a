"""The run log: counters and status of a run from the results of its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions.text import whole_seconds

# What became of a record, run states, width of a stored error.
LOADED, SKIPPED, QUARANTINED, REPEATED = "LOADED", "SKIPPED", "QUARANTINED", "REPEATED"
SUCCEEDED, PARTIAL, FAILED, RUNNING = "SUCCEEDED", "PARTIAL", "FAILED", "RUNNING"
ERROR_WIDTH = 2000

SCHEMA = (
    "run_id string, feed string, mode string, trigger_type string, status string, started_at timestamp, "
    "finished_at timestamp, extracted bigint, transformed bigint, loaded bigint, skipped bigint, quarantined bigint, "
    "failed bigint, drift_detected boolean, watermark_before timestamp, watermark_after timestamp, "
    "backfill_from timestamp, backfill_to timestamp, max_lag_seconds bigint, error_message string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
COUNTERS = ["extracted", "transformed", "loaded", "skipped", "quarantined", "failed"]


def run_counters(record_results: DataFrame) -> DataFrame:
    """Counters per run from rows (run_id, feed, fate, drift_detected, source_updated_at, processed_at).

    Repeats count as extracted and skipped but not as transformed. Lag is taken over loaded records only, not below
    zero. Nothing ever counts as failed.
    """
    fate = F.col("fate")
    lag = F.when(fate == LOADED, F.greatest(F.lit(0), whole_seconds(F.col("source_updated_at"), F.col("processed_at"))))
    return record_results.groupBy("run_id", "feed").agg(
        F.count(F.lit(1)).alias("extracted"),
        F.count_if(fate.isin(LOADED, SKIPPED)).alias("transformed"),
        F.count_if(fate == LOADED).alias("loaded"),
        F.count_if(fate.isin(SKIPPED, REPEATED)).alias("skipped"),
        F.count_if(fate == QUARANTINED).alias("quarantined"),
        F.lit(0).cast("bigint").alias("failed"),
        F.bool_or("drift_detected").alias("drift_detected"),
        F.max(lag).alias("max_lag_seconds"),
    )


def run_status(quarantined: Column, failure: Column) -> Column:
    """FAILED when the read failed, PARTIAL when something was quarantined, else SUCCEEDED."""
    return (
        F.when(failure.isNotNull(), F.lit(FAILED)).when(quarantined > 0, F.lit(PARTIAL)).otherwise(F.lit(SUCCEEDED))
    )


def error_text(failure: Column) -> Column:
    return F.left(failure, F.lit(ERROR_WIDTH))
