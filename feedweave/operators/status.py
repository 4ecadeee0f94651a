"""Operational views over the run log and the lifecycle tables.

All of them aggregate before they join: what is joined has one row per registered feed.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions.ordering import rows_at
from feedweave.functions.text import whole_seconds
from feedweave.operators.drift import severity
from feedweave.operators.runs import FAILED, PARTIAL, RUNNING, SUCCEEDED

# Health states, the staleness limit, bounds of a result page, length of the chart series.
HEALTHY, STALE, DRIFT, FAILING, NEVER_RUN = "HEALTHY", "STALE", "DRIFT", "FAILING", "NEVER_RUN"
STALE_AFTER = timedelta(minutes=5)
MAX_PAGE = 200
SERIES_LENGTH = 30

COMPLETED = (SUCCEEDED, PARTIAL)


def _instant(at: datetime | str) -> Column:
    return F.lit(at).cast("timestamp")


def _latest_runs(runs: DataFrame) -> DataFrame:
    """Per feed the last run, the last completed one, and whether one is running: one mergeable aggregate."""
    row = F.struct(*[F.col(c) for c in runs.columns])
    order = F.struct("started_at", "run_id")
    done = F.col("status").isin(*COMPLETED)
    return runs.groupBy("feed").agg(
        F.max_by(row, order).alias("last_run"),
        F.max_by(row, F.when(done, order)).alias("last_success"),
        F.bool_or(F.col("status") == RUNNING).alias("running"),
    )


def _per_feed(df: DataFrame, condition: Column, name: str) -> DataFrame:
    return df.where(condition).groupBy("feed").agg(F.count(F.lit(1)).alias(name))


def feed_health(
    feeds: DataFrame,
    runs: DataFrame,
    drift: DataFrame,
    quarantine: DataFrame,
    watermarks: DataFrame,
    active: DataFrame,
    as_of: datetime | str,
    stale_after: timedelta = STALE_AFTER,
) -> DataFrame:
    """One row per registered feed (feed, protocol). `active` is the live-row count per feed.

    First match decides: never run, last finished run failed, open drift, no success or too long ago, healthy.
    """
    joined = feeds
    for per_feed in (
        _latest_runs(runs),
        _per_feed(drift, F.col("status") == "OPEN", "open_drift"),
        _per_feed(quarantine, F.col("status") == "OPEN", "open_quarantine"),
        watermarks.select("feed", F.col("watermark_ts").alias("watermark")),
        active,
    ):
        joined = joined.join(per_feed, "feed", "left")
    finished = F.when(F.col("last_run.status") != RUNNING, F.col("last_run"))
    freshness = whole_seconds(F.col("last_success.finished_at"), _instant(as_of))
    open_drift = F.coalesce("open_drift", F.lit(0))
    late = freshness.isNull() | (freshness > int(stale_after.total_seconds()))
    health = (
        F.when(F.col("last_run").isNull(), F.lit(NEVER_RUN))
        .when(finished["status"] == FAILED, F.lit(FAILING))
        .when(open_drift > 0, F.lit(DRIFT))
        .when(late, F.lit(STALE))
        .otherwise(F.lit(HEALTHY))
    )
    return joined.select(
        "feed",
        "protocol",
        health.alias("health"),
        F.coalesce("running", F.lit(False)).alias("running"),
        "watermark",
        "last_run",
        "last_success",
        freshness.alias("freshness_seconds"),
        F.coalesce(finished["max_lag_seconds"], F.col("last_success.max_lag_seconds")).alias("lag_seconds"),
        open_drift.alias("open_drift_events"),
        F.coalesce("open_quarantine", F.lit(0)).alias("open_quarantine"),
        F.coalesce("active_records", F.lit(0)).alias("active_records"),
    )


def feed_freshness(runs: DataFrame, as_of: datetime | str) -> DataFrame:
    """Whole seconds since the last completed run of each feed finished; not clamped, null if there is none."""
    return _latest_runs(runs).select(
        "feed",
        whole_seconds(F.col("last_success.finished_at"), _instant(as_of)).alias("freshness_seconds"),
    )


def feed_lag(runs: DataFrame) -> DataFrame:
    """Largest lag of the last finished run if it loaded something, else of the last completed run."""
    finished = F.when(F.col("last_run.status") != RUNNING, F.col("last_run.max_lag_seconds"))
    return _latest_runs(runs).select(
        "feed", F.coalesce(finished, F.col("last_success.max_lag_seconds")).alias("lag_seconds")
    )


def feed_summary(health: DataFrame) -> DataFrame:
    """What a feed card shows."""
    last = "last_run"
    return health.select(
        "feed",
        "protocol",
        "health",
        "running",
        F.col(f"{last}.run_id").alias("last_run_id"),
        F.col(f"{last}.status").alias("last_status"),
        F.coalesce(f"{last}.finished_at", f"{last}.started_at").alias("last_activity"),
        *[F.col(f"{last}.{c}").alias(f"last_{c}") for c in ("extracted", "loaded", "skipped", "quarantined")],
        "freshness_seconds",
        "lag_seconds",
        "watermark",
        "active_records",
        "open_drift_events",
        "open_quarantine",
    )


def overview_totals(runs: DataFrame, quarantine: DataFrame, drift: DataFrame, feeds: DataFrame) -> DataFrame:
    """Totals over all runs; open rows are counted over registered feeds only."""
    registered = feeds.select("feed").distinct()

    def open_count(df: DataFrame) -> Column:
        mine = df.where(F.col("status") == "OPEN").join(F.broadcast(registered), "feed", "left_semi")
        return mine.agg(F.count(F.lit(1))).scalar()

    status = F.col("status")
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(status == SUCCEEDED).alias("succeeded"),
        F.count_if(status == PARTIAL).alias("partial"),
        F.count_if(status == FAILED).alias("failed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("loaded", "skipped", "quarantined")],
    ).select(
        "*", open_count(quarantine).alias("open_quarantine"), open_count(drift).alias("open_drift_events")
    )


def _mean_seconds(start: str, end: str) -> Column:
    """Mean of whole seconds not below zero, cut to whole seconds; rows without both ends do not count."""
    seconds = F.greatest(F.lit(0), whole_seconds(F.col(start), F.col(end)))
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    return F.floor(F.avg(F.when(known, seconds))).cast("bigint")


def mttd(drift: DataFrame) -> DataFrame:
    """Mean time between a source change and its detection."""
    return drift.agg(_mean_seconds("source_changed_at", "detected_at").alias("mttd_seconds"))


def mttr(drift: DataFrame) -> DataFrame:
    """Mean time between detection and resolution."""
    return drift.agg(_mean_seconds("detected_at", "resolved_at").alias("mttr_seconds"))


def _page(df: DataFrame, newest: str, then: str, page: int, size: int) -> DataFrame:
    """One page of a listing with its page facts. The first pages are a top-k; those far back are found by their rank."""
    if page < 0 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page must not be negative and size must be between 1 and {MAX_PAGE}")
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        rows_at(df, newest, then, page * size, size)
        .orderBy(F.desc_nulls_last(newest), F.asc(then))
        .withColumns(
            {
                "page": F.lit(page),
                "size": F.lit(size),
                "total_elements": total,
                "total_pages": F.ceil(total / F.lit(size)).cast("bigint"),
            }
        )
    )


def list_runs(runs: DataFrame, feed: str | None = None, page: int = 0, size: int = 20) -> DataFrame:
    """Runs, newest first."""
    if feed is not None:
        runs = runs.where(F.col("feed") == feed)
    # Whole milliseconds of the elapsed time, not the difference of two rounded clocks.
    millis = F.floor((F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1000)).cast("bigint")
    return _page(runs, "started_at", "run_id", page, size).withColumn("duration_ms", millis)


def list_quarantine(
    quarantine: DataFrame, feed: str | None = None, status: str = "OPEN", page: int = 0, size: int = 20
) -> DataFrame:
    """Quarantined records of a status, newest first."""
    rows = quarantine.where(F.col("status") == status)
    if feed is not None:
        rows = rows.where(F.col("feed") == feed)
    return _page(rows, "quarantined_at", "quarantine_id", page, size)


def list_drift(drift: DataFrame, status: str | None = None, page: int = 0, size: int = 20) -> DataFrame:
    """Drift events, newest first, with severity and the times to detect and to resolve."""
    rows = drift if status is None else drift.where(F.col("status") == status)

    def clamped(start: str, end: str) -> Column:
        seconds = whole_seconds(F.col(start), F.col(end))
        return F.when(seconds.isNotNull(), F.greatest(F.lit(0), seconds))

    return _page(rows, "detected_at", "event_id", page, size).withColumns(
        {
            "severity": severity(F.col("kind")),
            "time_to_detect_seconds": clamped("source_changed_at", "detected_at"),
            "time_to_resolve_seconds": clamped("detected_at", "resolved_at"),
        }
    )


def run_series(runs: DataFrame, n: int = SERIES_LENGTH) -> DataFrame:
    """The latest n runs, oldest first."""
    latest = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)
    return latest.select("run_id", "started_at", "feed", "loaded", "skipped", "quarantined", "max_lag_seconds").orderBy(
        "started_at", "run_id"
    )


def lag_series(runs: DataFrame, feeds: list[str], n: int = SERIES_LENGTH) -> DataFrame:
    """The latest n runs with one lag column per feed; a run that loaded nothing leaves a gap."""
    columns = [F.when(F.col("feed") == feed, F.col("max_lag_seconds")).alias(f"lag_{feed}") for feed in feeds]
    return run_series(runs, n).select("run_id", "started_at", *columns)
