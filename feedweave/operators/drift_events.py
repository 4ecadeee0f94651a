"""Lifecycle of drift events: one open event per distinct finding of a feed."""

from __future__ import annotations

from datetime import datetime
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions.ids import stable_id
from feedweave.operators.drift import ADDED, BLOCKING, FINGERPRINT_WIDTH, WARNING, severity
from feedweave.session import materialize

# States and column widths.
OPEN, RESOLVED = "OPEN", "RESOLVED"
FIELD_WIDTH, VALUE_WIDTH, DETAILS_WIDTH = 128, FINGERPRINT_WIDTH, 1000

SCHEMA = (
    "event_id string, feed string, fingerprint string, kind string, field string, expected string, actual string, "
    "details string, affected_records bigint, first_run_id string, last_run_id string, source_changed_at timestamp, "
    "detected_at timestamp, last_seen_at timestamp, status string, resolved_at timestamp, resolution_note string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Rows with texts that a task sorts at most. Texts have fixed widths, so this bounds its memory.
ROWS_PER_TASK = 200_000
#: Up to so many distinct findings are broadcast without their texts; more are joined by a shuffle.
MOST_BROADCAST = 200_000

__all__ = ["OPEN", "RESOLVED", "BLOCKING", "WARNING", "severity", "ADDED"]


def _moment(at: datetime | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt over tasks by key, as many tasks as their number asks for.

    Tasks cut by size hold too much of texts that shrink well: what counts there is the compressed size.
    """
    return df if rows <= ROWS_PER_TASK else df.repartition(ceil(rows / ROWS_PER_TASK), *keys)


def findings_by_fingerprint(findings: DataFrame) -> tuple[DataFrame, int]:
    """Findings of a batch folded per (feed, fingerprint): count, earliest source change, first finding's texts; and
    how many there are.

    Everything is a mergeable aggregate, so a fingerprint that a third of the records carry is folded before the
    shuffle. It is folded without its texts, which would all be sorted for it; those of the first finding are fetched
    by its place.
    """
    place = ["feed", "fingerprint", "arrival_seq", "finding_no"]
    folded = materialize(
        findings.groupBy("feed", "fingerprint")
        .agg(
            F.count(F.lit(1)).alias("_records"),
            F.min("source_updated_at").alias("_changed"),
            F.min(F.struct("arrival_seq", "finding_no")).alias("_at"),
        )
        # A struct equals another with nulls at the same fields, as a group does.
        .select(F.struct("feed", "fingerprint", "_at.*").alias("_place"), "_records", "_changed")
    )
    distinct, rows = folded.agg(F.count(F.lit(1)), F.coalesce(F.sum("_records"), F.lit(0))).first()
    texts = findings.select(
        # The very type of the other side: a key that is cast for the join would be shuffled once more.
        F.struct(*place).cast(folded.schema["_place"].dataType).alias("_place"),
        F.struct(
            "kind",
            F.left("field", F.lit(FIELD_WIDTH)).alias("field"),
            F.left("expected", F.lit(VALUE_WIDTH)).alias("expected"),
            F.left("actual", F.lit(VALUE_WIDTH)).alias("actual"),
            F.left("details", F.lit(DETAILS_WIDTH)).alias("details"),
        ).alias("_first"),
    )
    if distinct <= MOST_BROADCAST:
        found = texts.join(F.broadcast(folded), "_place")
    else:
        found = _dealt(texts, rows, "_place").join(_dealt(folded, rows, "_place"), "_place")
    # A place is one row, unless a batch brings the same finding twice.
    firsts = found.groupBy("_place").agg(*[F.first(c).alias(c) for c in ("_records", "_changed", "_first")])
    return firsts.select("_place.feed", "_place.fingerprint", "_records", "_changed", "_first"), distinct


def drift_event_upsert(
    events: DataFrame, findings: DataFrame, run_id: str | Column, now: datetime | Column
) -> DataFrame:
    """Record a batch of findings in the event table.

    An open event of the same fingerprint counts them and moves last run and last seen; otherwise a new event opens.
    Resolved events are never reopened: they stay as they are beside the new one.
    """
    run = run_id if isinstance(run_id, Column) else F.lit(run_id)
    seen, distinct = findings_by_fingerprint(findings)
    is_open = events.where(F.col("status") == OPEN)
    closed = events.where(F.col("status") != OPEN)
    keys = ["feed", "fingerprint"]
    rows = max(is_open.count(), distinct)
    merged = _dealt(is_open, rows, *keys).join(_dealt(seen, rows, *keys), keys, "full_outer")
    fresh = F.col("event_id").isNull()
    hit = F.col("_records").isNotNull()

    def first(name: str) -> Column:
        return F.when(fresh, F.col(f"_first.{name}")).otherwise(F.col(name)).alias(name)

    upserted = merged.select(
        F.coalesce("event_id", stable_id(F.col("feed"), F.col("fingerprint"), run)).alias("event_id"),
        "feed",
        "fingerprint",
        *[first(name) for name in ("kind", "field", "expected", "actual", "details")],
        (F.coalesce("affected_records", F.lit(0)) + F.coalesce("_records", F.lit(0))).cast("bigint").alias(
            "affected_records"
        ),
        F.coalesce("first_run_id", run).alias("first_run_id"),
        F.when(hit, run).otherwise(F.col("last_run_id")).alias("last_run_id"),
        F.least("source_changed_at", "_changed").alias("source_changed_at"),
        F.coalesce("detected_at", _moment(now)).alias("detected_at"),
        F.when(hit, _moment(now)).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.lit(OPEN).alias("status"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolution_note"),
    )
    return upserted.unionByName(closed.select(*COLUMNS))


def _resolving(events: DataFrame, hits: Column, note: Column, now: datetime | Column) -> DataFrame:
    hits = F.coalesce(hits, F.lit(False)) & (F.col("status") == OPEN)
    return events.withColumns(
        {
            "resolved_at": F.when(hits, _moment(now)).otherwise(F.col("resolved_at")),
            "resolution_note": F.when(hits, note).otherwise(F.col("resolution_note")),
            "status": F.when(hits, F.lit(RESOLVED)).otherwise(F.col("status")),
        }
    )


def drift_event_resolve(events: DataFrame, decisions: DataFrame, now: datetime | Column) -> DataFrame:
    """Apply operator decisions (event_id, note) to open events."""
    asked = decisions.select("event_id", F.col("note").alias("_note"), F.lit(True).alias("_asked"))
    rows = events.count()
    joined = _dealt(events, rows, "event_id").join(_dealt(asked, rows, "event_id"), "event_id", "left")
    return _resolving(joined, F.col("_asked"), F.col("_note"), now).select(*events.columns)


def drift_event_resolve_all(events: DataFrame, feed: str, note: str, now: datetime | Column) -> DataFrame:
    """Resolve every open event of a feed."""
    return _resolving(events, F.col("feed") == feed, F.lit(note), now)


def drift_event_resolve_within(
    events: DataFrame, feed: str, start: datetime | str, end: datetime | str, note: str, now: datetime | Column
) -> DataFrame:
    """Resolve open events whose earliest source change lies in [start, end]; without a source change never."""
    changed = F.col("source_changed_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return _resolving(events, (F.col("feed") == feed) & changed, F.lit(note), now)


def proves_drift_gone(run: dict) -> bool:
    """Only a backfill that read something, saw no drift and succeeded says anything about open events."""
    return (
        run["mode"] == "BACKFILL"
        and run["status"] == "SUCCEEDED"
        and not run["drift_detected"]
        and run["extracted"] > 0
    )


def clean_backfill_resolution(events: DataFrame, run: dict, now: datetime | Column) -> DataFrame:
    """After a clean backfill, resolve the open events whose source changes it has re-read. `run` is one run row."""
    if not proves_drift_gone(run):
        return events
    note = f"resolved by clean backfill run {run['run_id']}"
    return drift_event_resolve_within(events, run["feed"], run["backfill_from"], run["backfill_to"], note, now)
