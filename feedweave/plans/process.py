"""One batch of feed records through the whole pipeline, as DataFrames.

Everything that looks at a single record (drift check, mapping, rules, projection, fingerprint) is one projection
without a shuffle. The keyed steps share the key: in-run dedup, the merge and the quarantine lifecycle.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.feeds import FeedSpec
from feedweave.operators.dedup import mark_repeats
from feedweave.operators.destination import content_fingerprint
from feedweave.operators.drift import drift_fingerprint, drift_route
from feedweave.operators.drift_events import drift_event_upsert
from feedweave.operators.mapping import INVALID, failure_message
from feedweave.operators.merge import annotate, before_after_of, state_of
from feedweave.operators.outbox import change_events
from feedweave.operators.quarantine import quarantine_episodes
from feedweave.operators.runs import LOADED, QUARANTINED, REPEATED, SKIPPED, run_counters
from feedweave.session import stored

#: What later steps read of a checked record.
CHECKED = [
    "feed",
    "business_key",
    "source_updated_at",
    "deleted",
    "arrival_seq",
    "payload",
    "is_repeat",
    "findings",
    "drift_detected",
    "reject_reason",
    "reject_details",
    "content",
    "content_fingerprint",
]


def check_records(records: DataFrame, spec: FeedSpec, repeats: bool = True, limit: int | None = None) -> DataFrame:
    """Records with everything known about each of them before the merge.

    Adds is_repeat, findings, drift_detected, reject_reason and reject_details (null when it may load), content and
    content_fingerprint (null for deletes). Blocking drift ends the processing of a record before it is mapped.
    """
    marked = mark_repeats(records, limit) if repeats else records.withColumn("is_repeat", F.lit(False))
    routed = drift_route(marked, spec.contract, skip=F.col("deleted") | F.col("is_repeat"))
    mapped = spec.map_records(routed, skip=F.col("route") != "CONTINUE")
    blocked = F.col("route") == "QUARANTINE"
    reason = F.when(blocked, F.lit("DRIFT")).when(
        F.col("failure_kind").isNotNull(),
        F.when(F.col("failure_kind") == INVALID, F.lit("VALIDATION")).otherwise(F.lit("MAPPING")),
    )
    details = F.when(blocked, F.col("drift_details")).otherwise(
        failure_message(F.col("failure_kind"), F.col("errors"))
    )
    return (
        mapped.withColumn("content", spec.project(F.col("canonical")))
        .withColumn("content_fingerprint", content_fingerprint(F.col("content"), spec.destination.kinds))
        .select(
            *[c for c in records.columns],
            "is_repeat",
            "findings",
            "drift_detected",
            reason.alias("reject_reason"),
            details.alias("reject_details"),
            "content",
            "content_fingerprint",
        )
    )


def keep_checked(checked: DataFrame, folder: str | None = None) -> DataFrame:
    """Store checked records for the steps that follow. Of their payloads those rejected are needed, for quarantine."""
    payload = F.when(F.col("reject_reason").isNotNull(), F.col("payload"))
    return stored(checked.withColumn("payload", payload).select(*CHECKED), folder)


def changes_of(checked: DataFrame) -> DataFrame:
    """The canonical changes a checked batch brings: an upsert with content or a delete without."""
    return checked.where(~F.col("is_repeat") & F.col("reject_reason").isNull()).select(
        "business_key",
        "arrival_seq",
        "source_updated_at",
        F.col("deleted").alias("is_delete"),
        "content_fingerprint",
        "content",
        "drift_detected",
    )


def rejected_of(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNotNull()).select(
        "feed",
        "business_key",
        "source_updated_at",
        "arrival_seq",
        F.col("reject_reason").alias("reason"),
        F.col("reject_details").alias("details"),
        "payload",
    )


@dataclass
class BatchOutcome:
    """What a batch changes in each table; `state` is the destination after it, `changed` the rows that are new in it."""

    results: DataFrame
    state: DataFrame
    changed: DataFrame
    events: DataFrame
    quarantine: DataFrame
    drift: DataFrame
    counters: DataFrame


def process_batch(
    checked: DataFrame,
    spec: FeedSpec,
    state: DataFrame | None,
    open_quarantine: DataFrame | None,
    drift_events: DataFrame,
    run_id: str,
    now: datetime,
    keep=lambda df, name: df,
    limit: int | None = None,
) -> BatchOutcome:
    """Merge a checked batch and derive every table change from it.

    `keep(df, name)` may store an intermediate result that several outputs read; by default nothing is stored.
    """
    annotated = keep(annotate(changes_of(checked), state, now, limit), "merge")
    results = before_after_of(annotated)
    passes = results.select(F.lit(spec.name).alias("feed"), "business_key", "arrival_seq", "source_updated_at")
    episodes = quarantine_episodes(open_quarantine, rejected_of(checked), passes, run_id, now, limit)
    findings = drift_fingerprint(checked.where("drift_detected"))
    destination = spec.destination
    return BatchOutcome(
        results=results,
        state=state_of(annotated),
        changed=state_of(annotated, changed=True),
        events=change_events(results, spec.name, destination.key_name, destination.wire_names, run_id, now),
        quarantine=episodes,
        drift=drift_event_upsert(drift_events, findings, run_id, now),
        counters=run_counters(record_fates(checked, annotated, spec.name, run_id, now)),
    )


def record_fates(checked: DataFrame, annotated: DataFrame, feed: str, run_id: str, now: datetime) -> DataFrame:
    """What became of every record of the batch; rows meet in a union, not in a join."""

    def rows(df: DataFrame, fate) -> DataFrame:
        return df.select(
            F.lit(run_id).alias("run_id"),
            F.lit(feed).alias("feed"),
            fate.alias("fate"),
            "drift_detected",
            "source_updated_at",
            F.lit(now).cast("timestamp").alias("processed_at"),
        )

    held = checked.where(F.col("is_repeat") | F.col("reject_reason").isNotNull())
    merged = annotated.where(F.col("_stored").isNull())
    return rows(held, F.when(F.col("is_repeat"), F.lit(REPEATED)).otherwise(F.lit(QUARANTINED))).unionByName(
        rows(merged, F.when(F.col("applied"), F.lit(LOADED)).otherwise(F.lit(SKIPPED)))
    )
