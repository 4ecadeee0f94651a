"""Lifecycle of quarantined records.

A key has at most one open row. A rejected version opens a row unless that very version is already open; an open row
of another version is superseded. A clean pass (loaded or skipped) closes an open row of a version up to the clock
the destination holds. A batch brings many such steps per key, in arrival order.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions.ids import stable_id
from feedweave.functions.keyed import highest, last, walk_keys

# States, notes and column widths.
OPEN, SUPERSEDED, REPLAYED, DISCARDED = "OPEN", "SUPERSEDED", "REPLAYED", "DISCARDED"
NEWER_NOTE = "superseded by a newer quarantined version"
LOADED_NOTE = "a newer version was loaded successfully"
DETAILS_WIDTH = 2000
NOTE_WIDTH = 500

SCHEMA = (
    "quarantine_id string, feed string, business_key string, run_id string, reason string, details string, "
    "payload string, source_updated_at timestamp, quarantined_at timestamp, status string, resolved_at timestamp, "
    "resolution_note string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
KEYS = ["feed", "business_key"]


def _moment(at: datetime | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def rejected_rows(rejected: DataFrame, run_id: str | Column, at: datetime | Column) -> DataFrame:
    """Rejected records (feed, business_key, source_updated_at, arrival_seq, reason, details, payload) as rows."""
    run = run_id if isinstance(run_id, Column) else F.lit(run_id)
    return rejected.select(
        stable_id(
            F.col("feed"), F.col("business_key"), F.unix_micros("source_updated_at"), run, F.col("arrival_seq")
        ).alias("quarantine_id"),
        *KEYS,
        run.alias("run_id"),
        "reason",
        F.left("details", F.lit(DETAILS_WIDTH)).alias("details"),
        "payload",
        "source_updated_at",
        _moment(at).alias("quarantined_at"),
        F.lit(OPEN).alias("status"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolution_note"),
        "arrival_seq",
    )


def quarantine_episodes(
    open_rows: DataFrame | None,
    rejected: DataFrame,
    passes: DataFrame,
    run_id: str | Column,
    at: datetime | Column,
    limit: int | None = None,
) -> DataFrame:
    """All open rows and all rows opened by the batch, with their state after it.

    `open_rows`: at most one per key. `passes`: feed, business_key, arrival_seq, source_updated_at (the clock the
    destination holds after the pass). Adds `is_new`. Every row carries where it was closed, if it was.
    """
    new = rejected_rows(rejected, run_id, at).select("arrival_seq", F.struct(*COLUMNS).alias("_row"), *KEYS)
    steps = new.withColumn("_pass", F.lit(None).cast("timestamp")).unionByName(
        passes.select(
            "arrival_seq",
            F.lit(None).cast(new.schema["_row"].dataType).alias("_row"),
            *KEYS,
            F.col("source_updated_at").alias("_pass"),
        )
    )
    if open_rows is not None:
        steps = steps.unionByName(
            open_rows.select(
                F.lit(-1).cast("bigint").alias("arrival_seq"),
                F.struct(*COLUMNS).alias("_row"),
                *KEYS,
                F.lit(None).cast("timestamp").alias("_pass"),
            )
        )
    rejects = F.col("_row").isNotNull()
    version = F.col("_row.source_updated_at")

    def body(walk, rows: DataFrame) -> DataFrame:
        rows = walk.before(
            rows, _q=last(F.when(rejects, F.struct(version.alias("version"), F.col("arrival_seq").alias("seq"))))
        )
        covers = ~rejects & F.col("_q").isNotNull() & (
            F.col("_q.version").isNull() | (F.col("_q.version") <= F.col("_pass"))
        )
        rows = rows.withColumn("_covers", covers)
        rows = walk.before(rows, _closed=highest(F.when(F.col("_covers"), F.col("arrival_seq"))))
        still_open = F.col("_q").isNotNull() & (F.col("_closed").isNull() | (F.col("_closed") < F.col("_q.seq")))
        starts = rejects & ~(still_open & F.col("_q.version").eqNullSafe(version))
        rows = rows.withColumn("_starts", starts).withColumn(
            "_note",
            F.when(still_open & F.col("_covers"), F.lit(LOADED_NOTE)).when(
                still_open & F.col("_starts"), F.lit(NEWER_NOTE)
            ),
        )
        return walk.before(rows, _episode=highest(F.when(F.col("_starts"), F.col("arrival_seq"))))

    walked = walk_keys(steps, KEYS, "arrival_seq", body, limit)
    # Each episode has one opening row and at most one closing row; both meet in an aggregate per episode, so a row
    # that opens one episode and closes the one before it contributes to both.
    opening = F.struct(
        F.col("arrival_seq").alias("episode"), F.col("_row").alias("row"), F.lit(None).cast("string").alias("note")
    )
    closing = F.struct(
        F.col("_episode").alias("episode"),
        F.lit(None).cast(new.schema["_row"].dataType).alias("row"),
        F.col("_note").alias("note"),
    )
    parts = F.array_compact(F.array(F.when(F.col("_starts"), opening), F.when(F.col("_note").isNotNull(), closing)))
    episodes = (
        walked.where(F.col("_starts") | F.col("_note").isNotNull())
        .select(*KEYS, F.inline(parts))
        .groupBy(*KEYS, "episode")
        .agg(F.max("row").alias("row"), F.max("note").alias("note"))
    )
    closed = F.col("note").isNotNull()
    return episodes.select(
        *[f"row.{c}" for c in COLUMNS[: COLUMNS.index("status")]],
        F.when(closed, F.lit(SUPERSEDED)).otherwise(F.col("row.status")).alias("status"),
        F.when(closed, _moment(at)).otherwise(F.col("row.resolved_at")).alias("resolved_at"),
        F.coalesce("note", "row.resolution_note").alias("resolution_note"),
        (F.col("episode") >= 0).alias("is_new"),
    )


def changed_rows(episodes: DataFrame) -> DataFrame:
    """What a batch did to the open rows, one row for each key it did anything to: the row that is open now, or one
    that closed.
    """
    changed = episodes.where(F.col("is_new") | (F.col("status") != OPEN))
    now = F.max_by(F.struct(*COLUMNS), F.when(F.col("status") == OPEN, 1).otherwise(0))
    return changed.groupBy(*KEYS).agg(now.alias("_row")).select("_row.*")


def quarantine_append(episodes: DataFrame) -> DataFrame:
    """Rows the batch added: a version that was already open added none."""
    return episodes.where("is_new")


def quarantine_supersede_newer(episodes: DataFrame) -> DataFrame:
    """Rows closed because another version of the key was quarantined."""
    return episodes.where(F.col("resolution_note") == NEWER_NOTE)


def quarantine_supersede_loaded(episodes: DataFrame) -> DataFrame:
    """Rows closed by a clean pass at or after their version."""
    return episodes.where(F.col("resolution_note") == LOADED_NOTE)


def _closing(quarantine: DataFrame, hits: Column, status: str, note: Column, at: datetime | Column) -> DataFrame:
    return (
        quarantine.withColumn("resolved_at", F.when(hits, _moment(at)).otherwise(F.col("resolved_at")))
        .withColumn("resolution_note", F.when(hits, note).otherwise(F.col("resolution_note")))
        .withColumn("status", F.when(hits, F.lit(status)).otherwise(F.col("status")))
    )


def quarantine_discard(quarantine: DataFrame, decisions: DataFrame, at: datetime | Column) -> DataFrame:
    """Apply operator decisions (quarantine_id, note): open rows become DISCARDED, others stay as they are."""
    asked = decisions.select("quarantine_id", F.col("note").alias("_note"), F.lit(True).alias("_asked"))
    joined = quarantine.join(asked, "quarantine_id", "left")
    hits = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("status") == OPEN)
    return _closing(joined, hits, DISCARDED, F.col("_note"), at).select(*quarantine.columns)


def unknown_ids(quarantine: DataFrame, decisions: DataFrame, key: str = "quarantine_id") -> DataFrame:
    """Decisions about rows that do not exist."""
    return decisions.join(quarantine.select(key), key, "left_anti")


def quarantine_replay(quarantine: DataFrame, ids: DataFrame, at: datetime | Column | None = None) -> DataFrame:
    """Stored payloads of the named rows as feed records, ready for the same pipeline. Only OPEN rows qualify.

    They are no deletes, keep the quarantined version (`at`, the time of the replay, where they have none), and are
    processed in the order they were quarantined.
    """
    chosen = quarantine.join(ids.select("quarantine_id").distinct(), "quarantine_id", "left_semi")
    return chosen.where(F.col("status") == OPEN).select(
        "quarantine_id",
        *KEYS,
        (F.col("source_updated_at") if at is None else F.coalesce("source_updated_at", _moment(at))).alias("source_updated_at"),
        F.lit(False).alias("deleted"),
        "payload",
        F.unix_micros("quarantined_at").alias("arrival_seq"),
    )


def not_replayable(quarantine: DataFrame, ids: DataFrame) -> DataFrame:
    """Named rows that are not open, and names without a row (status null): a replay must refuse them."""
    return (
        ids.select("quarantine_id")
        .join(quarantine.select("quarantine_id", "status"), "quarantine_id", "left")
        .where(F.col("status").isNull() | (F.col("status") != OPEN))
    )


def quarantine_mark_replayed(
    quarantine: DataFrame, replayed: DataFrame, note: str | Column, at: datetime | Column
) -> DataFrame:
    """Rows whose replay was loaded or skipped become REPLAYED, whatever state the pipeline left them in."""
    done = replayed.select("quarantine_id", F.lit(True).alias("_done"))
    joined = quarantine.join(done, "quarantine_id", "left")
    text = note if isinstance(note, Column) else F.lit(note)
    hits = F.coalesce(F.col("_done"), F.lit(False))
    return _closing(joined, hits, REPLAYED, text, at).select(*quarantine.columns)
