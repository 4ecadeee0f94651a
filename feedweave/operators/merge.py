"""Idempotent keyed merge: last version wins, every change gets an outcome.

What is meant is a fold over the changes of a key in arrival order. Here the fold is a few running values per key, all on one shuffle by key: stored rows join the changes by being the first row of their key (arrival number -1),
not by a join. Late changes are recognised by the highest clock before them; what a change does is decided by the
change that took effect just before it.

Changes: business_key, arrival_seq, source_updated_at, is_delete, content_fingerprint, content (struct of the
business columns, null for deletes). Destination state: business_key, the same business columns, source_updated_at,
content_fingerprint, version, deleted_at, first_synced_at, last_synced_at.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions.keyed import highest, last, total, walk_keys

# Outcomes of a change.
CREATED, UPDATED, DELETED = "CREATED", "UPDATED", "DELETED"
UNCHANGED, STALE = "SKIPPED_UNCHANGED", "SKIPPED_STALE"
BOOKKEEPING = [
    "source_updated_at",
    "content_fingerprint",
    "version",
    "deleted_at",
    "first_synced_at",
    "last_synced_at",
]
STORED_SEQ = -1


def content_columns(state: DataFrame) -> list[str]:
    return [c for c in state.columns if c != "business_key" and c not in BOOKKEEPING]


def content_type(changes: DataFrame) -> str:
    return changes.schema["content"].dataType.simpleString()


def empty_state(changes: DataFrame) -> DataFrame:
    """A destination table without rows for these changes."""
    content = changes.schema["content"].dataType
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in content.fields)
    return changes.sparkSession.createDataFrame(
        [],
        f"business_key string, {columns}, source_updated_at timestamp, content_fingerprint string, version int, "
        "deleted_at timestamp, first_synced_at timestamp, last_synced_at timestamp",
    )


def _stored_rows(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored rows in the shape of changes, first in arrival order."""
    names = changes.schema["content"].dataType.names
    return state.select(
        "business_key",
        F.lit(STORED_SEQ).cast("bigint").alias("arrival_seq"),
        "source_updated_at",
        F.col("deleted_at").isNotNull().alias("is_delete"),
        "content_fingerprint",
        F.struct(*[F.col(n) for n in names]).cast(content_type(changes)).alias("content"),
        F.struct(
            F.col("version").cast("int").alias("version"), "deleted_at", "first_synced_at", "last_synced_at"
        ).alias("_stored"),
    )


def _rows(changes: DataFrame, state: DataFrame | None) -> DataFrame:
    stored_type = (
        "struct<version: int, deleted_at: timestamp, first_synced_at: timestamp, last_synced_at: timestamp>"
    )
    rows = changes.withColumn("_stored", F.lit(None).cast(stored_type))
    if state is None:
        return rows
    return rows.unionByName(_stored_rows(state, changes), allowMissingColumns=True)


def annotate(
    changes: DataFrame, state: DataFrame | None, processed_at: datetime | Column, limit: int | None = None
) -> DataFrame:
    """Every change and every stored row with what is known before and after it. The other functions read this."""
    now = processed_at if isinstance(processed_at, Column) else F.lit(processed_at).cast("timestamp")
    stored = F.col("_stored").isNotNull()
    delete = F.col("is_delete")

    def body(walk, rows: DataFrame) -> DataFrame:
        # A key exists from its stored row or its first upsert on; deletes before that leave nothing behind.
        rows = walk.before(rows, _existed=highest(F.when(stored | ~delete, F.lit(1))))
        known = stored | ~delete | F.col("_existed").isNotNull()
        rows = rows.withColumn("_known", known)
        # Late rows cannot raise the highest clock, so they need not be left out of it.
        rows = walk.before(rows, _clock=highest(F.when(F.col("_known"), F.col("source_updated_at"))))
        stale = F.col("_known") & ~stored & F.coalesce(F.col("source_updated_at") < F.col("_clock"), F.lit(False))
        rows = rows.withColumn("_stale", stale).withColumn("_effective", F.col("_known") & ~F.col("_stale"))
        rows = walk.before(
            rows,
            _previous=last(
                F.when(F.col("_effective"), F.struct(delete.alias("deleted"), F.col("content_fingerprint").alias("fp")))
            ),
            _held=last(
                F.when(
                    F.col("_effective") & (stored | ~delete),
                    F.struct(F.col("content").alias("content"), F.col("content_fingerprint").alias("fp")),
                )
            ),
        )
        previous = F.col("_previous")
        outcome = (
            F.when(stored, F.lit(None).cast("string"))
            .when(~F.col("_known"), F.lit(UNCHANGED))
            .when(F.col("_stale"), F.lit(STALE))
            .when(delete & previous["deleted"], F.lit(UNCHANGED))
            .when(delete, F.lit(DELETED))
            .when(previous.isNull() | previous["deleted"], F.lit(CREATED))
            .when(previous["fp"] == F.col("content_fingerprint"), F.lit(UNCHANGED))
            .otherwise(F.lit(UPDATED))
        )
        rows = rows.withColumn("outcome", outcome)
        applied = F.col("outcome").isin(CREATED, UPDATED, DELETED)
        rows = rows.withColumn("applied", F.coalesce(applied, F.lit(False)))
        deleted_at = F.when(stored, F.col("_stored.deleted_at")).when(F.col("outcome") == DELETED, now)
        rows = walk.before(
            rows,
            _versions=total(F.when(stored, F.col("_stored.version")).when(F.col("applied"), F.lit(1))),
            _life=last(
                F.when(
                    stored | F.col("applied"),
                    F.struct(deleted_at.alias("deleted_at")),
                )
            ),
            _first=last(F.when(stored, F.col("_stored.first_synced_at"))),
            _stored_sync=last(F.when(stored, F.col("_stored.last_synced_at"))),
            _touched=highest(F.when(~stored & F.col("_effective"), F.lit(1))),
        )
        step = F.when(stored, F.col("_stored.version")).when(F.col("applied"), F.lit(1)).otherwise(F.lit(0))
        return rows.withColumn("version", (F.coalesce(F.col("_versions"), F.lit(0)) + step).cast("int")).withColumn(
            "_deleted_at", F.when(stored | F.col("applied"), deleted_at).otherwise(F.col("_life.deleted_at"))
        )

    return walk_keys(_rows(changes, state), ["business_key"], "arrival_seq", body, limit).withColumn("_now", now)


def _results(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("_stored").isNull())


def outcomes_of(annotated: DataFrame) -> DataFrame:
    """Per change: outcome, running version and the clock the destination holds after it."""
    return _results(annotated).select(
        "business_key",
        "arrival_seq",
        "outcome",
        "version",
        F.when(F.col("outcome") == STALE, F.col("_clock")).otherwise(F.col("source_updated_at")).alias("source_updated_at"),
        "applied",
    )


def before_after_of(annotated: DataFrame) -> DataFrame:
    """Outcomes with the destination rows before and after each change.

    CREATED (none, new), UPDATED (old, new), DELETED (old, none), late (stored, none), unchanged upsert
    (stored, none), unchanged delete (none, none).
    """

    def row(content: Column, clock: Column) -> Column:
        return F.when(content.isNotNull(), F.struct(content.alias("content"), clock.alias("source_updated_at")))

    own = row(F.col("content"), F.col("source_updated_at"))
    held = row(F.col("_held.content"), F.col("_clock"))
    outcome = F.col("outcome")
    return _results(annotated).select(
        "business_key",
        "arrival_seq",
        "outcome",
        "version",
        F.when(outcome == STALE, F.col("_clock")).otherwise(F.col("source_updated_at")).alias("source_updated_at"),
        "applied",
        F.when(outcome.isin(UPDATED, DELETED, STALE), held)
        .when((outcome == UNCHANGED) & ~F.col("is_delete"), own)
        .alias("before"),
        F.when(outcome.isin(CREATED, UPDATED), own).alias("after"),
    )


def state_of(annotated: DataFrame, changed: bool = False) -> DataFrame:
    """The destination table after the batch: one row per key, taken from the key's last row in arrival order.

    Keys of which only deletes were ever seen have no row. `changed` leaves out rows that are as they were stored:
    those of keys that the batch brought nothing for, or only stale changes.
    """
    stored = F.col("_stored").isNotNull()
    own = F.col("_effective") & ~F.col("is_delete") & ~stored
    final = F.struct(
        F.when(own | stored, F.col("content")).otherwise(F.col("_held.content")).alias("content"),
        F.greatest("_clock", F.when(F.col("_effective"), F.col("source_updated_at"))).alias("source_updated_at"),
        F.when(own | stored, F.col("content_fingerprint")).otherwise(F.col("_held.fp")).alias("content_fingerprint"),
        F.col("version"),
        F.col("_deleted_at").alias("deleted_at"),
        F.coalesce(F.when(stored, F.col("_stored.first_synced_at")), F.col("_first"), F.col("_now")).alias(
            "first_synced_at"
        ),
        F.when(F.col("_touched").isNotNull() | (~stored & F.col("_effective")), F.col("_now"))
        .otherwise(F.coalesce(F.col("_stored.last_synced_at"), F.col("_stored_sync")))
        .alias("last_synced_at"),
    )
    rows = (
        annotated.where("_known")
        .groupBy("business_key")
        .agg(
            F.max_by(final, F.col("arrival_seq")).alias("_row"), F.bool_or(~stored & F.col("_effective")).alias("_changed")
        )
    )
    return (
        (rows.where("_changed") if changed else rows)
        .select(
            "business_key",
            "_row.content.*",
            *[f"_row.{c}" for c in BOOKKEEPING],
        )
    )


def merge_outcomes(changes, state=None, processed_at=None, limit=None) -> DataFrame:
    return outcomes_of(annotate(changes, state, processed_at, limit))


def merge_before_after(changes, state=None, processed_at=None, limit=None) -> DataFrame:
    return before_after_of(annotate(changes, state, processed_at, limit))


def merged_state(changes, state=None, processed_at=None, limit=None) -> DataFrame:
    return state_of(annotate(changes, state, processed_at, limit))


def merge_stale(results: DataFrame) -> DataFrame:
    """Changes older than what the destination held: nothing changes. Equal clocks are not stale."""
    return results.where(F.col("outcome") == STALE)


def merge_unchanged(results: DataFrame) -> DataFrame:
    """Same content again, a repeated delete, or a delete of a key never seen: no version, no event."""
    return results.where(F.col("outcome") == UNCHANGED)


def merge_soft_delete(results: DataFrame) -> DataFrame:
    """Deletes that took effect; the business columns stay."""
    return results.where(F.col("outcome") == DELETED)


def merge_resurrect(results: DataFrame) -> DataFrame:
    """Upserts of a deleted row: created again with the version going on, even when the content is the same."""
    return results.where((F.col("outcome") == CREATED) & (F.col("version") > 1))


def active_records(state: DataFrame) -> DataFrame:
    """Live destination rows per feed."""
    return (
        state.where(F.col("deleted_at").isNull()).groupBy("feed").agg(F.count(F.lit(1)).alias("active_records"))
    )
