"""Change events and their outbox."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions.ids import stable_id
from feedweave.functions.keyed import highest, hot_keys, walk_keys
from feedweave.functions.ordering import number_rows
from feedweave.functions.text import format_instant
from feedweave.session import materialize, rows_per_group

# Batch size of a publish pass, width of a stored error, topic prefix, words for a lost answer.
PUBLISH_BATCH = 100
ERROR_WIDTH = 1000
TOPIC_PREFIX = "changes"
NO_ANSWER = "no acknowledgement"

SCHEMA = (
    "event_id string, feed string, business_key string, event_type string, version int, payload string, "
    "created_at timestamp, published_at timestamp, attempts int, last_error string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ANSWER = "event_id string, ok boolean, error string"
# One processing time per batch makes created_at tie; the version keeps the order of a key's events.
PUBLISH_ORDER = ["created_at", "version", "feed", "business_key"]


def _wire(row: Column, key: Column, wire_names: dict[str, str], kinds: dict[str, str], key_name: str) -> Column:
    """A destination row as consumers see it: published names, instants as ISO text."""

    def shown(name: str) -> Column:
        value = row["content"][name]
        return format_instant(value) if kinds[name] == "timestamp" else value

    return F.when(
        row.isNotNull(),
        F.struct(
            key.alias(key_name),
            *[shown(name).alias(wire) for name, wire in wire_names.items()],
            format_instant(row["source_updated_at"]).alias("sourceUpdatedAt"),
        ),
    )


def change_events(
    results: DataFrame,
    feed: str,
    key_name: str,
    wire_names: dict[str, str],
    run_id: str | Column,
    now: datetime | Column,
) -> DataFrame:
    """One event per applied change, with the destination rows before and after it; skipped changes give none.

    Needs the before/after form of the merge results. Adds the event id and the JSON payload.
    """
    run = run_id if isinstance(run_id, Column) else F.lit(run_id)
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    kinds = {f.name: f.dataType.simpleString() for f in results.schema["before"].dataType["content"].dataType.fields}
    key = F.col("business_key")
    event_id = stable_id(F.lit(feed), key, F.col("version"), run)
    before = _wire(F.col("before"), key, wire_names, kinds, key_name)
    after = _wire(F.col("after"), key, wire_names, kinds, key_name)
    payload = F.to_json(
        F.struct(
            event_id.alias("eventId"),
            F.lit(feed).alias("feed"),
            F.col("outcome").alias("type"),
            key.alias("businessKey"),
            F.col("version"),
            format_instant(at).alias("occurredAt"),
            format_instant(F.col("source_updated_at")).alias("sourceUpdatedAt"),
            run.alias("runId"),
            before.alias("before"),
            after.alias("after"),
        ),
        {"ignoreNullFields": "false"},
    )
    return results.where("applied").select(
        event_id.alias("event_id"),
        F.lit(feed).alias("feed"),
        "business_key",
        F.col("outcome").alias("event_type"),
        "version",
        "source_updated_at",
        run.alias("run_id"),
        payload.alias("payload"),
        at.alias("created_at"),
    )


def pending_rows(events: DataFrame) -> DataFrame:
    """Events as outbox rows that nobody has tried to publish yet."""
    return events.select(
        "event_id",
        "feed",
        "business_key",
        "event_type",
        "version",
        "payload",
        "created_at",
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error"),
    )


def outbox_append(outbox: DataFrame, events: DataFrame) -> DataFrame:
    return outbox.unionByName(pending_rows(events))


def outbox_pending(outbox: DataFrame, n: int = PUBLISH_BATCH) -> DataFrame:
    """The oldest n unpublished events."""
    return outbox.where(F.col("published_at").isNull()).orderBy(*PUBLISH_ORDER).limit(n)


def publish_queue(outbox: DataFrame, batch: int = PUBLISH_BATCH) -> DataFrame:
    """Unpublished events with their place in publish order, their batch, and which of its key's they are in it."""
    numbered = number_rows(outbox.where(F.col("published_at").isNull()), *PUBLISH_ORDER, name="_position").withColumn(
        "_batch", F.floor((F.col("_position") - 1) / batch) + 1
    )
    of_key = Window.partitionBy("_batch", "feed", "business_key").orderBy("_position")
    return materialize(numbered.withColumn("_turn", F.row_number().over(of_key)))


def outbox_publish_pass(
    outbox: DataFrame, acks: DataFrame, at: datetime | Column, batch: int = PUBLISH_BATCH
) -> DataFrame:
    """The outbox after one publish pass, given what the transport would answer (event_id, ok, error).

    Pending events go out oldest first in batches. After the first failure of a key, its later events of the same
    batch are held back; after a batch with a failure no further batch starts. Adds `pass_result`: PUBLISHED,
    FAILED, HELD_BACK or WAITING, null for rows that were published before. An event without an answer has failed.
    """
    now = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    pending = number_rows(outbox.where(F.col("published_at").isNull()), *PUBLISH_ORDER, name="_position")
    answered = pending.join(acks.select("event_id", "ok", "error"), "event_id", "left").select(
        *outbox.columns,
        "_position",
        F.floor((F.col("_position") - 1) / batch).alias("_batch"),
        F.coalesce("ok", F.lit(False)).alias("_ok"),
        F.when(F.col("ok").isNull(), F.lit(NO_ANSWER)).otherwise(F.col("error")).alias("_error"),
    )
    last_batch = answered.where(~F.col("_ok")).agg(F.min("_batch")).scalar()
    answered = answered.withColumn("_last_batch", last_batch)
    # Only the one batch that ends the pass can hold events back: at most `batch` rows.
    first_failures = (
        answered.where(~F.col("_ok") & (F.col("_batch") == F.col("_last_batch")))
        .groupBy("feed", "business_key")
        .agg(F.min("_position").alias("_failed_at"))
    )
    decided = answered.join(F.broadcast(first_failures), ["feed", "business_key"], "left").withColumn(
        "pass_result",
        F.when(F.col("_batch") > F.col("_last_batch"), F.lit("WAITING"))
        .when((F.col("_batch") == F.col("_last_batch")) & (F.col("_position") > F.col("_failed_at")), F.lit("HELD_BACK"))
        .when(F.col("_ok"), F.lit("PUBLISHED"))
        .otherwise(F.lit("FAILED")),
    )
    updated = _after_pass(decided, F.col("_error"), now).select(*outbox.columns, "pass_result")
    done = outbox.where(F.col("published_at").isNotNull()).withColumn("pass_result", F.lit(None).cast("string"))
    return updated.unionByName(done)


def _in_turns(send: Callable[[pa.Table], Sequence[str | None]]):
    """Hand over sorted events of whole keys, as many keys at a time as there are, each key one event at a time."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        failed = False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("feed").to_pylist(), batch.column("business_key").to_pylist(), strict=True))
            first = np.array([a != b for a, b in zip(keys, [key, *keys[:-1]], strict=True)])
            owner = np.cumsum(first)
            turn = np.arange(len(keys)) - np.searchsorted(owner, owner, side="left")
            # Owner 0 is the key that the batch before ended with.
            stopped = np.zeros(int(owner[-1]) + 1, dtype=bool)
            stopped[0] = failed
            events = pa.Table.from_batches([batch.select(COLUMNS)])
            by_turn = np.argsort(turn, kind="stable")
            for due in np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1):
                due = due[~stopped[owner[due]]]
                if not len(due):
                    continue
                errors = list(send(events.take(pa.array(due))))
                if len(errors) != len(due):
                    raise ValueError(f"{len(due)} events were handed over and {len(errors)} answered")
                ok = [e is None for e in errors]
                stopped[owner[due[~np.array(ok)]]] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        events.column("event_id").take(pa.array(due)).combine_chunks(),
                        pa.array(ok, pa.bool_()),
                        pa.array(errors, pa.string()),
                    ],
                    names=["event_id", "ok", "error"],
                )
            key, failed = keys[-1], bool(stopped[-1])

    return answers


def delivered(
    outbox: DataFrame, send: Callable[[pa.Table], Sequence[str | None]], limit: int | None = None
) -> DataFrame:
    """Hand over all pending events by tasks and return the answers (event_id, ok, error).

    Events of a key go out one after the other, in publish order; after a failure its later ones do not. A key has at
    most `limit` events in one round; later rounds leave out keys that failed before.
    """
    limit = rows_per_group(outbox.sparkSession, limit)
    keys = ["feed", "business_key"]
    pending = outbox.where(F.col("published_at").isNull())
    long = materialize(hot_keys(pending, keys, limit))
    most = long.agg(F.max("_n")).first()[0]
    if most is None:
        return _handed_over(pending, send)
    # Places inside long keys come from a range sort, not from a window over the key.
    numbered = number_rows(pending.join(long, keys, "left_semi"), *keys, *PUBLISH_ORDER[:2], "event_id", name="_position")
    first = F.min("_position").alias("_first")
    numbered = materialize(numbered)
    placed = numbered.join(numbered.groupBy(*keys).agg(first), keys)
    rounds = materialize(placed.withColumn("_round", F.floor((F.col("_position") - F.col("_first")) / limit)))
    answers = _handed_over(pending.join(long, keys, "left_anti"), send)
    for number in range(ceil(most / limit)):
        due = rounds.where(F.col("_round") == number)
        if number:
            stopped = answers.where(~F.col("ok")).join(rounds.select("event_id", *keys), "event_id").select(*keys)
            due = due.join(stopped, keys, "left_anti")
        answers = answers.unionByName(_handed_over(due, send))
    return answers


def _handed_over(due: DataFrame, send: Callable[[pa.Table], Sequence[str | None]]) -> DataFrame:
    """Kept, so that nothing is sent again by a later use of the answers."""
    sorted_keys = due.select(*COLUMNS).repartition("feed", "business_key").sortWithinPartitions(
        "feed", "business_key", *PUBLISH_ORDER[:2], "event_id"
    )
    return materialize(sorted_keys.mapInArrow(_in_turns(send), ANSWER))


def outbox_publish_by_key(outbox: DataFrame, acks: DataFrame, at: datetime | Column) -> DataFrame:
    """The outbox after a pass that keeps the order inside each key only, given the answers (event_id, ok, error).

    Adds `pass_result`: PUBLISHED, FAILED, or HELD_BACK for events after a failure of their key; null for rows that
    were published before. An event without an answer has failed, if none of its key's failed before it.
    """
    now = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    pending = outbox.where(F.col("published_at").isNull())
    answered = pending.join(acks.select("event_id", "ok", "error"), "event_id", "left").withColumns(
        {"_arrived": F.coalesce("ok", F.lit(False)), "_place": F.struct("created_at", "version", "event_id")}
    )
    # The first failure of each key: an aggregate, not a window, so a key may have any number of events.
    failures = answered.where(~F.col("_arrived")).groupBy("feed", "business_key").agg(F.min("_place").alias("_failed_at"))
    decided = answered.join(failures, ["feed", "business_key"], "left").withColumn(
        "pass_result",
        F.when(F.col("_place") > F.col("_failed_at"), F.lit("HELD_BACK"))
        .when(F.col("_arrived"), F.lit("PUBLISHED"))
        .otherwise(F.lit("FAILED")),
    )
    error = F.when(F.col("ok").isNull(), F.lit(NO_ANSWER)).otherwise(F.col("error"))
    done = outbox.where(F.col("published_at").isNotNull()).withColumn("pass_result", F.lit(None).cast("string"))
    return _after_pass(decided, error, now).select(*outbox.columns, "pass_result").unionByName(done)


def _after_pass(decided: DataFrame, error: Column, now: Column) -> DataFrame:
    """Bookkeeping of events with their pass_result."""
    published = F.col("pass_result") == "PUBLISHED"
    tried = F.col("pass_result").isin("PUBLISHED", "FAILED")
    return decided.withColumns(
        {
            "published_at": F.when(published, now).otherwise(F.col("published_at")),
            "attempts": F.when(tried, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "last_error": F.when(published, F.lit(None).cast("string"))
            .when(tried, F.left(error, F.lit(ERROR_WIDTH)))
            .otherwise(F.col("last_error")),
        }
    )


def outbox_counts(outbox: DataFrame) -> DataFrame:
    return outbox.agg(
        F.count_if(F.col("published_at").isNull()).alias("pending"),
        F.count_if(F.col("published_at").isNotNull()).alias("published"),
    )


def key_history(outbox: DataFrame, feed: str | None = None, key: str | None = None) -> DataFrame:
    """Events of one key, or of every key, oldest first. Rows, not one list per key: a key's history is unbounded."""
    if feed is not None:
        outbox = outbox.where(F.col("feed") == feed)
    if key is not None:
        outbox = outbox.where(F.col("business_key") == key)
    return outbox.orderBy("feed", "business_key", "created_at", "version")


def consume_dedup(events: DataFrame) -> DataFrame:
    """Consumer side: drop events delivered again."""
    return events.dropDuplicates(["event_id"])


def consume_if_newer(events: DataFrame, held: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Consumer side: keep an event only if its version is above everything its key has brought so far.

    `events` arrive in `delivery_seq` order. `held` (feed, business_key, version) is what the consumer already has.
    """
    keys = ["feed", "business_key"]
    rows = events.withColumn("_is_held", F.lit(False))
    if held is not None:
        # What the consumer holds comes first in order; no join, so a key with very many events stays splittable.
        first = held.select(
            *keys,
            F.col("version").cast(events.schema["version"].dataType).alias("version"),
            F.lit(-1).cast("bigint").alias("delivery_seq"),
            F.lit(True).alias("_is_held"),
        )
        rows = rows.unionByName(first, allowMissingColumns=True)

    def body(walk, rows: DataFrame) -> DataFrame:
        rows = walk.before(rows, _seen=highest(F.col("version")))
        newer = F.col("_seen").isNull() | (F.col("version") > F.col("_seen"))
        return rows.where(~F.col("_is_held") & newer).drop("_seen", "_is_held")

    return walk_keys(rows, keys, "delivery_seq", body, limit)
