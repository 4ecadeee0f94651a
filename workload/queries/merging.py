"""Dedup, merge and the destination table, on the event feed in two runs."""

from __future__ import annotations

from types import SimpleNamespace
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.feeds import Destination
from feedweave.operators import merge as M
from feedweave.operators.dedup import dedup_in_run as dedup
from feedweave.session import materialize, shared_folder
from feedweave.sinks.store import FeedStore
from feedweave.sinks.store import merge_sink as sink
from workload.derived import derived, derived_sql

SPLIT = "2024-01-15 12:00:00"
RUN_1, RUN_2 = "run-1", "run-2"
RUN_1_AT, RUN_2_AT = "2024-02-01 00:00:00", "2024-02-02 00:00:00"
EVENT_WIRE = {"event_type": "eventType"}


def _at(text: str):
    return F.lit(text).cast("timestamp")


def event_changes(spark, sf_dir) -> DataFrame:
    """The event feed as merge changes."""
    content = F.struct("event_type")
    return derived(spark, sf_dir, "event_feed").select(
        "business_key",
        "arrival_seq",
        "source_updated_at",
        F.col("deleted").alias("is_delete"),
        F.when(~F.col("deleted"), F.sha2("event_type", 256)).alias("content_fingerprint"),
        F.when(~F.col("deleted"), content).alias("content"),
    )


def first_state(spark, sf_dir) -> DataFrame:
    """The destination table after the first run. Kept, as a run would keep it, before the next run reads it."""
    changes = event_changes(spark, sf_dir).where(F.col("source_updated_at") <= _at(SPLIT))
    return materialize(M.merged_state(changes, None, _at(RUN_1_AT)))


def second_run(spark, sf_dir) -> DataFrame:
    changes = event_changes(spark, sf_dir).where(F.col("source_updated_at") > _at(SPLIT))
    return M.annotate(changes, first_state(spark, sf_dir), _at(RUN_2_AT))


def event_results(spark, sf_dir) -> DataFrame:
    return M.before_after_of(second_run(spark, sf_dir))


def _outcomes(df: DataFrame) -> DataFrame:
    return df.select(
        "business_key", "arrival_seq", "outcome", "version", F.unix_micros("source_updated_at").alias("clock_us")
    )


def _filtered(kind):
    return lambda spark, sf_dir: _outcomes(kind(M.outcomes_of(second_run(spark, sf_dir))))


def dedup_in_run(spark, sf_dir):
    """Clocks cut to the day, so that versions repeat."""
    feed = derived(spark, sf_dir, "event_feed").withColumn("source_updated_at", F.date_trunc("day", "source_updated_at"))
    return dedup(feed).select("business_key", "arrival_seq", F.unix_micros("source_updated_at").alias("clock_us"))


def merge_before_after(spark, sf_dir):
    rows = event_results(spark, sf_dir)
    return rows.select(
        "business_key",
        "arrival_seq",
        "outcome",
        F.col("before.content.event_type").alias("before_type"),
        F.unix_micros("before.source_updated_at").alias("before_us"),
        F.col("after.content.event_type").alias("after_type"),
        F.unix_micros("after.source_updated_at").alias("after_us"),
    )


def merged_state(spark, sf_dir):
    return _state(M.state_of(second_run(spark, sf_dir)))


def merge_sink(spark, sf_dir):
    """The destination written in two runs, bucket by bucket, and read back."""
    spec = SimpleNamespace(name="events", destination=Destination("userKey", {"event_type": ("string", 20, "eventType")}))
    store = FeedStore(spark, f"{shared_folder(spark)}/{uuid4()}", spec, buckets=8)
    changes = event_changes(spark, sf_dir)
    second = F.col("source_updated_at") > _at(SPLIT)
    for run_no, (part, at) in enumerate([(changes.where(~second), RUN_1_AT), (changes.where(second), RUN_2_AT)], 1):
        last = store.last_commit()
        merged = M.annotate(part, store.read_state(store.touched(part), last), _at(at))
        written = sink(store, M.state_of(merged, changed=True), part, run_no, last)
        store.commit(last, run_no, f"run-{run_no}", tables=written)
    return _state(store.read_state())


def _state(state: DataFrame) -> DataFrame:
    return state.select(
        "business_key",
        "event_type",
        F.unix_micros("source_updated_at").alias("clock_us"),
        "content_fingerprint",
        "version",
        *[F.unix_micros(c).alias(f"{c}_us") for c in ("deleted_at", "first_synced_at", "last_synced_at")],
    )


def active_records(spark, sf_dir):
    state = M.state_of(second_run(spark, sf_dir)).withColumn("feed", F.lit("events"))
    return M.active_records(state)


def merge_flagship(spark, sf_dir):
    """Whole event feed from nothing: dedup, merge, outcomes per kind."""
    feed = dedup(derived(spark, sf_dir, "event_feed")).select(
        "business_key",
        "arrival_seq",
        "source_updated_at",
        F.col("deleted").alias("is_delete"),
        F.when(~F.col("deleted"), F.sha2("event_type", 256)).alias("content_fingerprint"),
        F.when(~F.col("deleted"), F.struct("event_type")).alias("content"),
    )
    results = M.merge_outcomes(feed, None, _at(RUN_1_AT))
    return results.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("changes"),
        F.countDistinct("business_key").alias("keys"),
        F.max("version").alias("highest_version"),
    )


def fold_sql(changes: str, at: dict[int, str]) -> str:
    """The merge as a recursive fold: step n applies the n-th change of every key to what step n - 1 left.

    `changes` is the name of a relation (business_key, run_no, arrival_seq, ts, is_delete, content). Gives `fold`
    with the outcome of each change and the destination row after it.
    """
    now = "CASE o.run_no " + " ".join(f"WHEN {n} THEN TIMESTAMP '{t}'" for n, t in at.items()) + " END"
    return f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY business_key ORDER BY run_no, arrival_seq) AS n FROM {changes}),
fold AS (
  SELECT DISTINCT business_key, CAST(0 AS BIGINT) AS n, 0 AS run_no, CAST(0 AS BIGINT) AS arrival_seq,
    CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS TIMESTAMP) AS clock,
    CAST(NULL AS TIMESTAMP) AS deleted_at, CAST(NULL AS TIMESTAMP) AS first_at, CAST(NULL AS TIMESTAMP) AS last_at,
    0 AS version, false AS present, CAST(NULL AS VARCHAR) AS before_content, CAST(NULL AS TIMESTAMP) AS before_clock,
    CAST(NULL AS VARCHAR) AS after_content, CAST(NULL AS TIMESTAMP) AS after_clock, CAST(NULL AS TIMESTAMP) AS held_clock
  FROM ordered
  UNION ALL
  SELECT business_key, n, run_no, arrival_seq, outcome,
    CASE WHEN outcome IN ('CREATED', 'UPDATED') THEN new_content ELSE content END,
    CASE WHEN NOT present AND outcome = 'SKIPPED_UNCHANGED' THEN NULL WHEN outcome = 'SKIPPED_STALE' THEN clock ELSE ts END,
    CASE WHEN outcome = 'DELETED' THEN step_at WHEN outcome IN ('CREATED', 'UPDATED') THEN NULL ELSE deleted_at END,
    CASE WHEN NOT present AND outcome = 'CREATED' THEN step_at ELSE first_at END,
    CASE WHEN outcome = 'SKIPPED_STALE' OR (NOT present AND outcome = 'SKIPPED_UNCHANGED') THEN last_at ELSE step_at END,
    CASE WHEN outcome IN ('CREATED', 'UPDATED', 'DELETED') THEN version + 1 ELSE version END,
    present OR outcome = 'CREATED',
    CASE WHEN outcome IN ('UPDATED', 'DELETED', 'SKIPPED_STALE') OR (outcome = 'SKIPPED_UNCHANGED' AND NOT is_delete) THEN content END,
    CASE WHEN outcome IN ('UPDATED', 'DELETED', 'SKIPPED_STALE') THEN clock WHEN outcome = 'SKIPPED_UNCHANGED' AND NOT is_delete THEN ts END,
    CASE WHEN outcome IN ('CREATED', 'UPDATED') THEN new_content END,
    CASE WHEN outcome IN ('CREATED', 'UPDATED') THEN ts END,
    CASE WHEN outcome = 'SKIPPED_STALE' THEN clock ELSE ts END
  FROM (
    SELECT f.business_key, o.n, o.run_no, o.arrival_seq, o.ts, o.is_delete, o.content AS new_content, {now} AS step_at,
      f.content, f.clock, f.deleted_at, f.first_at, f.last_at, f.version, f.present,
      CASE WHEN NOT f.present AND o.is_delete THEN 'SKIPPED_UNCHANGED'
           WHEN NOT f.present THEN 'CREATED'
           WHEN o.ts < f.clock THEN 'SKIPPED_STALE'
           WHEN o.is_delete AND f.deleted_at IS NOT NULL THEN 'SKIPPED_UNCHANGED'
           WHEN o.is_delete THEN 'DELETED'
           WHEN f.deleted_at IS NOT NULL THEN 'CREATED'
           WHEN f.content = o.content THEN 'SKIPPED_UNCHANGED'
           ELSE 'UPDATED' END AS outcome
    FROM fold AS f JOIN ordered AS o ON o.business_key = f.business_key AND o.n = f.n + 1
  ) AS step
)"""


EVENT_CHANGES_SQL = f"""feed AS ({derived_sql('event_feed')}),
changes AS (SELECT business_key, CASE WHEN source_updated_at <= TIMESTAMP '{SPLIT}' THEN 1 ELSE 2 END AS run_no, arrival_seq,
  source_updated_at AS ts, deleted AS is_delete, CASE WHEN NOT deleted THEN event_type END AS content FROM feed)"""
FOLD = f"WITH RECURSIVE {EVENT_CHANGES_SQL}, {fold_sql('changes', {1: RUN_1_AT, 2: RUN_2_AT})}"
OUTCOMES = f"""{FOLD} SELECT business_key, arrival_seq, outcome, version, epoch_us(held_clock) AS clock_us
FROM fold WHERE run_no = 2"""
LAST = "SELECT * FROM fold WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY n DESC) = 1"

QUERIES = {
    "merge_flagship": merge_flagship,
    "dedup_in_run": dedup_in_run,
    "merge_outcomes": _filtered(lambda results: results),
    "merge_stale": _filtered(M.merge_stale),
    "merge_unchanged": _filtered(M.merge_unchanged),
    "merge_soft_delete": _filtered(M.merge_soft_delete),
    "merge_resurrect": _filtered(M.merge_resurrect),
    "merge_before_after": merge_before_after,
    "merged_state": merged_state,
    "merge_sink": merge_sink,
    "active_records": active_records,
}
ORACLES = {
    "merge_flagship": f"""WITH RECURSIVE feed AS ({derived_sql('event_feed')}), changes AS (
        SELECT business_key, 1 AS run_no, arrival_seq, source_updated_at AS ts, deleted AS is_delete,
          CASE WHEN NOT deleted THEN event_type END AS content FROM feed
        QUALIFY lag(source_updated_at) OVER (PARTITION BY business_key ORDER BY arrival_seq) IS DISTINCT FROM source_updated_at),
        {fold_sql('changes', {1: RUN_1_AT})}
        SELECT outcome, count(*) AS changes, count(DISTINCT business_key) AS keys, max(version) AS highest_version
        FROM fold WHERE n > 0 GROUP BY outcome""",
    "dedup_in_run": f"""WITH feed AS ({derived_sql('event_feed')}), days AS (
        SELECT business_key, arrival_seq, date_trunc('day', source_updated_at) AS clock FROM feed)
        SELECT business_key, arrival_seq, epoch_us(CAST(clock AS TIMESTAMP)) AS clock_us FROM days
        QUALIFY lag(clock) OVER (PARTITION BY business_key ORDER BY arrival_seq) IS DISTINCT FROM clock""",
    "merge_outcomes": OUTCOMES,
    "merge_stale": f"{OUTCOMES} AND outcome = 'SKIPPED_STALE'",
    "merge_unchanged": f"{OUTCOMES} AND outcome = 'SKIPPED_UNCHANGED'",
    "merge_soft_delete": f"{OUTCOMES} AND outcome = 'DELETED'",
    "merge_resurrect": f"{OUTCOMES} AND outcome = 'CREATED' AND version > 1",
    "merge_before_after": f"""{FOLD} SELECT business_key, arrival_seq, outcome, before_content AS before_type,
        epoch_us(before_clock) AS before_us, after_content AS after_type, epoch_us(after_clock) AS after_us
        FROM fold WHERE run_no = 2""",
    "merged_state": f"""{FOLD} SELECT business_key, content AS event_type, epoch_us(clock) AS clock_us,
        sha256(content) AS content_fingerprint, version, epoch_us(deleted_at) AS deleted_at_us,
        epoch_us(first_at) AS first_synced_at_us, epoch_us(last_at) AS last_synced_at_us
        FROM ({LAST}) AS final WHERE present""",
    "active_records": f"""{FOLD} SELECT 'events' AS feed, count(*) AS active_records
        FROM ({LAST}) AS final WHERE present AND deleted_at IS NULL""",
}
ORACLES["merge_sink"] = ORACLES["merged_state"]
