"""Drift-event lifecycle: every event of the event feed is taken as one finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.operators import drift_events as E
from feedweave.session import materialize
from workload.derived import derived, derived_sql
from workload.queries.merging import RUN_1, RUN_1_AT, RUN_2, RUN_2_AT, SPLIT, _at

RESOLVED_AT = "2024-02-01 12:00:00"
DECIDED_AT = "2024-02-03 00:00:00"
FROM, TO = "2024-01-01 06:00:00", "2024-01-02 18:00:00"
NOTE = "fixed at the source"


def findings(spark, sf_dir, run: int) -> DataFrame:
    feed = derived(spark, sf_dir, "event_feed")
    second = F.col("source_updated_at") > _at(SPLIT)
    field = F.concat(F.lit("field_"), F.col("business_key"))
    kind = F.when(F.col("event_type") == "view", F.lit("FIELD_ADDED")).otherwise(F.lit("FIELD_MISSING"))
    return feed.where(second if run == 2 else ~second).select(
        F.when(F.col("business_key").cast("bigint") % 2 == 0, F.lit("customers")).otherwise(F.lit("orders")).alias("feed"),
        "source_updated_at",
        "arrival_seq",
        F.lit(0).alias("finding_no"),
        kind.alias("kind"),
        field.alias("field"),
        F.lit("STRING").alias("expected"),
        F.lit(None).cast("string").alias("actual"),
        F.repeat(F.concat(F.lit("event "), F.col("event_id"), F.lit(" ")), F.lit(150)).alias("details"),
        F.concat_ws(":", kind, field, F.lit("STRING->-")).alias("fingerprint"),
    )


def drift_table(spark, sf_dir) -> DataFrame:
    """Events after two runs; between them the events of every third key were resolved."""
    empty = spark.createDataFrame([], E.SCHEMA)
    first = materialize(E.drift_event_upsert(empty, findings(spark, sf_dir, 1), RUN_1, _at(RUN_1_AT)))
    third = F.regexp_extract("field", "([0-9]+)", 1).cast("bigint") % 3 == 0
    done = first.where(third).select("event_id", F.lit(NOTE).alias("note"))
    resolved = E.drift_event_resolve(first, done, _at(RESOLVED_AT))
    return E.drift_event_upsert(resolved, findings(spark, sf_dir, 2), RUN_2, _at(RUN_2_AT))


def shown(df: DataFrame) -> DataFrame:
    times = ("source_changed_at", "detected_at", "last_seen_at", "resolved_at")
    plain = [c for c in E.COLUMNS if c not in times]
    return df.select(*plain, *[F.unix_micros(c).alias(f"{c}_us") for c in times])


def drift_event_upsert(spark, sf_dir):
    return shown(drift_table(spark, sf_dir))


def drift_event_resolve(spark, sf_dir):
    events = materialize(drift_table(spark, sf_dir))
    decided = events.where(F.left("event_id", F.lit(1)).between("0", "9")).select(
        "event_id", F.concat(F.lit("decided for "), F.col("field")).alias("note")
    )
    return shown(E.drift_event_resolve(events, decided, _at(DECIDED_AT)))


def drift_event_resolve_all(spark, sf_dir):
    return shown(E.drift_event_resolve_all(drift_table(spark, sf_dir), "customers", NOTE, _at(DECIDED_AT)))


def drift_event_resolve_within(spark, sf_dir):
    return shown(E.drift_event_resolve_within(drift_table(spark, sf_dir), "orders", FROM, TO, NOTE, _at(DECIDED_AT)))


def clean_backfill_resolution(spark, sf_dir):
    run = {
        "run_id": "run-9",
        "feed": "orders",
        "mode": "BACKFILL",
        "status": "SUCCEEDED",
        "drift_detected": False,
        "extracted": derived(spark, sf_dir, "event_feed").where(F.col("source_updated_at").between(_at(FROM), _at(TO))).count(),
        "backfill_from": FROM,
        "backfill_to": TO,
    }
    return shown(E.clean_backfill_resolution(drift_table(spark, sf_dir), run, _at(DECIDED_AT)))


TABLE_SQL = f"""feed AS ({derived_sql('event_feed')}),
findings AS (SELECT CASE WHEN CAST(business_key AS BIGINT) % 2 = 0 THEN 'customers' ELSE 'orders' END AS feed, CAST(business_key AS BIGINT) AS key_no,
    CASE WHEN event_type = 'view' THEN 'FIELD_ADDED' ELSE 'FIELD_MISSING' END AS kind, 'field_' || business_key AS field, arrival_seq, event_id, source_updated_at,
    CASE WHEN source_updated_at <= TIMESTAMP '{SPLIT}' THEN 1 ELSE 2 END AS run_no FROM feed),
-- An event spans both runs unless it was resolved between them: then each run has its own.
grouped AS (SELECT feed, kind, field, key_no, CASE WHEN key_no % 3 = 0 THEN run_no ELSE 0 END AS part, count(*) AS affected_records,
    min(run_no) AS first_run, max(run_no) AS last_run, min(source_updated_at) AS changed, arg_min(event_id, (run_no, arrival_seq)) AS first_event
  FROM findings GROUP BY ALL),
events AS (SELECT sha256(feed || '|' || kind || ':' || field || ':STRING->-' || '|run-' || first_run) AS event_id, feed, kind || ':' || field || ':STRING->-' AS fingerprint,
    kind, field, 'STRING' AS expected, CAST(NULL AS VARCHAR) AS actual, left(repeat('event ' || first_event || ' ', 150), 1000) AS details, affected_records,
    'run-' || first_run AS first_run_id, 'run-' || last_run AS last_run_id, changed AS source_changed_at,
    CASE first_run WHEN 1 THEN TIMESTAMP '{RUN_1_AT}' ELSE TIMESTAMP '{RUN_2_AT}' END AS detected_at,
    CASE last_run WHEN 1 THEN TIMESTAMP '{RUN_1_AT}' ELSE TIMESTAMP '{RUN_2_AT}' END AS last_seen_at,
    CASE WHEN part = 1 THEN 'RESOLVED' ELSE 'OPEN' END AS status, CASE WHEN part = 1 THEN TIMESTAMP '{RESOLVED_AT}' END AS resolved_at,
    CASE WHEN part = 1 THEN '{NOTE}' END AS resolution_note FROM grouped)"""
SHOWN = """* EXCLUDE (source_changed_at, detected_at, last_seen_at, resolved_at), epoch_us(source_changed_at) AS source_changed_at_us,
  epoch_us(detected_at) AS detected_at_us, epoch_us(last_seen_at) AS last_seen_at_us, epoch_us(resolved_at) AS resolved_at_us"""


def _resolved(hits: str, note: str) -> str:
    hits = f"status = 'OPEN' AND {hits}"
    return f"""WITH {TABLE_SQL}, decided AS (SELECT * REPLACE (CASE WHEN {hits} THEN 'RESOLVED' ELSE status END AS status,
        CASE WHEN {hits} THEN TIMESTAMP '{DECIDED_AT}' ELSE resolved_at END AS resolved_at,
        CASE WHEN {hits} THEN {note} ELSE resolution_note END AS resolution_note) FROM events) SELECT {SHOWN} FROM decided"""


WITHIN = f"feed = 'orders' AND source_changed_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"
QUERIES = {
    "drift_event_upsert": drift_event_upsert,
    "drift_event_resolve": drift_event_resolve,
    "drift_event_resolve_all": drift_event_resolve_all,
    "drift_event_resolve_within": drift_event_resolve_within,
    "clean_backfill_resolution": clean_backfill_resolution,
}
ORACLES = {
    "drift_event_upsert": f"WITH {TABLE_SQL} SELECT {SHOWN} FROM events",
    "drift_event_resolve": _resolved("left(event_id, 1) BETWEEN '0' AND '9'", "'decided for ' || field"),
    "drift_event_resolve_all": _resolved("feed = 'customers'", f"'{NOTE}'"),
    "drift_event_resolve_within": _resolved(WITHIN, f"'{NOTE}'"),
    "clean_backfill_resolution": _resolved(WITHIN, "'resolved by clean backfill run run-9'"),
}
