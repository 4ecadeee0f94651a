"""Run counters, status and watermarks; whole runs over the customer feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.feeds import CUSTOMER_FEED
from feedweave.operators import runs as R
from feedweave.operators import watermarks as W
from feedweave.operators.drift_events import SCHEMA as DRIFT_SCHEMA
from feedweave.plans.process import check_records, keep_checked, process_batch
from feedweave.session import stored
from feedweave.sources import change_feed as S
from workload.derived import derived, derived_sql
from workload.queries.drift import CONTRACT_SQL, FINGERPRINTED
from workload.queries.mapping import CUSTOMERS_SQL, ROW_CUSTOMER
from workload.queries.merging import _at, fold_sql
from workload.queries.scans import ALL_FEEDS, _feeds
from workload.tables import table

RESULTS = """
SELECT CASE WHEN user_id % 2 = 0 THEN 'customers' ELSE 'orders' END || '-' || CAST(date_trunc('hour', ts) AS STRING) AS run_id,
       CASE WHEN user_id % 2 = 0 THEN 'customers' ELSE 'orders' END AS feed,
       CASE event_type WHEN 'purchase' THEN 'LOADED' WHEN 'click' THEN 'LOADED' WHEN 'view' THEN 'SKIPPED'
            WHEN 'error' THEN 'QUARANTINED' ELSE 'REPEATED' END AS fate,
       value > 200 AS drift_detected, ts AS source_updated_at, event_id
FROM {events}
"""
# How long after its source change a record was processed; some clocks run ahead.
DELAY = "floor(value) - 20"


def record_results(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    timed = spark.sql(RESULTS.replace("event_id\n", f"event_id, ts + make_dt_interval(0, 0, 0, {DELAY}) AS processed_at\n"), events=events)
    return timed


def run_counters(spark, sf_dir):
    return R.run_counters(record_results(spark, sf_dir))


def run_status(spark, sf_dir):
    counters = run_counters(spark, sf_dir)
    failure = F.when(F.col("extracted") == 1, F.repeat(F.col("run_id"), F.lit(200)))
    return counters.select(
        "run_id",
        R.run_status(F.col("quarantined"), failure).alias("status"),
        F.length(R.error_text(failure)).alias("error_length"),
    )


def newest_watermark(spark, sf_dir):
    marks = W.newest_watermark(_feeds(spark, sf_dir))
    return marks.select("feed", F.unix_micros("watermark_ts").alias("watermark_us"), "watermark_key")


HELD_UNTIL, OLD_UNTIL, MOVED_AT = "2024-01-15 00:00:00", "2024-01-10 00:00:00", "2024-02-05 00:00:00"


def advance_watermark(spark, sf_dir):
    """A mark per user: users with odd numbers offer an old position, users with a number above 60 have no mark yet."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("feed-"), F.col("user_id")).alias("feed"),
        "user_id",
        F.col("ts").alias("source_updated_at"),
        F.col("event_id").cast("string").alias("business_key"),
    )
    held = W.newest_watermark(events.where((F.col("source_updated_at") <= _at(HELD_UNTIL)) & (F.col("user_id") <= 60)))
    even = F.col("user_id") % 2 == 0
    offered = W.newest_watermark(events.where(even | (F.col("source_updated_at") <= _at(OLD_UNTIL))))
    moved = W.advance_watermark(held.withColumn("updated_at", _at(HELD_UNTIL)), offered, _at(MOVED_AT))
    return moved.select(
        "feed",
        F.unix_micros("watermark_ts").alias("watermark_us"),
        "watermark_key",
        F.unix_micros("updated_at").alias("updated_us"),
    )


FIRST_UNTIL = "1998-06-01 00:00:00"
BACKFILL = ("1997-01-01 00:00:00", "1999-01-01 00:00:00")
RUN_AT = {1: "2024-03-01 00:00:00", 2: "2024-03-02 00:00:00", 3: "2024-03-03 00:00:00"}


def _run(spark, records, run_no, state):
    checked = keep_checked(check_records(records, CUSTOMER_FEED))
    empty = spark.createDataFrame([], DRIFT_SCHEMA)
    keep = lambda df, name: stored(df)
    return process_batch(checked, CUSTOMER_FEED, state, None, empty, f"run-{run_no}", RUN_AT[run_no], keep=keep)


def _run_row(outcome, mode):
    status = R.run_status(F.col("quarantined"), F.lit(None).cast("string"))
    return outcome.counters.withColumns({"run_mode": F.lit(mode), "status": status})


def _runs(spark, sf_dir, upto):
    """Incremental run up to a date, incremental run of the rest, backfill of two years."""
    feed = derived(spark, sf_dir, "customer_feed").drop("flaw")
    first_part = S.in_window(feed, None, FIRST_UNTIL)
    state, rows = None, []
    for run_no in range(1, upto + 1):
        if run_no == 1:
            records = first_part
        elif run_no == 2:
            mark = S.read_watermark(W.newest_watermark(first_part), "customers")
            records = S.incremental_window(feed, mark)
        else:
            records = S.in_window(feed, *BACKFILL)
        outcome = _run(spark, records, run_no, state)
        state = stored(outcome.state) if run_no < upto else outcome.state
        rows.append(_run_row(outcome, "INCREMENTAL" if run_no < 3 else "BACKFILL"))
    return state, rows


def run_incremental(spark, sf_dir):
    _, rows = _runs(spark, sf_dir, 2)
    return rows[0].unionByName(rows[1])


def run_backfill(spark, sf_dir):
    _, rows = _runs(spark, sf_dir, 3)
    return rows[2]


def run_incremental_state(spark, sf_dir):
    state, _ = _runs(spark, sf_dir, 2)
    return state.select(
        "business_key",
        *[c for c in CUSTOMER_FEED.destination.columns if c != "source_created_at"],
        F.unix_micros("source_updated_at").alias("clock_us"),
        "version",
        *[F.unix_micros(c).alias(f"{c}_us") for c in ("deleted_at", "first_synced_at", "last_synced_at")],
    )


RUN_SQL = f"""
window_rows AS (
  SELECT f.*, 1 AS run_no FROM ({derived_sql('customer_feed')}) AS f WHERE source_updated_at <= TIMESTAMP '{FIRST_UNTIL}'
  UNION ALL SELECT f.*, 2 FROM ({derived_sql('customer_feed')}) AS f WHERE source_updated_at > (
    SELECT max(source_updated_at) FROM ({derived_sql('customer_feed')}) AS g WHERE source_updated_at <= TIMESTAMP '{FIRST_UNTIL}') - INTERVAL 5 SECOND
  UNION ALL SELECT f.*, 3 FROM ({derived_sql('customer_feed')}) AS f WHERE source_updated_at > TIMESTAMP '{BACKFILL[0]}' AND source_updated_at <= TIMESTAMP '{BACKFILL[1]}'),
repeats AS (SELECT *, lag(source_updated_at) OVER (PARTITION BY run_no, business_key ORDER BY arrival_seq) IS NOT DISTINCT FROM source_updated_at AS is_repeat FROM window_rows),
drifted AS (WITH {CONTRACT_SQL}, {FINGERPRINTED} SELECT arrival_seq, bool_or(severity = 'BLOCKING') AS blocking FROM prints WHERE feed = 'customers' AND NOT deleted GROUP BY 1),
failed AS (WITH {CUSTOMERS_SQL} SELECT arrival_seq, failure_kind FROM customers),
contents AS (WITH {CUSTOMERS_SQL} SELECT * FROM ({ROW_CUSTOMER}) AS r),
checked AS (SELECT r.business_key, r.run_no, r.arrival_seq, r.source_updated_at AS ts, r.deleted AS is_delete, r.is_repeat,
    NOT r.is_repeat AND d.blocking IS NOT NULL AS drift_detected, NOT r.is_repeat AND (coalesce(d.blocking, false) OR f.failure_kind IS NOT NULL) AS rejected,
    concat_ws('|', c.email_address, c.full_name, c.given_name, c.family_name, c.lifecycle_code, c.tier_rank, c.address_line, c.city, c.postal_code, c.country_code, c.tags_csv, c.created_at) AS content
  FROM repeats AS r LEFT JOIN drifted AS d USING (arrival_seq) LEFT JOIN failed AS f USING (arrival_seq) LEFT JOIN contents AS c USING (arrival_seq)),
changes AS (SELECT business_key, run_no, arrival_seq, ts, is_delete, CASE WHEN NOT is_delete THEN content END AS content FROM checked WHERE NOT is_repeat AND NOT rejected),
{fold_sql('changes', RUN_AT)},
fates AS (SELECT c.run_no, c.drift_detected, c.ts, CASE WHEN is_repeat THEN 'REPEATED' WHEN rejected THEN 'QUARANTINED'
    WHEN outcome IN ('CREATED', 'UPDATED', 'DELETED') THEN 'LOADED' ELSE 'SKIPPED' END AS fate
  FROM checked AS c LEFT JOIN fold AS f ON f.run_no = c.run_no AND f.arrival_seq = c.arrival_seq AND f.business_key = c.business_key)"""
RUN_ROWS = f"""WITH RECURSIVE {RUN_SQL} SELECT 'run-' || run_no AS run_id, 'customers' AS feed, count(*) AS extracted,
  count(*) FILTER (WHERE fate IN ('LOADED', 'SKIPPED')) AS transformed, count(*) FILTER (WHERE fate = 'LOADED') AS loaded,
  count(*) FILTER (WHERE fate IN ('SKIPPED', 'REPEATED')) AS skipped, count(*) FILTER (WHERE fate = 'QUARANTINED') AS quarantined, 0 AS failed,
  bool_or(drift_detected) AS drift_detected,
  max(CASE WHEN fate = 'LOADED' THEN CAST(epoch(CASE run_no WHEN 1 THEN TIMESTAMP '{RUN_AT[1]}' WHEN 2 THEN TIMESTAMP '{RUN_AT[2]}' ELSE TIMESTAMP '{RUN_AT[3]}' END - ts) AS BIGINT) END) AS max_lag_seconds,
  CASE run_no WHEN 3 THEN 'BACKFILL' ELSE 'INCREMENTAL' END AS run_mode,
  CASE WHEN count(*) FILTER (WHERE fate = 'QUARANTINED') > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status
  FROM fates GROUP BY run_no"""

COUNTERS_SQL = f"""results AS ({RESULTS.format(events='events')}), timed AS (SELECT r.*, CAST(floor(e.value) - 20 AS BIGINT) AS delay FROM results AS r JOIN events AS e USING (event_id)),
counters AS (SELECT run_id, feed, count(*) AS extracted, count(*) FILTER (WHERE fate IN ('LOADED', 'SKIPPED')) AS transformed,
  count(*) FILTER (WHERE fate = 'LOADED') AS loaded, count(*) FILTER (WHERE fate IN ('SKIPPED', 'REPEATED')) AS skipped,
  count(*) FILTER (WHERE fate = 'QUARANTINED') AS quarantined, 0 AS failed, bool_or(drift_detected) AS drift_detected,
  max(CASE WHEN fate = 'LOADED' THEN greatest(0, delay) END) AS max_lag_seconds FROM timed GROUP BY 1, 2)"""
USER_MARK = """SELECT 'feed-' || user_id AS feed, user_id, ts AS mark, CAST(event_id AS VARCHAR) AS mark_key FROM events WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) = 1"""

QUERIES = {
    "run_incremental": run_incremental,
    "run_incremental_state": run_incremental_state,
    "run_backfill": run_backfill,
    "run_counters": run_counters,
    "run_status": run_status,
    "newest_watermark": newest_watermark,
    "advance_watermark": advance_watermark,
}
ORACLES = {
    "run_incremental": f"SELECT * FROM ({RUN_ROWS}) AS r WHERE run_id IN ('run-1', 'run-2')",
    "run_backfill": f"SELECT * FROM ({RUN_ROWS}) AS r WHERE run_id = 'run-3'",
    "run_incremental_state": f"""WITH RECURSIVE {RUN_SQL}, final AS (SELECT * FROM fold WHERE n > 0 AND run_no <= 2
          QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY n DESC) = 1)
        SELECT business_key, split_part(content, '|', 1) AS email_address, split_part(content, '|', 2) AS full_name, split_part(content, '|', 3) AS given_name,
          split_part(content, '|', 4) AS family_name, split_part(content, '|', 5) AS lifecycle_code, CAST(split_part(content, '|', 6) AS INTEGER) AS tier_rank,
          split_part(content, '|', 7) AS address_line, split_part(content, '|', 8) AS city, split_part(content, '|', 9) AS postal_code,
          split_part(content, '|', 10) AS country_code, split_part(content, '|', 11) AS tags_csv, epoch_us(clock) AS clock_us, version,
          epoch_us(deleted_at) AS deleted_at_us, epoch_us(first_at) AS first_synced_at_us, epoch_us(last_at) AS last_synced_at_us FROM final WHERE present""",
    "run_counters": f"WITH {COUNTERS_SQL} SELECT * FROM counters",
    "run_status": f"""WITH {COUNTERS_SQL} SELECT run_id, CASE WHEN extracted = 1 THEN 'FAILED' WHEN quarantined > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status,
        CASE WHEN extracted = 1 THEN length(left(repeat(run_id, 200), 2000)) END AS error_length FROM counters""",
    "newest_watermark": f"""{ALL_FEEDS}, everything AS (SELECT feed, business_key, source_updated_at FROM customers_feed
          UNION ALL SELECT feed, business_key, source_updated_at FROM orders_feed UNION ALL SELECT feed, business_key, source_updated_at FROM events_feed)
        SELECT feed, epoch_us(source_updated_at) AS watermark_us, business_key AS watermark_key FROM everything
        QUALIFY row_number() OVER (PARTITION BY feed ORDER BY source_updated_at DESC, business_key DESC) = 1""",
    "advance_watermark": f"""WITH held AS ({USER_MARK.format(where=f"ts <= TIMESTAMP '{HELD_UNTIL}' AND user_id <= 60")}),
        offered AS ({USER_MARK.format(where=f"user_id % 2 = 0 OR ts <= TIMESTAMP '{OLD_UNTIL}'")}),
        paired AS (SELECT coalesce(h.feed, o.feed) AS feed, h.mark AS hm, h.mark_key AS hk, o.mark AS om, o.mark_key AS ok,
          o.mark IS NOT NULL AND (h.mark IS NULL OR o.mark > h.mark) AS moves FROM held AS h FULL JOIN offered AS o USING (feed))
        SELECT feed, epoch_us(CASE WHEN moves THEN om ELSE hm END) AS watermark_us, CASE WHEN moves THEN ok ELSE hk END AS watermark_key,
          epoch_us(CASE WHEN moves THEN TIMESTAMP '{MOVED_AT}' ELSE TIMESTAMP '{HELD_UNTIL}' END) AS updated_us FROM paired""",
}
