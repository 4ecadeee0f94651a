"""Status views over a run log, drift events and quarantined records derived from the event feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.feeds import FEEDS, registered_feeds
from feedweave.functions.ordering import rows_at
from feedweave.operators import status as S
from workload.derived import derived, derived_sql
from workload.tables import table

AS_OF = "2024-01-31 00:01:00"
LIFECYCLE = """
SELECT CAST(event_id AS STRING) AS id, CASE WHEN user_id % 3 = 0 THEN 'customers' WHEN user_id % 3 = 1 THEN 'orders' ELSE 'gone' END AS feed,
       CASE WHEN event_type = 'error' THEN 'FIELD_ADDED' ELSE 'FIELD_RETYPED' END AS kind, ts AS detected_at, value, event_type,
       CASE WHEN value < 50 THEN 'CLOSED' ELSE 'OPEN' END AS life, event_id
FROM {events}
"""


def runs(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "run_log").withColumnRenamed("run_mode", "mode")


def _seconds(column: str, factor: int):
    return F.make_dt_interval(secs=F.floor(F.col(column) * factor).cast("decimal(18,6)"))


def drift(spark, sf_dir) -> DataFrame:
    """Events as drift events: some changed after they were detected, some have no source change."""
    rows = spark.sql(LIFECYCLE, events=table(spark, sf_dir, "events"))
    changed = F.when(F.col("event_type") == "view", F.lit(None)).when(
        F.col("event_type") == "click", F.col("detected_at") + _seconds("value", 1)
    ).otherwise(F.col("detected_at") - _seconds("value", 1))
    resolved = F.col("life") == "CLOSED"
    return rows.select(
        F.col("id").alias("event_id"),
        "feed",
        "kind",
        "detected_at",
        changed.alias("source_changed_at"),
        F.when(resolved, F.lit("RESOLVED")).otherwise(F.lit("OPEN")).alias("status"),
        F.when(resolved, F.col("detected_at") + _seconds("value", 2)).alias("resolved_at"),
    )


def quarantine(spark, sf_dir) -> DataFrame:
    rows = spark.sql(LIFECYCLE, events=table(spark, sf_dir, "events"))
    status = F.when(F.col("life") == "OPEN", F.lit("OPEN")).otherwise(F.lit("SUPERSEDED"))
    return rows.select(F.col("id").alias("quarantine_id"), "feed", F.col("detected_at").alias("quarantined_at"), status.alias("status"))


def health(spark, sf_dir) -> DataFrame:
    marks = table(spark, sf_dir, "events").groupBy(
        F.when(F.col("user_id") % 2 == 0, "customers").otherwise("orders").alias("feed")
    ).agg(F.max("ts").alias("watermark_ts"))
    active = table(spark, sf_dir, "orders").groupBy(
        F.when(F.col("o_orderstatus") == "F", "orders").otherwise("customers").alias("feed")
    ).agg(F.count(F.lit(1)).alias("active_records"))
    return S.feed_health(
        registered_feeds(spark), runs(spark, sf_dir), drift(spark, sf_dir),
        quarantine(spark, sf_dir), marks, active, AS_OF,
    )


def feed_health(spark, sf_dir):
    return health(spark, sf_dir).select(
        "feed", "protocol", "health", "running", F.unix_micros("watermark").alias("watermark_us"),
        F.col("last_run.run_id").alias("last_run_id"), F.col("last_success.run_id").alias("last_success_id"),
        "freshness_seconds", "lag_seconds", "open_drift_events", "open_quarantine", "active_records",
    )


def feed_summary(spark, sf_dir):
    summary = S.feed_summary(health(spark, sf_dir))
    return summary.withColumn("last_activity", F.unix_micros("last_activity")).withColumn("watermark", F.unix_micros("watermark"))


def feed_freshness(spark, sf_dir):
    return S.feed_freshness(runs(spark, sf_dir), AS_OF)


def feed_lag(spark, sf_dir):
    return S.feed_lag(runs(spark, sf_dir))


def overview_totals(spark, sf_dir):
    return S.overview_totals(runs(spark, sf_dir), quarantine(spark, sf_dir), drift(spark, sf_dir), registered_feeds(spark))


def mttd(spark, sf_dir):
    return S.mttd(drift(spark, sf_dir))


def mttr(spark, sf_dir):
    return S.mttr(drift(spark, sf_dir))


def _us(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in columns})


def list_runs(spark, sf_dir):
    return _us(S.list_runs(runs(spark, sf_dir), "orders", page=2, size=50), "started_at", "finished_at")


def list_runs_deep(spark, sf_dir):
    """The page in the middle of the run log, found by its rank."""
    log = runs(spark, sf_dir)
    page = log.count() // 2 // 20
    return _us(rows_at(log, "started_at", "run_id", page * 20, 20, most=50), "started_at", "finished_at")


def list_quarantine(spark, sf_dir):
    return _us(S.list_quarantine(quarantine(spark, sf_dir), "customers", page=1, size=200), "quarantined_at")


def list_drift(spark, sf_dir):
    listed = S.list_drift(drift(spark, sf_dir), page=3, size=100)
    return _us(listed, "detected_at", "source_changed_at", "resolved_at")


def run_series(spark, sf_dir):
    return _us(S.run_series(runs(spark, sf_dir)), "started_at")


def lag_series(spark, sf_dir):
    return _us(S.lag_series(runs(spark, sf_dir), list(FEEDS)), "started_at")


RUNS_SQL = f"runs AS (SELECT * RENAME (run_mode AS mode) FROM ({derived_sql('run_log')}) AS r)"
LIFE_SQL = f"life AS ({LIFECYCLE.format(events='events')})"
DRIFT_SQL = f"""{LIFE_SQL}, drift AS (SELECT id AS event_id, feed, kind, detected_at,
  CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN detected_at + to_seconds(CAST(floor(value) AS BIGINT)) ELSE detected_at - to_seconds(CAST(floor(value) AS BIGINT)) END AS source_changed_at,
  CASE WHEN life = 'CLOSED' THEN 'RESOLVED' ELSE 'OPEN' END AS status,
  CASE WHEN life = 'CLOSED' THEN detected_at + to_seconds(CAST(floor(value * 2) AS BIGINT)) END AS resolved_at FROM life)"""
QUARANTINE_SQL = "quarantine AS (SELECT id AS quarantine_id, feed, detected_at AS quarantined_at, CASE WHEN life = 'OPEN' THEN 'OPEN' ELSE 'SUPERSEDED' END AS status FROM life)"
ALL_SQL = f"{RUNS_SQL}, {DRIFT_SQL}, {QUARANTINE_SQL}"
LATEST = """last_run AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY feed ORDER BY started_at DESC, run_id DESC) = 1),
last_success AS (SELECT * FROM runs WHERE status IN ('SUCCEEDED', 'PARTIAL') QUALIFY row_number() OVER (PARTITION BY feed ORDER BY started_at DESC, run_id DESC) = 1)"""
AGE = f"CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(s.finished_at)) / 1000000) AS BIGINT)"
HEALTH_SQL = f"""{ALL_SQL}, {LATEST}, feeds(feed, protocol) AS (VALUES ('customers', 'REST'), ('orders', 'GraphQL')),
facts AS (SELECT f.feed, f.protocol, l.run_id AS last_run_id, l.status AS last_status, l.started_at, l.finished_at, l.extracted AS last_extracted, l.loaded AS last_loaded,
    l.skipped AS last_skipped, l.quarantined AS last_quarantined, s.run_id AS last_success_id, {AGE} AS freshness_seconds,
    coalesce(CASE WHEN l.status <> 'RUNNING' THEN l.max_lag_seconds END, s.max_lag_seconds) AS lag_seconds,
    (SELECT count(*) FROM drift AS d WHERE d.feed = f.feed AND d.status = 'OPEN') AS open_drift_events,
    (SELECT count(*) FROM quarantine AS q WHERE q.feed = f.feed AND q.status = 'OPEN') AS open_quarantine,
    (SELECT count(*) FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN 'orders' ELSE 'customers' END = f.feed) AS active_records,
    (SELECT epoch_us(max(ts)) FROM events WHERE CASE WHEN user_id % 2 = 0 THEN 'customers' ELSE 'orders' END = f.feed) AS watermark_us,
    EXISTS (SELECT 1 FROM runs AS r WHERE r.feed = f.feed AND r.status = 'RUNNING') AS running
  FROM feeds AS f LEFT JOIN last_run AS l USING (feed) LEFT JOIN last_success AS s USING (feed)),
judged AS (SELECT *, CASE WHEN last_run_id IS NULL THEN 'NEVER_RUN' WHEN last_status = 'FAILED' THEN 'FAILING' WHEN open_drift_events > 0 THEN 'DRIFT'
    WHEN freshness_seconds IS NULL OR freshness_seconds > 300 THEN 'STALE' ELSE 'HEALTHY' END AS health FROM facts)"""


def _clamped(start: str, end: str) -> str:
    return f"CASE WHEN {start} IS NOT NULL AND {end} IS NOT NULL THEN greatest(0, CAST(floor((epoch_us({end}) - epoch_us({start})) / 1000000) AS BIGINT)) END"


def _paged(relation: str, where: str, order: str, page: int, size: int, columns: str) -> str:
    return f"""SELECT {columns}, {page} AS page, {size} AS size, (SELECT count(*) FROM {relation} WHERE {where}) AS total_elements,
      CAST(ceil((SELECT count(*) FROM {relation} WHERE {where}) / {size}) AS BIGINT) AS total_pages
      FROM {relation} WHERE {where} ORDER BY {order} LIMIT {size} OFFSET {page * size}"""


SERIES = "SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 30"
QUERIES = {
    "feed_health": feed_health,
    "feed_freshness": feed_freshness,
    "feed_lag": feed_lag,
    "overview_totals": overview_totals,
    "mttd": mttd,
    "mttr": mttr,
    "list_runs": list_runs,
    "list_runs_deep": list_runs_deep,
    "list_quarantine": list_quarantine,
    "list_drift": list_drift,
    "run_series": run_series,
    "lag_series": lag_series,
    "feed_summary": feed_summary,
}
ORACLES = {
    "feed_health": f"""WITH {HEALTH_SQL} SELECT feed, protocol, health, running, watermark_us, last_run_id, last_success_id, freshness_seconds, lag_seconds,
        open_drift_events, open_quarantine, active_records FROM judged""",
    "feed_summary": f"""WITH {HEALTH_SQL} SELECT feed, protocol, health, running, last_run_id, last_status, epoch_us(coalesce(finished_at, started_at)) AS last_activity,
        last_extracted, last_loaded, last_skipped, last_quarantined, freshness_seconds, lag_seconds, watermark_us AS watermark, active_records, open_drift_events,
        open_quarantine FROM judged""",
    "feed_freshness": f"""WITH {RUNS_SQL}, {LATEST} SELECT l.feed, {AGE} AS freshness_seconds FROM last_run AS l LEFT JOIN last_success AS s USING (feed)""",
    "feed_lag": f"""WITH {RUNS_SQL}, {LATEST} SELECT l.feed, coalesce(CASE WHEN l.status <> 'RUNNING' THEN l.max_lag_seconds END, s.max_lag_seconds) AS lag_seconds
        FROM last_run AS l LEFT JOIN last_success AS s USING (feed)""",
    "overview_totals": f"""WITH {ALL_SQL} SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'PARTIAL') AS partial,
        count(*) FILTER (WHERE status = 'FAILED') AS failed, CAST(sum(loaded) AS BIGINT) AS loaded, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(quarantined) AS BIGINT) AS quarantined,
        (SELECT count(*) FROM quarantine WHERE status = 'OPEN' AND feed IN ('customers', 'orders')) AS open_quarantine,
        (SELECT count(*) FROM drift WHERE status = 'OPEN' AND feed IN ('customers', 'orders')) AS open_drift_events FROM runs""",
    "mttd": f"WITH {DRIFT_SQL} SELECT CAST(floor(avg({_clamped('source_changed_at', 'detected_at')})) AS BIGINT) AS mttd_seconds FROM drift",
    "mttr": f"WITH {DRIFT_SQL} SELECT CAST(floor(avg({_clamped('detected_at', 'resolved_at')})) AS BIGINT) AS mttr_seconds FROM drift",
    "list_runs": f"WITH {RUNS_SQL} " + _paged("runs", "feed = 'orders'", "started_at DESC, run_id", 2, 50,
        "* REPLACE (epoch_us(started_at) AS started_at, epoch_us(finished_at) AS finished_at), (epoch_us(finished_at) - epoch_us(started_at)) // 1000 AS duration_ms")
        .replace("ORDER BY started_at", "ORDER BY runs.started_at"),
    "list_runs_deep": f"""WITH {RUNS_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, run_id) - 1 AS pos, count(*) OVER () // 2 // 20 AS page FROM runs)
        SELECT * EXCLUDE (pos, page) REPLACE (epoch_us(started_at) AS started_at, epoch_us(finished_at) AS finished_at) FROM numbered WHERE pos // 20 = page""",
    "list_quarantine": f"WITH {LIFE_SQL}, {QUARANTINE_SQL} " + _paged("quarantine", "feed = 'customers' AND status = 'OPEN'", "quarantine.quarantined_at DESC, quarantine_id", 1, 200,
        "* REPLACE (epoch_us(quarantined_at) AS quarantined_at)"),
    "list_drift": f"WITH {DRIFT_SQL} " + _paged("drift", "true", "drift.detected_at DESC, event_id", 3, 100,
        f"""* REPLACE (epoch_us(detected_at) AS detected_at, epoch_us(source_changed_at) AS source_changed_at, epoch_us(resolved_at) AS resolved_at),
        CASE kind WHEN 'FIELD_ADDED' THEN 'WARNING' ELSE 'BLOCKING' END AS severity, {_clamped('source_changed_at', 'detected_at')} AS time_to_detect_seconds,
        {_clamped('detected_at', 'resolved_at')} AS time_to_resolve_seconds"""),
    "run_series": f"WITH {RUNS_SQL} SELECT run_id, epoch_us(started_at) AS started_at, feed, loaded, skipped, quarantined, max_lag_seconds FROM ({SERIES}) AS s",
    "lag_series": f"""WITH {RUNS_SQL} SELECT run_id, epoch_us(started_at) AS started_at, CASE WHEN feed = 'customers' THEN max_lag_seconds END AS lag_customers,
        CASE WHEN feed = 'orders' THEN max_lag_seconds END AS lag_orders FROM ({SERIES}) AS s""",
}
