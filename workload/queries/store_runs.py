"""Whole runs of the customer feed through the runner and its store: incremental runs, a backfill, bounded reads, publishing."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.feeds import CUSTOMER_FEED
from feedweave.plans.run import FeedRunner
from feedweave.session import materialize, shared_folder
from feedweave.sinks.store import FeedStore
from feedweave.sources import change_feed as S
from workload.derived import derived
from workload.queries.outbox import acks
from workload.queries.runs import BACKFILL, FIRST_UNTIL, RUN_AT, RUN_SQL
from workload.queries.scans import landed_pages

PUBLISHED_AT = "2024-03-04 00:00:00"
BUCKETS = 16


def _new_store(spark) -> FeedStore:
    return FeedStore(spark, f"{shared_folder(spark)}/feeds-{uuid4().hex}", CUSTOMER_FEED, buckets=BUCKETS)


def _runner(store: FeedStore, at: str) -> FeedRunner:
    return FeedRunner(CUSTOMER_FEED, store, clock=lambda: datetime.fromisoformat(at))


def three_runs(spark, sf_dir) -> FeedStore:
    """The feed up to a date, then from the stored watermark on, then two years once more."""
    feed = derived(spark, sf_dir, "customer_feed").drop("flaw")
    store = _new_store(spark)
    _runner(store, RUN_AT[1]).run_incremental(S.in_window(feed, None, FIRST_UNTIL))
    _runner(store, RUN_AT[2]).run_incremental(feed)
    start, end = map(datetime.fromisoformat, BACKFILL)
    _runner(store, RUN_AT[3]).run_backfill(feed, start, end)
    return store


#: Stores after the three runs that queries only read from, by application and tables.
_KEPT: dict[tuple[str, str], FeedStore] = {}


def kept_runs(spark, sf_dir) -> FeedStore:
    """The three runs, made once for all queries that look at what they left."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _KEPT:
        _KEPT[key] = three_runs(spark, sf_dir)
    return _KEPT[key]


def _run_rows(store: FeedStore) -> DataFrame:
    marks = {f"{c}_us": F.unix_micros(c) for c in ("watermark_before", "watermark_after", "started_at")}
    return store.read_log("runs").withColumns(marks).drop(
        "watermark_before", "watermark_after", "started_at", "finished_at", "backfill_from", "backfill_to"
    )


def store_runs(spark, sf_dir):
    return _run_rows(kept_runs(spark, sf_dir))


def store_state(spark, sf_dir):
    return _state_rows(kept_runs(spark, sf_dir).read_state(), [c for c in CUSTOMER_FEED.destination.columns if c != "source_created_at"])


def _state_rows(state: DataFrame, content: list[str]) -> DataFrame:
    return state.select(
        "business_key",
        *content,
        F.unix_micros("source_updated_at").alias("clock_us"),
        "version",
        *[F.unix_micros(c).alias(f"{c}_us") for c in ("deleted_at", "first_synced_at", "last_synced_at")],
    )


def store_pending(spark, sf_dir):
    pending = kept_runs(spark, sf_dir).read_set("outbox_pending")
    return pending.select("event_id", "business_key", "event_type", "version", F.unix_micros("created_at").alias("created_us"))


def run_pages(spark, sf_dir):
    """Every landed page of the feed in one run, however many there are."""
    pages = landed_pages(derived(spark, sf_dir, "customer_feed"))
    store = _new_store(spark)
    _runner(store, RUN_AT[1]).run_pages(pages)
    return _run_rows(store)


def bounded_runs(spark, sf_dir):
    """The destination after bounded reads of the landed pages, each of which goes on where the one before stopped."""
    pages = materialize(landed_pages(derived(spark, sf_dir, "customer_feed"), endless=True))
    store = _new_store(spark)
    runner = _runner(store, RUN_AT[1])
    half = -(-pages.agg(F.max("page_no")).first()[0] // 2)
    for _ in range(2):
        runner.run_next_pages(pages, half)
    return store.read_state().select(
        "business_key",
        *[c for c in CUSTOMER_FEED.destination.columns if c != "source_created_at"],
        F.unix_micros("source_updated_at").alias("clock_us"),
        "version",
        F.col("deleted_at").isNotNull().alias("is_deleted"),
    )


def _one_run(spark, sf_dir) -> FeedRunner:
    """A store with the pending events of one run over the whole feed."""
    store = _new_store(spark)
    _runner(store, RUN_AT[1]).run_incremental(derived(spark, sf_dir, "customer_feed").drop("flaw"))
    return _runner(store, PUBLISHED_AT)


def _published(passed: DataFrame) -> DataFrame:
    return passed.select(
        "event_id", "business_key", "version", "pass_result", "attempts", "last_error", F.unix_micros("published_at").alias("published_us")
    )


def publish_all(spark, sf_dir):
    """A pass of tasks over the whole outbox, whose transport takes everything; keys with over two events in rounds."""
    return _published(_one_run(spark, sf_dir).publish_all(lambda events: [None] * events.num_rows, limit=2))


def publish_all_refusing(spark, sf_dir):
    """The same with a transport that refuses every event whose id starts with 0."""

    def send(events):
        return [f"refused {e}" if e[0] == "0" else None for e in events.column("event_id").to_pylist()]

    return _published(_one_run(spark, sf_dir).publish_all(send))


def _recording(folder: str) -> Callable[[DataFrame], DataFrame]:
    """A transport that notes what it is given and answers like the one of the outbox queries."""

    def transport(due: DataFrame) -> DataFrame:
        due.select("event_id", "business_key", "version").write.mode("append").parquet(folder)
        return acks(due)

    return transport


def publish_run(spark, sf_dir):
    """What a transport was given in one publish pass after the three runs, and how often."""
    store = three_runs(spark, sf_dir)
    folder = f"{shared_folder(spark)}/handed-over-{uuid4().hex}"
    _runner(store, PUBLISHED_AT).publish(_recording(folder))
    given = spark.read.schema("event_id string, business_key string, version int").parquet(folder)
    return given.groupBy("event_id", "business_key", "version").agg(F.count(F.lit(1)).alias("times"))


def _rows_sql(run_sql: str, feed: str = "customers") -> str:
    """Rows of the run log, counted from the fate of every record."""
    started = f"CASE run_no WHEN 1 THEN TIMESTAMP '{RUN_AT[1]}' WHEN 2 THEN TIMESTAMP '{RUN_AT[2]}' ELSE TIMESTAMP '{RUN_AT[3]}' END"
    return f"""WITH RECURSIVE {run_sql},
    counted AS (SELECT run_no, count(*) AS extracted, count(*) FILTER (WHERE fate IN ('LOADED', 'SKIPPED')) AS transformed,
        count(*) FILTER (WHERE fate = 'LOADED') AS loaded, count(*) FILTER (WHERE fate IN ('SKIPPED', 'REPEATED')) AS skipped,
        count(*) FILTER (WHERE fate = 'QUARANTINED') AS quarantined, bool_or(drift_detected) AS drift_detected,
        max(CASE WHEN fate = 'LOADED' THEN CAST(epoch({started} - ts) AS BIGINT) END) AS max_lag_seconds,
        CASE WHEN run_no < 3 THEN max(ts) END AS mark FROM fates GROUP BY run_no),
    marked AS (SELECT *, max(mark) OVER (ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        max(mark) OVER (ORDER BY run_no) AS after FROM counted)
    SELECT '{feed}-' || run_no AS run_id, '{feed}' AS feed, CASE run_no WHEN 3 THEN 'BACKFILL' ELSE 'INCREMENTAL' END AS mode,
      CASE run_no WHEN 3 THEN 'MANUAL' ELSE 'SCHEDULED' END AS trigger_type, CASE WHEN quarantined > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status,
      extracted, transformed, loaded, skipped, quarantined, 0 AS failed, drift_detected, max_lag_seconds, CAST(NULL AS VARCHAR) AS error_message,
      epoch_us(before) AS watermark_before_us, epoch_us(after) AS watermark_after_us, epoch_us({started}) AS started_at_us FROM marked"""


PENDING_SQL = f"""{RUN_SQL}, box AS (SELECT sha256('customers|' || business_key || '|' || version || '|customers-' || run_no) AS event_id, business_key,
  outcome AS event_type, version, CASE run_no WHEN 1 THEN TIMESTAMP '{RUN_AT[1]}' WHEN 2 THEN TIMESTAMP '{RUN_AT[2]}' ELSE TIMESTAMP '{RUN_AT[3]}' END AS created_at
  FROM fold WHERE outcome IN ('CREATED', 'UPDATED', 'DELETED'))"""
STATE_SQL = """SELECT business_key, split_part(content, '|', 1) AS email_address, split_part(content, '|', 2) AS full_name, split_part(content, '|', 3) AS given_name,
          split_part(content, '|', 4) AS family_name, split_part(content, '|', 5) AS lifecycle_code, CAST(split_part(content, '|', 6) AS INTEGER) AS tier_rank,
          split_part(content, '|', 7) AS address_line, split_part(content, '|', 8) AS city, split_part(content, '|', 9) AS postal_code,
          split_part(content, '|', 10) AS country_code, split_part(content, '|', 11) AS tags_csv, epoch_us(clock) AS clock_us, version"""
# One run over the whole feed: the first run's window without its end.
ONE_RUN = RUN_SQL.replace(f"AS f WHERE source_updated_at <= TIMESTAMP '{FIRST_UNTIL}'", "AS f")


def _publish_sql(refused: str) -> str:
    """What becomes of the events of one run; `refused` says which the transport does not take."""
    return f"""WITH RECURSIVE {PENDING_SQL.replace(RUN_SQL, ONE_RUN)}, due AS (SELECT *, {refused} AS refused FROM box WHERE created_at = TIMESTAMP '{RUN_AT[1]}'),
        placed AS (SELECT *, coalesce(bool_or(refused) OVER (PARTITION BY business_key ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS behind FROM due)
        SELECT event_id, business_key, version, CASE WHEN behind THEN 'HELD_BACK' WHEN refused THEN 'FAILED' ELSE 'PUBLISHED' END AS pass_result,
          CASE WHEN behind THEN 0 ELSE 1 END AS attempts, CASE WHEN refused AND NOT behind THEN 'refused ' || event_id END AS last_error,
          CASE WHEN NOT refused AND NOT behind THEN epoch_us(TIMESTAMP '{PUBLISHED_AT}') END AS published_us FROM placed"""

QUERIES = {
    "store_runs": store_runs,
    "store_state": store_state,
    "store_pending": store_pending,
    "run_pages": run_pages,
    "publish_run": publish_run,
    "publish_all": publish_all,
    "publish_all_refusing": publish_all_refusing,
    "bounded_runs": bounded_runs,
}
ORACLES = {
    "store_runs": _rows_sql(RUN_SQL),
    "store_state": f"""WITH RECURSIVE {RUN_SQL}, final AS (SELECT * FROM fold WHERE n > 0
          QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY n DESC) = 1)
        {STATE_SQL},
          epoch_us(deleted_at) AS deleted_at_us, epoch_us(first_at) AS first_synced_at_us, epoch_us(last_at) AS last_synced_at_us FROM final WHERE present""",
    "store_pending": f"WITH RECURSIVE {PENDING_SQL} SELECT event_id, business_key, event_type, version, epoch_us(created_at) AS created_us FROM box",
    "run_pages": f"SELECT * FROM ({_rows_sql(ONE_RUN)}) AS r WHERE run_id = 'customers-1'",
    "publish_all": _publish_sql("false"),
    "publish_all_refusing": _publish_sql("left(event_id, 1) = '0'"),
    "bounded_runs": f"""WITH RECURSIVE {ONE_RUN}, final AS (SELECT * FROM fold WHERE n > 0 AND run_no = 1
          QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY n DESC) = 1)
        {STATE_SQL}, deleted_at IS NOT NULL AS is_deleted FROM final WHERE present""",
    "publish_run": f"""WITH RECURSIVE {PENDING_SQL}, queued AS (SELECT *, (row_number() OVER (ORDER BY created_at, version, business_key) - 1) // 100 AS batch,
          row_number() OVER (ORDER BY created_at, version, business_key) AS pos, left(event_id, 2) NOT IN ('00', '01') AS ok FROM box),
        judged AS (SELECT *, (SELECT min(batch) FROM queued WHERE NOT ok) AS last_batch FROM queued),
        held AS (SELECT *, coalesce(bool_or(NOT ok) OVER (PARTITION BY business_key, batch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS behind FROM judged)
        SELECT event_id, business_key, version, CAST(1 AS BIGINT) AS times FROM held WHERE batch <= coalesce(last_batch, batch) AND NOT behind""",
}
