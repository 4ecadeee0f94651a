"""What whole runs leave behind: quarantine, drift events and watermark of the customer feed, a replay, the order feed."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.feeds import CUSTOMER_FEED, ORDER_FEED
from feedweave.operators.contract import Contract
from feedweave.plans.run import FeedRunner
from feedweave.session import materialize, shared_folder
from feedweave.sinks.store import FeedStore
from feedweave.sources import change_feed as S
from workload.derived import derived, derived_sql
from workload.queries.drift import CONTRACT_SQL, FINGERPRINTED
from workload.queries.drift_events import shown as shown_drift
from workload.queries.mapping import CUSTOMERS_SQL, FINE, ORDERS_SQL, ROW_CUSTOMER
from workload.queries.merging import fold_sql
from workload.queries.quarantine import shown as shown_quarantine
from workload.queries.runs import BACKFILL, FIRST_UNTIL, RUN_AT, RUN_SQL
from workload.queries.store_runs import BUCKETS, STATE_SQL, _run_rows, _rows_sql, _state_rows, kept_runs, three_runs

REPLAYED_AT = "2024-03-05 00:00:00"
TOMBSTONES_AFTER = timedelta(days=30)
TOMBSTONE_ARRIVAL = 1_000_000_000


def _quarantine(store: FeedStore) -> DataFrame:
    return store.read_set("quarantine_open").unionByName(store.read_log("quarantine_closed"))


def runs_quarantine(spark, sf_dir):
    """Open and closed quarantined records after the three runs."""
    return shown_quarantine(_quarantine(kept_runs(spark, sf_dir)).withColumn("payload", F.sha2("payload", 256)))


def runs_drift_events(spark, sf_dir):
    return shown_drift(kept_runs(spark, sf_dir).read_set("drift_open"))


def runs_watermark(spark, sf_dir):
    return kept_runs(spark, sf_dir).read_set("watermark").select(
        "feed", F.unix_micros("watermark_ts").alias("watermark_us"), "watermark_key", F.unix_micros("updated_at").alias("updated_us")
    )


def _renamed_mail(payload):
    return F.regexp_replace(payload, '"emailAddress":', '"email":')


def _lenient_map(records: DataFrame, skip=None) -> DataFrame:
    """A later mapper, which knows the new name of a field."""
    later = records.drop("_document").withColumn("payload", _renamed_mail(F.col("payload")))
    return CUSTOMER_FEED.map_records(later, skip)


def _lenient_spec():
    """A later contract, which no longer asks for the old name."""
    contract = CUSTOMER_FEED.contract
    fields = tuple(replace(f, required=False) if f.path == "email" else f for f in contract.fields)
    return replace(CUSTOMER_FEED, contract=Contract(contract.feed, fields), map_records=_lenient_map)


#: Stores after the replay, by application and tables.
_REPLAYED: dict[tuple[str, str], FeedStore] = {}


def _replayed(spark, sf_dir) -> FeedStore:
    """Every open record is replayed by a pipeline that was mended for some of them."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _REPLAYED:
        store = three_runs(spark, sf_dir)
        runner = FeedRunner(_lenient_spec(), store, clock=lambda: datetime.fromisoformat(REPLAYED_AT))
        runner.replay(materialize(store.read_set("quarantine_open").select("quarantine_id")))
        _REPLAYED[key] = store
    return _REPLAYED[key]


def replay_run(spark, sf_dir):
    """The run log's row of the replay."""
    return _run_rows(_replayed(spark, sf_dir)).where("mode = 'REPLAY'")


def replay_quarantine(spark, sf_dir):
    """All quarantined records after it."""
    rows = _quarantine(_replayed(spark, sf_dir))
    return rows.select("quarantine_id", "business_key", "status", F.unix_micros("resolved_at").alias("resolved_us"), "resolution_note")


def replay_state(spark, sf_dir):
    state = _replayed(spark, sf_dir).read_state()
    return _state_rows(state, [c for c in CUSTOMER_FEED.destination.columns if c != "source_created_at"])


def order_changes(spark, sf_dir) -> DataFrame:
    """Every order is placed, and some are deleted a month later."""
    feed = derived(spark, sf_dir, "order_feed").drop("flaw")
    deleted = feed.where("deleted").withColumns(
        {
            "source_updated_at": F.col("source_updated_at") + F.lit(TOMBSTONES_AFTER),
            "arrival_seq": F.col("arrival_seq") + TOMBSTONE_ARRIVAL,
        }
    )
    return feed.withColumn("deleted", F.lit(False)).unionByName(deleted)


#: Stores of the order feed, by application and tables.
_ORDERS: dict[tuple[str, str], FeedStore] = {}


def _order_runs(spark, sf_dir) -> FeedStore:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _ORDERS:
        feed = order_changes(spark, sf_dir)
        store = FeedStore(spark, f"{shared_folder(spark)}/orders-{uuid4().hex}", ORDER_FEED, buckets=BUCKETS)
        runner = lambda n: FeedRunner(ORDER_FEED, store, clock=lambda: datetime.fromisoformat(RUN_AT[n]))
        runner(1).run_incremental(S.in_window(feed, None, FIRST_UNTIL))
        runner(2).run_incremental(feed)
        runner(3).run_backfill(feed, *map(datetime.fromisoformat, BACKFILL))
        _ORDERS[key] = store
    return _ORDERS[key]


def order_runs(spark, sf_dir):
    """The run log of the order feed."""
    return _run_rows(_order_runs(spark, sf_dir))


def order_state(spark, sf_dir):
    """The destination of the order feed, deleted orders included."""
    return _state_rows(_order_runs(spark, sf_dir).read_state(), [c for c in ORDER_FEED.destination.columns if c != "placed_at"])


def order_pending(spark, sf_dir):
    pending = _order_runs(spark, sf_dir).read_set("outbox_pending")
    return pending.select("event_id", "business_key", "event_type", "version", F.unix_micros("created_at").alias("created_us"))


def _at_run(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {n} THEN TIMESTAMP '{at}'" for n, at in RUN_AT.items()) + " END"


# Rejected records and clean passes of a key one after the other, as the runs bring them.
QUARANTINE_SQL = f"""{RUN_SQL},
reasons AS (SELECT arrival_seq, 'DRIFT' AS reason, details FROM (WITH {CONTRACT_SQL}, {FINGERPRINTED}
    SELECT arrival_seq, bool_or(severity = 'BLOCKING') AS blocking, string_agg(details, '; ' ORDER BY ord) AS details FROM prints
    WHERE feed = 'customers' AND NOT deleted GROUP BY 1) AS d WHERE blocking
  UNION ALL
  SELECT arrival_seq, CASE failure_kind WHEN 'INVALID' THEN 'VALIDATION' ELSE 'MAPPING' END, lower(failure_kind) || ': ' || array_to_string(errors, '; ')
  FROM (WITH {CUSTOMERS_SQL} SELECT arrival_seq, failure_kind, errors FROM customers) AS m WHERE failure_kind IS NOT NULL),
reason AS (SELECT * FROM reasons QUALIFY row_number() OVER (PARTITION BY arrival_seq ORDER BY reason) = 1),
steps AS (SELECT business_key, run_no, arrival_seq, true AS is_reject, ts AS moment FROM checked WHERE rejected
  UNION ALL SELECT business_key, run_no, arrival_seq, false, held_clock FROM fold WHERE n > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY business_key ORDER BY run_no, arrival_seq) AS step FROM steps),
life AS (
  SELECT DISTINCT business_key, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS open_step, CAST(NULL AS TIMESTAMP) AS open_version,
    false AS opened, CAST(NULL AS BIGINT) AS closed_step, CAST(NULL AS VARCHAR) AS note FROM placed
  UNION ALL
  SELECT business_key, step, CASE WHEN is_reject AND same THEN open_step WHEN is_reject THEN step WHEN covers THEN NULL ELSE open_step END,
    CASE WHEN is_reject THEN moment WHEN covers THEN NULL ELSE open_version END, is_reject AND NOT same,
    CASE WHEN (is_reject AND NOT same) OR (NOT is_reject AND covers) THEN open_step END,
    CASE WHEN is_reject THEN 'superseded by a newer quarantined version' ELSE 'a newer version was loaded successfully' END
  FROM (SELECT p.business_key, p.step, p.is_reject, p.moment, l.open_step, l.open_version,
      l.open_step IS NOT NULL AND l.open_version = p.moment AS same, coalesce(l.open_version <= p.moment, false) AS covers
    FROM life AS l JOIN placed AS p ON p.business_key = l.business_key AND p.step = l.step + 1) AS s),
closed AS (SELECT l.business_key, l.closed_step, l.note, p.run_no AS closed_run FROM life AS l JOIN placed AS p USING (business_key, step) WHERE closed_step IS NOT NULL),
quarantine AS (SELECT sha256(concat_ws('|', 'customers', business_key, epoch_us(p.moment), 'customers-' || p.run_no, p.arrival_seq)) AS quarantine_id, business_key,
    p.run_no, p.arrival_seq, p.moment, r.reason, r.details, c.closed_run, c.note
  FROM life AS l JOIN placed AS p USING (business_key, step) JOIN reason AS r USING (arrival_seq)
  LEFT JOIN closed AS c ON c.business_key = l.business_key AND c.closed_step = l.step WHERE l.opened)"""

DRIFT_EVENTS_SQL = f"""{RUN_SQL},
seen AS (SELECT r.run_no, r.arrival_seq, r.source_updated_at, p.* EXCLUDE (arrival_seq, source_updated_at) FROM repeats AS r JOIN (WITH {CONTRACT_SQL}, {FINGERPRINTED}
    SELECT * EXCLUDE (feed, business_key) FROM prints WHERE feed = 'customers' AND NOT deleted) AS p USING (arrival_seq) WHERE NOT r.is_repeat),
events AS (SELECT fingerprint, any_value(kind) AS kind, any_value(field) AS field, any_value(expected) AS expected, arg_min(actual, (run_no, r.arrival_seq)) AS actual,
    arg_min(details, (run_no, r.arrival_seq)) AS details, count(*) AS affected_records, min(run_no) AS first_run, max(run_no) AS last_run,
    min(source_updated_at) AS changed FROM seen AS r GROUP BY fingerprint)"""

# The replay: open records whose only fault was the renamed field pass now, unless the mended payload breaks a rule.
MENDED = f"SELECT * REPLACE (replace(payload, '\"emailAddress\":', '\"email\":') AS payload) FROM ({derived_sql('customer_feed')}) AS m"
MENDED_SQL = CUSTOMERS_SQL.replace(derived_sql("customer_feed"), MENDED)
REPLAY_SQL = f"""{QUARANTINE_SQL},
tried AS (SELECT q.quarantine_id, q.business_key, q.moment AS ts, m.failure_kind IS NULL AND q.arrival_seq % 23 = 0 AS passes, q.arrival_seq % 23 = 0 AS drifts
  FROM quarantine AS q JOIN (WITH {MENDED_SQL} SELECT arrival_seq, failure_kind FROM customers) AS m USING (arrival_seq) WHERE q.closed_run IS NULL),
held AS (SELECT * FROM fold WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY n DESC) = 1),
mended AS (WITH {MENDED_SQL} SELECT arrival_seq, concat_ws('|', email_address, full_name, given_name, family_name, lifecycle_code, tier_rank,
    address_line, city, postal_code, country_code, tags_csv, created_at) AS content FROM ({ROW_CUSTOMER}) AS r),
brought AS (SELECT t.quarantine_id, t.business_key, t.ts, c.content AS new_content, h.content, h.clock, h.deleted_at, h.first_at, h.last_at,
    coalesce(h.version, 0) AS version, coalesce(h.present, false) AS present,
    CASE WHEN NOT coalesce(h.present, false) THEN 'CREATED' WHEN t.ts < h.clock THEN 'SKIPPED_STALE' WHEN h.deleted_at IS NOT NULL THEN 'CREATED'
      WHEN h.content = c.content THEN 'SKIPPED_UNCHANGED' ELSE 'UPDATED' END AS outcome
  FROM tried AS t JOIN quarantine AS q USING (quarantine_id) JOIN mended AS c ON c.arrival_seq = q.arrival_seq LEFT JOIN held AS h ON h.business_key = t.business_key
  WHERE t.passes),
after AS (SELECT h.business_key, coalesce(CASE WHEN b.outcome IN ('CREATED', 'UPDATED') THEN b.new_content END, h.content) AS content,
    CASE WHEN b.outcome IS NULL OR b.outcome = 'SKIPPED_STALE' THEN h.clock ELSE b.ts END AS clock,
    h.version + CASE WHEN b.outcome IN ('CREATED', 'UPDATED') THEN 1 ELSE 0 END AS version,
    CASE WHEN b.outcome IN ('CREATED', 'UPDATED') THEN NULL ELSE h.deleted_at END AS deleted_at, h.first_at,
    CASE WHEN b.outcome IS NULL OR b.outcome = 'SKIPPED_STALE' THEN h.last_at ELSE TIMESTAMP '{REPLAYED_AT}' END AS last_at
  FROM held AS h LEFT JOIN brought AS b USING (business_key) WHERE h.present
  UNION ALL
  SELECT business_key, new_content, ts, 1, NULL, TIMESTAMP '{REPLAYED_AT}', TIMESTAMP '{REPLAYED_AT}' FROM brought WHERE NOT present)"""

# The order feed: as the customer feed's runs, with its own checks and content.
PLACED = f"SELECT * REPLACE (false AS deleted) FROM ({derived_sql('order_feed')}) AS d"
ORDER_FEED_SQL = f"""SELECT business_key, source_updated_at, deleted, arrival_seq FROM ({PLACED}) AS p
  UNION ALL SELECT business_key, source_updated_at + INTERVAL 30 DAY, true, arrival_seq + {TOMBSTONE_ARRIVAL} FROM ({derived_sql('order_feed')}) AS t WHERE deleted"""
PLACED_SQL = ORDERS_SQL.replace(derived_sql("order_feed"), PLACED)
ORDER_RUN_SQL = f"""
order_changes AS ({ORDER_FEED_SQL}),
window_rows AS (SELECT *, 1 AS run_no FROM order_changes WHERE source_updated_at <= TIMESTAMP '{FIRST_UNTIL}'
  UNION ALL SELECT *, 2 FROM order_changes WHERE source_updated_at > (
    SELECT max(source_updated_at) FROM order_changes WHERE source_updated_at <= TIMESTAMP '{FIRST_UNTIL}') - INTERVAL 5 SECOND
  UNION ALL SELECT *, 3 FROM order_changes WHERE source_updated_at > TIMESTAMP '{BACKFILL[0]}' AND source_updated_at <= TIMESTAMP '{BACKFILL[1]}'),
repeats AS (SELECT *, lag(source_updated_at) OVER (PARTITION BY run_no, business_key ORDER BY arrival_seq) IS NOT DISTINCT FROM source_updated_at AS is_repeat FROM window_rows),
drifted AS (WITH {CONTRACT_SQL.replace(derived_sql('order_feed'), PLACED)}, {FINGERPRINTED}
  SELECT arrival_seq, bool_or(severity = 'BLOCKING') AS blocking FROM prints WHERE feed = 'orders' GROUP BY 1),
failed AS (WITH {PLACED_SQL} SELECT arrival_seq, failure_kind FROM orders_mapped),
contents AS (WITH {PLACED_SQL} SELECT arrival_seq, concat_ws('|', customer,
    CASE upper(sts) WHEN 'PENDING' THEN 'PEN' WHEN 'PAID' THEN 'PAI' WHEN 'SHIPPED' THEN 'SHP' WHEN 'DELIVERED' THEN 'DLV' ELSE 'CAN' END,
    amount_minor, upper(cur), line_count, lines_json, placed_at) AS content FROM orders_mapped WHERE {FINE}),
checked AS (SELECT r.business_key, r.run_no, r.arrival_seq, r.source_updated_at AS ts, r.deleted AS is_delete, r.is_repeat,
    NOT r.is_repeat AND d.blocking IS NOT NULL AS drift_detected, NOT r.is_repeat AND (coalesce(d.blocking, false) OR f.failure_kind IS NOT NULL) AS rejected, c.content
  FROM repeats AS r LEFT JOIN drifted AS d USING (arrival_seq) LEFT JOIN failed AS f USING (arrival_seq) LEFT JOIN contents AS c USING (arrival_seq)),
changes AS (SELECT business_key, run_no, arrival_seq, ts, is_delete, CASE WHEN NOT is_delete THEN content END AS content FROM checked WHERE NOT is_repeat AND NOT rejected),
{fold_sql('changes', RUN_AT)},
fates AS (SELECT c.run_no, c.drift_detected, c.ts, CASE WHEN is_repeat THEN 'REPEATED' WHEN rejected THEN 'QUARANTINED'
    WHEN outcome IN ('CREATED', 'UPDATED', 'DELETED') THEN 'LOADED' ELSE 'SKIPPED' END AS fate
  FROM checked AS c LEFT JOIN fold AS f ON f.run_no = c.run_no AND f.arrival_seq = c.arrival_seq AND f.business_key = c.business_key)"""

QUERIES = {
    "runs_quarantine": runs_quarantine,
    "runs_drift_events": runs_drift_events,
    "runs_watermark": runs_watermark,
    "replay_run": replay_run,
    "replay_quarantine": replay_quarantine,
    "replay_state": replay_state,
    "order_runs": order_runs,
    "order_state": order_state,
    "order_pending": order_pending,
}
ORACLES = {
    "runs_quarantine": f"""WITH RECURSIVE {QUARANTINE_SQL} SELECT quarantine_id, q.business_key, 'customers-' || run_no AS run_id, reason, sha256(left(details, 2000)) AS details_hash,
          sha256(f.payload) AS payload, epoch_us(moment) AS source_updated_at_us, epoch_us({_at_run('run_no')}) AS quarantined_at_us,
          epoch_us({_at_run('closed_run')}) AS resolved_at_us, CASE WHEN closed_run IS NULL THEN 'OPEN' ELSE 'SUPERSEDED' END AS status, note AS resolution_note
        FROM quarantine AS q JOIN ({derived_sql('customer_feed')}) AS f USING (arrival_seq)""",
    "runs_drift_events": f"""WITH RECURSIVE {DRIFT_EVENTS_SQL} SELECT sha256('customers|' || fingerprint || '|customers-' || first_run) AS event_id, 'customers' AS feed,
          fingerprint, kind, field, expected, actual, details, affected_records, 'customers-' || first_run AS first_run_id, 'customers-' || last_run AS last_run_id,
          'OPEN' AS status, CAST(NULL AS VARCHAR) AS resolution_note, epoch_us(changed) AS source_changed_at_us, epoch_us({_at_run('first_run')}) AS detected_at_us,
          epoch_us({_at_run('last_run')}) AS last_seen_at_us, CAST(NULL AS BIGINT) AS resolved_at_us FROM events""",
    "runs_watermark": f"""WITH RECURSIVE {RUN_SQL}, newest AS (SELECT * FROM window_rows WHERE run_no < 3 QUALIFY row_number() OVER (ORDER BY source_updated_at DESC, run_no, business_key DESC) = 1)
        SELECT 'customers' AS feed, epoch_us(source_updated_at) AS watermark_us, business_key AS watermark_key, epoch_us({_at_run('run_no')}) AS updated_us FROM newest""",
    "replay_run": f"""WITH RECURSIVE {REPLAY_SQL}, mark AS (SELECT max(source_updated_at) AS at FROM window_rows WHERE run_no < 3)
        SELECT 'customers-4' AS run_id, 'customers' AS feed, 'REPLAY' AS mode, 'MANUAL' AS trigger_type,
          CASE WHEN count(*) FILTER (WHERE NOT passes) > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status, count(*) AS extracted,
          count(*) FILTER (WHERE passes) AS transformed, count(*) FILTER (WHERE outcome IN ('CREATED', 'UPDATED')) AS loaded,
          count(*) FILTER (WHERE outcome LIKE 'SKIPPED%') AS skipped, count(*) FILTER (WHERE NOT passes) AS quarantined, 0 AS failed,
          bool_or(drifts OR EXISTS (SELECT 1 FROM drifted AS d JOIN quarantine AS q USING (arrival_seq) WHERE q.quarantine_id = t.quarantine_id)) AS drift_detected,
          max(CASE WHEN outcome IN ('CREATED', 'UPDATED') THEN CAST(epoch(TIMESTAMP '{REPLAYED_AT}' - t.ts) AS BIGINT) END) AS max_lag_seconds,
          CAST(NULL AS VARCHAR) AS error_message, epoch_us(any_value(mark.at)) AS watermark_before_us, epoch_us(any_value(mark.at)) AS watermark_after_us,
          epoch_us(TIMESTAMP '{REPLAYED_AT}') AS started_at_us
        FROM tried AS t LEFT JOIN brought AS b USING (quarantine_id), mark""",
    "replay_quarantine": f"""WITH RECURSIVE {REPLAY_SQL} SELECT quarantine_id, q.business_key,
          CASE WHEN passes THEN 'REPLAYED' WHEN closed_run IS NULL THEN 'OPEN' ELSE 'SUPERSEDED' END AS status,
          CASE WHEN passes THEN epoch_us(TIMESTAMP '{REPLAYED_AT}') ELSE epoch_us({_at_run('closed_run')}) END AS resolved_us,
          CASE WHEN passes THEN 'replayed in run customers-4' ELSE note END AS resolution_note
        FROM quarantine AS q LEFT JOIN (SELECT quarantine_id, passes FROM tried) AS t USING (quarantine_id)""",
    "replay_state": f"""WITH RECURSIVE {REPLAY_SQL} {STATE_SQL}, epoch_us(deleted_at) AS deleted_at_us, epoch_us(first_at) AS first_synced_at_us,
          epoch_us(last_at) AS last_synced_at_us FROM after""",
    "order_runs": _rows_sql(ORDER_RUN_SQL, "orders"),
    "order_state": f"""WITH RECURSIVE {ORDER_RUN_SQL}, final AS (SELECT * FROM fold WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY n DESC) = 1)
        SELECT business_key, split_part(content, '|', 1) AS customer_key, split_part(content, '|', 2) AS state_code, CAST(split_part(content, '|', 3) AS BIGINT) AS total_minor,
          split_part(content, '|', 4) AS currency, CAST(split_part(content, '|', 5) AS INTEGER) AS line_count, split_part(content, '|', 6) AS lines_json,
          epoch_us(clock) AS clock_us, version, epoch_us(deleted_at) AS deleted_at_us, epoch_us(first_at) AS first_synced_at_us, epoch_us(last_at) AS last_synced_at_us
        FROM final WHERE present""",
    "order_pending": f"""WITH RECURSIVE {ORDER_RUN_SQL} SELECT sha256('orders|' || business_key || '|' || version || '|orders-' || run_no) AS event_id, business_key,
          outcome AS event_type, version, epoch_us({_at_run('run_no')}) AS created_us FROM fold WHERE outcome IN ('CREATED', 'UPDATED', 'DELETED')""",
}
