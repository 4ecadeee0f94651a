"""Change events of the event feed's second run, their outbox and what consumers do with them."""

from __future__ import annotations

from functools import partial
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.feeds import Destination
from feedweave.operators import outbox as O
from feedweave.session import materialize, shared_folder
from feedweave.sinks.publish import publish_sink as messages
from feedweave.streaming import driver as streams
from workload.queries.merging import FOLD, RUN_2, RUN_2_AT, _at, event_results

EVENTS = Destination("userKey", {"event_type": ("string", 20, "eventType")})
PUBLISHED_AT = "2024-02-02 00:05:00"
PREFIX = "feedweave.changes"


def events(spark, sf_dir) -> DataFrame:
    return O.change_events(event_results(spark, sf_dir), "events", EVENTS.key_name, EVENTS.wire_names, RUN_2, _at(RUN_2_AT))


def outbox(spark, sf_dir) -> DataFrame:
    """An outbox whose first-version events went out before."""
    pending = O.pending_rows(events(spark, sf_dir))
    done = F.col("version") == 1
    return pending.withColumn("published_at", F.when(done, _at(RUN_2_AT))).withColumn("attempts", F.when(done, 1).otherwise(0))


def acks(outbox: DataFrame) -> DataFrame:
    """What the transport answers: it fails where the id starts with 00, and never answers for ids starting with 01."""
    start = F.left("event_id", F.lit(2))
    return outbox.where(start != "01").select(
        "event_id",
        (start != "00").alias("ok"),
        F.when(start == "00", F.repeat(F.concat(F.lit("refused "), F.col("event_id")), F.lit(40))).alias("error"),
    )


def change_events(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "business_key", "event_type", "version", "payload")


def shown(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id",
        "business_key",
        "event_type",
        "version",
        F.sha2("payload", 256).alias("payload_hash"),
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("published_at").alias("published_us"),
        "attempts",
        "last_error",
    )


def outbox_append(spark, sf_dir):
    """The events appended to an outbox that holds those of an earlier run of the same changes."""
    rows = events(spark, sf_dir)
    earlier = O.change_events(event_results(spark, sf_dir), "events", EVENTS.key_name, EVENTS.wire_names, "run-0", _at(RUN_2_AT))
    return shown(O.outbox_append(O.pending_rows(earlier), rows)).drop("payload_hash")


def outbox_pending(spark, sf_dir):
    return shown(O.outbox_pending(outbox(spark, sf_dir)))


def outbox_publish_pass(spark, sf_dir):
    rows = materialize(outbox(spark, sf_dir))
    done = O.outbox_publish_pass(rows, acks(rows), _at(PUBLISHED_AT))
    return shown(done).join(done.select("event_id", "pass_result"), "event_id")


def outbox_counts(spark, sf_dir):
    return O.outbox_counts(outbox(spark, sf_dir))


def publish_sink(spark, sf_dir):
    return messages(outbox(spark, sf_dir), PREFIX).select("topic", "key", F.sha2("value", 256).alias("value_hash"))


def key_history(spark, sf_dir):
    return shown(O.key_history(outbox(spark, sf_dir), "events"))


def key_history_one(spark, sf_dir):
    return shown(O.key_history(outbox(spark, sf_dir), "events", "7"))


def deliveries(spark, sf_dir) -> DataFrame:
    """At-least-once delivery: events whose id starts with a digit come twice, and order is disturbed by the id."""
    # Kept: delivered twice, held and counted, but merged once.
    rows = materialize(events(spark, sf_dir).select("feed", "business_key", "event_id", "event_type", "version"))
    again = rows.where(F.left("event_id", F.lit(1)) <= "9")
    late = F.conv(F.substring("event_id", 3, 2), 16, 10).cast("bigint") % 5
    seq = F.col("version").cast("bigint") * 1000
    first = rows.withColumn("delivery_seq", seq + late * 1000 + late)
    return first.unionByName(again.withColumn("delivery_seq", seq + late * 2000 + 500 + late))


def consume_dedup(spark, sf_dir):
    return O.consume_dedup(deliveries(spark, sf_dir)).select("event_id", "business_key", "event_type", "version")


def consume_if_newer(spark, sf_dir):
    """The consumer already holds version 3 of every second key."""
    rows = deliveries(spark, sf_dir)
    held = rows.where(F.col("business_key").cast("bigint") % 2 == 0).select("feed", "business_key").distinct()
    newer = O.consume_if_newer(rows, held.withColumn("version", F.lit(3)))
    return newer.select("event_id", "business_key", "event_type", "version", "delivery_seq")


def _streamed(spark, sf_dir, consume) -> DataFrame:
    """The deliveries landed in four parts by their number and consumed as a stream, one part for each batch."""
    columns = ["feed", "business_key", "event_id", "event_type", "version", "delivery_seq"]
    rows = materialize(deliveries(spark, sf_dir).select(*columns))
    folder = f"{shared_folder(spark)}/deliveries-{uuid4().hex}"
    quarter = F.ceil(rows.agg(F.max("delivery_seq")).scalar() / 4)
    parts = materialize(rows.withColumn("_part", F.floor((F.col("delivery_seq") - 1) / quarter)))
    for part in range(4):
        # A file stream takes files in the order they came.
        parts.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    consume(stream, f"{folder}/seen", deliver, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def consume_dedup_stream(spark, sf_dir):
    """Once by Spark's state, which forgets at once, and the rest by the table of ids."""
    consume = partial(streams.consume_dedup_stream, recent="0 seconds", buckets=8)
    return _streamed(spark, sf_dir, consume).select("event_id", "business_key", "event_type", "version")


def consume_if_newer_stream(spark, sf_dir):
    consume = partial(streams.consume_if_newer_stream, buckets=8)
    return _streamed(spark, sf_dir, consume).select("event_id", "business_key", "event_type", "version", "delivery_seq")


def _iso(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN '' "
        f"WHEN epoch_us({ts}) % 1000 = 0 THEN strftime({ts}, '.%g') ELSE strftime({ts}, '.%f') END || 'Z'"
    )


def _row(content: str, clock: str) -> str:
    return (
        f"CASE WHEN {content} IS NULL THEN 'null' ELSE '{{\"userKey\":\"' || business_key || '\",\"eventType\":\"' || {content} || "
        f"'\",\"sourceUpdatedAt\":\"' || {_iso(clock)} || '\"}}' END"
    )


APPLIED = "run_no = 2 AND outcome IN ('CREATED', 'UPDATED', 'DELETED')"
EVENTS_SQL = f"""{FOLD}, named AS (SELECT *, sha256('events|' || business_key || '|' || version || '|run-2') AS event_id FROM fold WHERE {APPLIED}),
events_made AS (SELECT event_id, business_key, outcome AS event_type, version,
  '{{"eventId":"' || event_id || '","feed":"events","type":"' || outcome || '","businessKey":"' || business_key || '","version":' || version
    || ',"occurredAt":"' || {_iso(f"TIMESTAMP '{RUN_2_AT}'")} || '","sourceUpdatedAt":"' || {_iso('held_clock')} || '","runId":"run-2","before":'
    || {_row("CASE WHEN outcome <> 'CREATED' THEN before_content END", 'before_clock')} || ',"after":' || {_row('after_content', 'after_clock')} || '}}' AS payload
  FROM named)""".replace("{{", "{").replace("}}", "}")
OUTBOX_SQL = f"""{EVENTS_SQL}, box AS (SELECT *, TIMESTAMP '{RUN_2_AT}' AS created_at, CASE WHEN version = 1 THEN TIMESTAMP '{RUN_2_AT}' END AS published_at,
  CASE WHEN version = 1 THEN 1 ELSE 0 END AS attempts, CAST(NULL AS VARCHAR) AS last_error FROM events_made)"""
SHOWN = """event_id, business_key, event_type, version, sha256(payload) AS payload_hash, epoch_us(created_at) AS created_us,
  epoch_us(published_at) AS published_us, attempts, last_error"""
DELIVERED = f"""{EVENTS_SQL}, late AS (SELECT event_id, business_key, event_type, version, CAST('0x' || substr(event_id, 3, 2) AS BIGINT) % 5 AS late FROM events_made),
delivered AS (SELECT event_id, business_key, event_type, version, version * 1000 + late * 1000 + late AS delivery_seq FROM late
  UNION ALL SELECT event_id, business_key, event_type, version, version * 1000 + late * 2000 + 500 + late FROM late WHERE left(event_id, 1) <= '9')"""

QUERIES = {
    "change_events": change_events,
    "outbox_append": outbox_append,
    "outbox_pending": outbox_pending,
    "outbox_publish_pass": outbox_publish_pass,
    "outbox_counts": outbox_counts,
    "publish_sink": publish_sink,
    "key_history": key_history,
    "key_history_one": key_history_one,
    "consume_dedup": consume_dedup,
    "consume_if_newer": consume_if_newer,
    "consume_dedup_stream": consume_dedup_stream,
    "consume_if_newer_stream": consume_if_newer_stream,
}
ORACLES = {
    "change_events": f"{EVENTS_SQL} SELECT * FROM events_made",
    "outbox_append": f"""{EVENTS_SQL}, twice AS (SELECT *, 'run-2' AS run_id FROM named UNION ALL
          SELECT * REPLACE (sha256('events|' || business_key || '|' || version || '|run-0') AS event_id), 'run-0' FROM named)
        SELECT event_id, business_key, outcome AS event_type, version, epoch_us(TIMESTAMP '{RUN_2_AT}') AS created_us, CAST(NULL AS BIGINT) AS published_us,
          0 AS attempts, CAST(NULL AS VARCHAR) AS last_error FROM twice""",
    "outbox_pending": f"""{OUTBOX_SQL} SELECT {SHOWN} FROM box WHERE published_at IS NULL ORDER BY created_at, version, business_key LIMIT 100""",
    "outbox_publish_pass": f"""{OUTBOX_SQL}, queued AS (SELECT *, (row_number() OVER (ORDER BY created_at, version, business_key) - 1) // 100 AS batch,
          row_number() OVER (ORDER BY created_at, version, business_key) AS pos, left(event_id, 2) NOT IN ('00', '01') AS ok FROM box WHERE published_at IS NULL),
        judged AS (SELECT *, (SELECT min(batch) FROM queued WHERE NOT ok) AS last_batch FROM queued),
        held AS (SELECT *, coalesce(bool_or(NOT ok) OVER (PARTITION BY business_key, batch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS behind FROM judged),
        decided AS (SELECT *, CASE WHEN batch > last_batch THEN 'WAITING' WHEN batch = last_batch AND behind THEN 'HELD_BACK' WHEN ok THEN 'PUBLISHED' ELSE 'FAILED' END AS pass_result FROM held)
        SELECT event_id, business_key, event_type, version, sha256(payload) AS payload_hash, epoch_us(created_at) AS created_us,
          CASE WHEN pass_result = 'PUBLISHED' THEN epoch_us(TIMESTAMP '{PUBLISHED_AT}') END AS published_us,
          CASE WHEN pass_result IN ('PUBLISHED', 'FAILED') THEN 1 ELSE 0 END AS attempts,
          CASE WHEN pass_result = 'FAILED' THEN CASE left(event_id, 2) WHEN '00' THEN left(repeat('refused ' || event_id, 40), 1000) ELSE 'no acknowledgement' END END AS last_error,
          pass_result FROM decided
        UNION ALL SELECT {SHOWN}, NULL FROM box WHERE published_at IS NOT NULL""",
    "outbox_counts": f"""{OUTBOX_SQL} SELECT count(*) FILTER (WHERE published_at IS NULL) AS pending, count(published_at) AS published FROM box""",
    "publish_sink": f"""{EVENTS_SQL} SELECT '{PREFIX}.events' AS topic, business_key AS key, sha256(payload) AS value_hash FROM events_made""",
    "key_history": f"{OUTBOX_SQL} SELECT {SHOWN} FROM box",
    "key_history_one": f"{OUTBOX_SQL} SELECT {SHOWN} FROM box WHERE business_key = '7'",
    "consume_dedup_stream": f"{DELIVERED} SELECT DISTINCT event_id, business_key, event_type, version FROM delivered",
    "consume_if_newer_stream": f"""{DELIVERED} SELECT event_id, business_key, event_type, version, delivery_seq FROM delivered
        QUALIFY version > coalesce(max(version) OVER (PARTITION BY business_key ORDER BY delivery_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)""",
    "consume_dedup": f"{DELIVERED} SELECT DISTINCT event_id, business_key, event_type, version FROM delivered",
    "consume_if_newer": f"""{DELIVERED} SELECT event_id, business_key, event_type, version, delivery_seq FROM delivered
        QUALIFY version > greatest(coalesce(max(version) OVER (PARTITION BY business_key ORDER BY delivery_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1),
          CASE WHEN CAST(business_key AS BIGINT) % 2 = 0 THEN 3 ELSE -1 END)""",
}
