"""Quarantine lifecycle on the event feed: views are rejected versions (by day), clicks and purchases clean passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.operators import quarantine as Q
from feedweave.session import materialize
from workload.derived import derived, derived_sql
from workload.queries.merging import RUN_1, RUN_1_AT, RUN_2, RUN_2_AT, SPLIT, _at

DECIDED_AT = "2024-02-03 00:00:00"


def _steps(spark, sf_dir, run: int) -> tuple[DataFrame, DataFrame]:
    feed = derived(spark, sf_dir, "event_feed")
    second = F.col("source_updated_at") > _at(SPLIT)
    part = feed.where(second if run == 2 else ~second)
    rejected = part.where(F.col("event_type").isin("view", "error")).select(
        "feed",
        "business_key",
        F.date_trunc("day", "source_updated_at").alias("source_updated_at"),
        "arrival_seq",
        F.when(F.col("event_id") % 3 == 0, F.lit("DRIFT")).when(F.col("event_id") % 3 == 1, F.lit("MAPPING")).otherwise(
            F.lit("VALIDATION")
        ).alias("reason"),
        F.repeat(F.concat(F.lit("event "), F.col("event_id"), F.lit("; ")), F.lit(200)).alias("details"),
        F.concat(F.lit('{"event":'), F.col("event_id"), F.lit("}")).alias("payload"),
    )
    passes = part.where(F.col("event_type").isin("click", "purchase", "signup")).select(
        "feed", "business_key", "arrival_seq", (F.col("source_updated_at") - F.expr("INTERVAL 12 HOURS")).alias("source_updated_at")
    )
    return rejected, passes


def second_run(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Episodes after the second run, and the rows the first run had closed."""
    first = materialize(Q.quarantine_episodes(None, *_steps(spark, sf_dir, 1), RUN_1, _at(RUN_1_AT)))
    still_open = first.where(F.col("status") == Q.OPEN)
    episodes = Q.quarantine_episodes(still_open, *_steps(spark, sf_dir, 2), RUN_2, _at(RUN_2_AT))
    return episodes, first.where(F.col("status") != Q.OPEN)


def quarantine_table(spark, sf_dir) -> DataFrame:
    episodes, closed = second_run(spark, sf_dir)
    return materialize(closed.unionByName(episodes).select(*Q.COLUMNS))


def shown(df: DataFrame) -> DataFrame:
    return df.select(
        "quarantine_id",
        "business_key",
        "run_id",
        "reason",
        F.sha2("details", 256).alias("details_hash"),
        "payload",
        *[F.unix_micros(c).alias(f"{c}_us") for c in ("source_updated_at", "quarantined_at", "resolved_at")],
        "status",
        "resolution_note",
    )


def _episode(kind):
    return lambda spark, sf_dir: shown(kind(second_run(spark, sf_dir)[0]))


def decisions(quarantine: DataFrame) -> DataFrame:
    """Operators decide on rows whose id starts with a digit, and name some rows that do not exist."""
    known = quarantine.where(F.left("quarantine_id", F.lit(1)).between("0", "9")).select(
        "quarantine_id", F.concat(F.lit("decided for "), F.col("business_key")).alias("note")
    )
    unknown = quarantine.select(F.concat(F.lit("missing-"), F.col("business_key")).alias("quarantine_id")).distinct()
    return known.unionByName(unknown.withColumn("note", F.lit("?")))


def quarantine_discard(spark, sf_dir):
    table = quarantine_table(spark, sf_dir)
    return shown(Q.quarantine_discard(table, decisions(table), _at(DECIDED_AT)))


def quarantine_discard_unknown(spark, sf_dir):
    table = quarantine_table(spark, sf_dir)
    return Q.unknown_ids(table, decisions(table))


def quarantine_replay(spark, sf_dir):
    table = quarantine_table(spark, sf_dir)
    return Q.quarantine_replay(table, decisions(table)).select(
        "quarantine_id", "feed", "business_key", F.unix_micros("source_updated_at").alias("clock_us"), "deleted", "payload"
    )


def quarantine_mark_replayed(spark, sf_dir):
    table = quarantine_table(spark, sf_dir)
    replayed = decisions(table).select("quarantine_id")
    return shown(Q.quarantine_mark_replayed(table, replayed, "replayed in run run-3", _at(DECIDED_AT)))


TABLE_SQL = f"""feed AS ({derived_sql('event_feed')}),
steps AS (SELECT business_key, CASE WHEN source_updated_at <= TIMESTAMP '{SPLIT}' THEN 1 ELSE 2 END AS run_no, arrival_seq, event_id,
    event_type IN ('view', 'error') AS is_reject, CAST(date_trunc('day', source_updated_at) AS TIMESTAMP) AS reject_version,
    source_updated_at - INTERVAL 12 HOUR AS pass_clock
  FROM feed WHERE event_type IN ('view', 'error', 'click', 'purchase', 'signup')),
ordered AS (SELECT *, row_number() OVER (PARTITION BY business_key ORDER BY run_no, arrival_seq) AS n FROM steps),
fold AS (
  SELECT DISTINCT business_key, CAST(0 AS BIGINT) AS n, 0 AS run_no, CAST(0 AS BIGINT) AS arrival_seq, CAST(NULL AS BIGINT) AS open_seq,
    CAST(NULL AS TIMESTAMP) AS open_version, false AS opened, CAST(NULL AS BIGINT) AS closed_seq, CAST(NULL AS VARCHAR) AS closed_note FROM ordered
  UNION ALL
  SELECT o.business_key, o.n, o.run_no, o.arrival_seq,
    CASE WHEN o.is_reject AND f.open_version IS NOT DISTINCT FROM o.reject_version THEN f.open_seq WHEN o.is_reject THEN o.arrival_seq
         WHEN f.open_version <= o.pass_clock THEN NULL ELSE f.open_seq END,
    CASE WHEN o.is_reject THEN o.reject_version WHEN f.open_version <= o.pass_clock THEN NULL ELSE f.open_version END,
    o.is_reject AND f.open_version IS DISTINCT FROM o.reject_version,
    CASE WHEN o.is_reject AND f.open_version IS DISTINCT FROM o.reject_version THEN f.open_seq
         WHEN NOT o.is_reject AND f.open_version <= o.pass_clock THEN f.open_seq END,
    CASE WHEN o.is_reject THEN 'superseded by a newer quarantined version' ELSE 'a newer version was loaded successfully' END
  FROM fold AS f JOIN ordered AS o ON o.business_key = f.business_key AND o.n = f.n + 1),
opened AS (SELECT f.business_key, f.run_no, f.arrival_seq, o.event_id, o.reject_version FROM fold AS f JOIN ordered AS o USING (business_key, n) WHERE f.opened),
closed AS (SELECT closed_seq, run_no AS closed_run, closed_note FROM fold WHERE closed_seq IS NOT NULL),
quarantine AS (SELECT sha256(concat_ws('|', 'events', business_key, epoch_us(reject_version), 'run-' || run_no, arrival_seq)) AS quarantine_id, business_key,
    'run-' || run_no AS run_id, CASE event_id % 3 WHEN 0 THEN 'DRIFT' WHEN 1 THEN 'MAPPING' ELSE 'VALIDATION' END AS reason,
    sha256(left(repeat('event ' || event_id || '; ', 200), 2000)) AS details_hash, '{{"event":' || event_id || '}}' AS payload,
    epoch_us(reject_version) AS source_updated_at_us,
    epoch_us(CASE run_no WHEN 1 THEN TIMESTAMP '{RUN_1_AT}' ELSE TIMESTAMP '{RUN_2_AT}' END) AS quarantined_at_us,
    epoch_us(CASE closed_run WHEN 1 THEN TIMESTAMP '{RUN_1_AT}' WHEN 2 THEN TIMESTAMP '{RUN_2_AT}' END) AS resolved_at_us,
    CASE WHEN closed_seq IS NULL THEN 'OPEN' ELSE 'SUPERSEDED' END AS status, closed_note AS resolution_note, run_no, closed_run
  FROM opened LEFT JOIN closed ON closed_seq = arrival_seq)""".replace("{{", "{").replace("}}", "}")
WITH = f"WITH RECURSIVE {TABLE_SQL}"
PLAIN = "EXCLUDE (run_no, closed_run)"
CHOSEN = "left(quarantine_id, 1) BETWEEN '0' AND '9'"
DECIDED_US = f"epoch_us(TIMESTAMP '{DECIDED_AT}')"

QUERIES = {
    "quarantine_append": _episode(Q.quarantine_append),
    "quarantine_supersede_newer": _episode(Q.quarantine_supersede_newer),
    "quarantine_supersede_loaded": _episode(Q.quarantine_supersede_loaded),
    "quarantine_discard": quarantine_discard,
    "quarantine_discard_unknown": quarantine_discard_unknown,
    "quarantine_replay": quarantine_replay,
    "quarantine_mark_replayed": quarantine_mark_replayed,
}
ORACLES = {
    "quarantine_append": f"{WITH} SELECT * {PLAIN} FROM quarantine WHERE run_no = 2",
    "quarantine_supersede_newer": f"{WITH} SELECT * {PLAIN} FROM quarantine WHERE closed_run = 2 AND resolution_note LIKE 'superseded%'",
    "quarantine_supersede_loaded": f"{WITH} SELECT * {PLAIN} FROM quarantine WHERE closed_run = 2 AND resolution_note LIKE 'a newer%'",
    "quarantine_discard": f"""{WITH} SELECT * REPLACE (
        CASE WHEN status = 'OPEN' AND {CHOSEN} THEN 'DISCARDED' ELSE status END AS status,
        CASE WHEN status = 'OPEN' AND {CHOSEN} THEN {DECIDED_US} ELSE resolved_at_us END AS resolved_at_us,
        CASE WHEN status = 'OPEN' AND {CHOSEN} THEN 'decided for ' || business_key ELSE resolution_note END AS resolution_note) {PLAIN} FROM quarantine""".replace(
        f"* REPLACE", "* EXCLUDE (run_no, closed_run) REPLACE").replace(f") {PLAIN} FROM", ") FROM"),
    "quarantine_discard_unknown": f"{WITH} SELECT DISTINCT 'missing-' || business_key AS quarantine_id, '?' AS note FROM quarantine",
    "quarantine_replay": f"""{WITH} SELECT quarantine_id, 'events' AS feed, business_key, source_updated_at_us AS clock_us, false AS deleted, payload
        FROM quarantine WHERE status = 'OPEN' AND {CHOSEN}""",
    "quarantine_mark_replayed": f"""{WITH} SELECT * EXCLUDE (run_no, closed_run) REPLACE (
        CASE WHEN {CHOSEN} THEN 'REPLAYED' ELSE status END AS status, CASE WHEN {CHOSEN} THEN {DECIDED_US} ELSE resolved_at_us END AS resolved_at_us,
        CASE WHEN {CHOSEN} THEN 'replayed in run run-3' ELSE resolution_note END AS resolution_note) FROM quarantine""",
}
