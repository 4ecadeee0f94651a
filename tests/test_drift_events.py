"""Folding of findings into drift events, whatever way the first finding's texts are found."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedweave.operators import drift_events as E

AT = datetime(2024, 1, 1)
FINDING = (
    "feed string, source_updated_at timestamp, arrival_seq bigint, finding_no int, kind string, field string, "
    "expected string, actual string, details string, fingerprint string"
)


def finding(fingerprint, seq, no=0, feed="customers", details=None):
    return feed, AT, seq, no, "FIELD_ADDED", "f", None, "STRING", details or f"{seq}.{no}", fingerprint


def upsert(spark, rows):
    return E.drift_event_upsert(spark.createDataFrame([], E.SCHEMA), rows, "run-1", AT)


@pytest.mark.parametrize("most", [200_000, 0])
def test_the_first_finding_gives_the_texts(spark, monkeypatch, most):
    monkeypatch.setattr(E, "MOST_BROADCAST", most, raising=False)
    rows = [finding("a", 7), finding("a", 3, 1), finding("a", 3, 0), finding("b", 9), finding("b", 9), finding("b", None),
            finding(None, 5), finding(None, 4), finding("a", 8, feed=None)]
    found = upsert(spark, spark.createDataFrame(rows, FINDING)).select("feed", "fingerprint", "details", "affected_records")
    assert {tuple(r) for r in found.collect()} == {
        ("customers", "a", "3.0", 3), ("customers", "b", "None.0", 3), ("customers", None, "4.0", 2), (None, "a", "8.0", 1)
    }
    assert found.count() == 4


def test_no_task_holds_more_texts_than_its_share(spark, monkeypatch):
    """Texts that shrink well must not end in few tasks."""
    monkeypatch.setattr(E, "ROWS_PER_TASK", 100, raising=False)
    monkeypatch.setattr(E, "MOST_BROADCAST", 0, raising=False)
    findings = spark.range(4000).select(
        F.lit("customers").alias("feed"), F.lit(AT).alias("source_updated_at"), F.col("id").alias("arrival_seq"),
        F.lit(0).alias("finding_no"), F.lit("FIELD_ADDED").alias("kind"), F.lit("f").alias("field"),
        F.lit(None).cast("string").alias("expected"), F.lit("STRING").alias("actual"),
        F.repeat(F.lit("same "), F.lit(200)).alias("details"), (F.col("id") % 2000).cast("string").alias("fingerprint"),
    )
    events = upsert(spark, findings)
    decided = E.drift_event_resolve(events, events.limit(1).select("event_id", F.lit("done").alias("note")), AT)
    for rows in (events, decided):
        held = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(held) == 2000 and max(held) <= 200
