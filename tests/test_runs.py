"""Whole runs against a store: the scenarios a feed goes through in operation."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedweave.feeds import CUSTOMER_FEED, ORDER_FEED
from feedweave.operators.contract import Contract, Field
from feedweave.operators.outbox import SCHEMA as OUTBOX
from feedweave.operators.outbox import consume_if_newer
from feedweave.plans.run import FeedRunner
from feedweave.sinks.publish import write_messages
from feedweave.sinks.store import FeedStore
from feedweave.streaming.driver import consume_dedup_stream, consume_if_newer_stream, follow_feed, page_stream
from tests.test_records import CUSTOMER, ORDER, RECORD, changed

T0 = datetime(2026, 3, 1, 10)


class Clock:
    def __init__(self):
        self.now = T0 + timedelta(hours=1)

    def __call__(self):
        self.now += timedelta(minutes=1)
        return self.now


@pytest.fixture
def runner(spark, tmp_path):
    return FeedRunner(CUSTOMER_FEED, FeedStore(spark, str(tmp_path / "store"), CUSTOMER_FEED, buckets=4), Clock())


def customer(key, minute, deleted=False, **changes):
    at = T0 + timedelta(minutes=minute)
    doc = changed(CUSTOMER, id=key, updatedAt=at.isoformat() + "Z", **changes)
    return key, at, deleted, doc


def feed(spark, *records, name="customers"):
    rows = [(name, key, at, deleted, json.dumps(doc), i) for i, (key, at, deleted, doc) in enumerate(records)]
    return spark.createDataFrame(rows, RECORD)


def counts(run):
    return tuple(run[c] for c in ("status", "extracted", "loaded", "skipped", "quarantined"))


def test_first_second_and_changed_run(spark, runner):
    two = [customer("a", 1), customer("b", 2)]
    first = runner.run_incremental(feed(spark, *two))
    assert counts(first) == ("SUCCEEDED", 2, 2, 0, 0) and first["watermark_after"] == T0 + timedelta(minutes=2)
    second = runner.run_incremental(feed(spark, *two))
    assert counts(second) == ("SUCCEEDED", 1, 0, 1, 0), "only the overlap is read again"
    third = runner.run_incremental(feed(spark, *two, customer("a", 5, tier="SILVER"), customer("b", 6, deleted=True)))
    assert counts(third) == ("SUCCEEDED", 3, 2, 1, 0)
    state = {r.business_key: r for r in runner.store.read_state().collect()}
    assert (state["a"].tier_rank, state["a"].version, state["b"].deleted_at is None) == (2, 2, False)
    log = runner.store.read_log("runs").orderBy("started_at").collect()
    assert [r.loaded for r in log] == [2, 0, 2] and log[2].max_lag_seconds is not None and log[1].max_lag_seconds is None
    payloads = [json.loads(r.payload) for r in runner.store.read_set("outbox_pending").collect()]
    update = next(p for p in payloads if p["type"] == "UPDATED")
    assert (update["before"]["tierRank"], update["after"]["tierRank"], update["after"]["customerKey"]) == (3, 2, "a")
    assert next(p for p in payloads if p["type"] == "DELETED")["after"] is None


def test_blocking_drift_then_clean_backfill(spark, runner):
    bad = customer("a", 1, tier=...)
    run = runner.run_incremental(feed(spark, bad, customer("b", 2)))
    assert counts(run) == ("PARTIAL", 2, 1, 0, 1) and run["drift_detected"]
    (event,) = runner.store.read_set("drift_open").collect()
    assert (event.fingerprint, event.affected_records) == ("FIELD_MISSING:tier:STRING->-", 1)
    (held,) = runner.store.read_set("quarantine_open").collect()
    assert (held.business_key, held.reason, json.loads(held.payload)["id"]) == ("a", "DRIFT", "a")
    fixed = feed(spark, customer("a", 1), customer("b", 2))
    elsewhere = runner.run_backfill(fixed, T0 + timedelta(minutes=1, seconds=30), T0 + timedelta(minutes=9))
    assert elsewhere["status"] == "SUCCEEDED" and runner.store.read_set("drift_open").count() == 1
    mark = run["watermark_after"]
    clean = runner.run_backfill(fixed, T0, T0 + timedelta(minutes=9))
    assert counts(clean) == ("SUCCEEDED", 2, 1, 1, 0) and clean["watermark_after"] == mark
    assert runner.store.read_set("drift_open").isEmpty() and runner.store.read_set("quarantine_open").isEmpty()
    assert "clean backfill" in runner.store.read_log("drift_resolved").first().resolution_note
    assert runner.store.read_log("quarantine_closed").first().status == "SUPERSEDED"
    with pytest.raises(ValueError):
        runner.run_backfill(fixed, T0, T0 - timedelta(1))


def test_warning_drift_loads(spark, runner):
    run = runner.run_incremental(feed(spark, customer("a", 1, extra=1), customer("b", 1, extra=2)))
    assert counts(run) == ("SUCCEEDED", 2, 2, 0, 0) and run["drift_detected"]
    assert runner.store.read_set("drift_open").first().affected_records == 2


def test_failed_read_keeps_watermark(spark, runner):
    runner.run_incremental(feed(spark, customer("a", 1)))
    broken = feed(spark, customer("b", 3)).withColumn("business_key", F.raise_error(F.lit("outage")).cast("string"))
    run = runner.run_incremental(broken)
    assert run["status"] == "FAILED" and "outage" in run["error_message"]
    assert run["watermark_after"] == T0 + timedelta(minutes=1) and runner.store.read_state().count() == 1
    assert counts(runner.run_incremental(feed(spark, customer("b", 3)))) == ("SUCCEEDED", 1, 1, 0, 0)
    assert [r.status for r in runner.store.read_log("runs").orderBy("started_at").collect()] == ["SUCCEEDED", "FAILED", "SUCCEEDED"]


def test_too_wide_value_fails_the_run(spark, runner):
    run = runner.run_incremental(feed(spark, customer("a", 1, firstName="x" * 101)))
    assert run["status"] == "FAILED" and "too long" in run["error_message"] and run["watermark_after"] is None
    assert runner.store.read_state().isEmpty() and runner.store.read_set("watermark").isEmpty()


def test_tombstone_of_a_drifting_payload(spark, runner):
    runner.run_incremental(feed(spark, customer("a", 1)))
    run = runner.run_incremental(feed(spark, customer("a", 2, deleted=True, tier=...)))
    assert counts(run) == ("SUCCEEDED", 1, 1, 0, 0) and not run["drift_detected"]
    assert runner.store.read_state().first().deleted_at == run["started_at"]


def test_replay(spark, runner):
    runner.run_incremental(feed(spark, customer("a", 1, tier=...), customer("b", 1, email="nobody")))
    rows = {r.business_key: r for r in runner.store.read_set("quarantine_open").collect()}
    assert rows["b"].reason == "VALIDATION" and rows["b"].details.startswith("invalid: email: ")
    again = runner.replay(spark.createDataFrame([(rows["a"].quarantine_id,)], "quarantine_id string"))
    assert counts(again) == ("PARTIAL", 1, 0, 0, 1)
    assert {r.quarantine_id for r in runner.store.read_set("quarantine_open").collect()} == {r.quarantine_id for r in rows.values()}
    assert runner.store.read_set("drift_open").first().affected_records == 2
    # The contract is relaxed; the stored payload now passes.
    relaxed = Contract("customers", (Field("id", "STRING", True),))
    runner.spec = runner.spec.__class__(**{**runner.spec.__dict__, "contract": relaxed, "map_records": lenient})
    done = runner.replay(spark.createDataFrame([(rows["a"].quarantine_id,)], "quarantine_id string"))
    assert done["loaded"] == 1 and done["mode"] == "REPLAY"
    closed = runner.store.read_log("quarantine_closed").first()
    assert (closed.status, closed.resolution_note) == ("REPLAYED", f"replayed in run {done['run_id']}")
    with pytest.raises(ValueError, match="REPLAYED"):
        runner.replay(spark.createDataFrame([(rows["a"].quarantine_id,)], "quarantine_id string"))
    unknown = runner.discard(spark.createDataFrame([(rows["b"].quarantine_id, "no"), ("x", "?")], "quarantine_id string, note string"))
    assert [r.quarantine_id for r in unknown.collect()] == ["x"] and runner.store.read_set("quarantine_open").isEmpty()
    event = runner.store.read_set("drift_open").orderBy("fingerprint").first()
    runner.resolve_drift(spark.createDataFrame([(event.event_id, "done")], "event_id string, note string"))
    assert runner.store.read_log("drift_resolved").where(F.col("event_id") == event.event_id).count() == 1


def lenient(records, skip=None):
    """A mapper of a later version that fills in the tier."""
    payload = F.regexp_replace("payload", r"\}\s*$", ', "tier": "GOLD"}')
    return CUSTOMER_FEED.map_records(records.drop("_document").withColumn("payload", payload), skip)


def test_repeats_and_mapping_failures(spark, runner):
    rows = [customer("a", 1), customer("a", 1), customer("b", 1, createdAt="soon")]
    run = runner.run_incremental(feed(spark, *rows))
    assert counts(run) == ("PARTIAL", 3, 1, 1, 1) and run["transformed"] == 1
    assert runner.store.read_set("quarantine_open").first().reason == "MAPPING"


def test_publish_keeps_key_order(spark, runner, tmp_path):
    runner.run_incremental(feed(spark, customer("a", 1), customer("b", 1), customer("a", 2, tier="SILVER")))

    def refuse_first_of_a(pending):
        first = (F.col("business_key") == "a") & (F.col("version") == 1)
        return pending.select("event_id", (~first).alias("ok"), F.when(first, F.lit("down")).alias("error"))

    passed = {(r.business_key, r.version): r for r in runner.publish(refuse_first_of_a).collect()}
    assert {k: r.pass_result for k, r in passed.items()} == {("a", 1): "FAILED", ("a", 2): "HELD_BACK", ("b", 1): "PUBLISHED"}
    assert passed["a", 1].attempts == 1 and passed["a", 2].attempts == 0
    rest = runner.publish(lambda pending: pending.select("event_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")))
    assert {r.pass_result for r in rest.collect()} == {"PUBLISHED"} and runner.store.read_set("outbox_pending").isEmpty()
    published = runner.store.read_log("outbox_published")
    write_messages(published, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).groupBy("topic").count().collect()[0]["count"] == 3


def test_orders_feed(spark, tmp_path):
    runner = FeedRunner(ORDER_FEED, FeedStore(spark, str(tmp_path / "s"), ORDER_FEED, buckets=2), Clock())
    rows = [("o1", T0, False, changed(ORDER, id="o1")), ("o2", T0, False, changed(ORDER, id="o2", total__amount="1.00"))]
    run = runner.run_incremental(feed(spark, *rows, name="orders"))
    assert counts(run) == ("PARTIAL", 2, 1, 0, 1)
    row = runner.store.read_state().first()
    assert (row.total_minor, row.line_count, json.loads(row.lines_json)[0]) == (2175, 2, {"sku": "A", "qty": 2, "unitMinor": 725})


def test_stream_equals_batch_and_skips_committed_batches(spark, runner, tmp_path):
    landing = tmp_path / "pages"
    landing.mkdir()
    versions = [customer(f"k{i % 7}", i, deleted=i % 5 == 4, tier=["GOLD", "SILVER"][i % 2]) for i in range(20)]
    for n in range(4):
        docs = [d | {"deleted": deleted} for _, _, deleted, d in versions[n * 5 : n * 5 + 5]]
        body = json.dumps({"items": docs, "nextCursor": None, "hasMore": False})
        (landing / f"{n}.json").write_text(json.dumps({"page_no": n + 1, "body": body}))
        os.utime(landing / f"{n}.json", (n + 1, n + 1))  # the stream takes files by their time
    stream = page_stream(spark, str(landing), files_per_batch=2)
    for _ in range(2):
        follow_feed(runner, stream, str(tmp_path / "offsets")).awaitTermination()
    assert runner.store.read_log("runs").count() == 2 and runner.store.has_batch(1)
    batch = FeedRunner(CUSTOMER_FEED, FeedStore(spark, str(tmp_path / "b"), CUSTOMER_FEED, buckets=4), Clock())
    batch.run_incremental(feed(spark, *versions))
    plain = ["business_key", "tier_rank", "source_updated_at", "version", "content_fingerprint"]
    streamed, whole = (sorted(r.store.read_state().select(*plain, F.col("deleted_at").isNull()).collect()) for r in (runner, batch))
    assert streamed == whole and len(whole) == 7


def test_stream_consumer_equals_the_batch_operator_and_keeps_late_events(spark, tmp_path):
    """Events of a key in several batches: repeats and older versions go, a first delivery days late stays."""
    late = T0 - timedelta(days=3)
    rows = [(f"e{k}{v}", "f", f"k{k}", "CREATED", v, "{}", late if k == 4 else T0, None, 0, None) for k in range(5) for v in (1, 3, 2, 3)]
    events = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], OUTBOX + ", delivery_seq bigint")
    for part in range(3):
        events.where(F.floor(F.col("delivery_seq") / 8) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    deliver = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    consume_if_newer_stream(stream, str(tmp_path / "seen"), deliver, str(tmp_path / "cp")).awaitTermination()
    got = {(r.business_key, r.version) for r in spark.read.schema(events.schema).parquet(out + "/*").collect()}
    assert got == {(r.business_key, r.version) for r in consume_if_newer(events).collect()} and ("k4", 3) in got


def test_publish_hands_over_only_what_is_due(spark, runner):
    """Held back and waiting events never reach the transport, and nothing reaches it twice."""
    versions = ("GOLD", "SILVER", "BRONZE")
    rows = [customer(k, i, tier=tier) for i, tier in enumerate(versions, 1) for k in ("a", "b", "c")]
    runner.run_incremental(feed(spark, *rows))
    sent = []

    def transport(due):
        got = due.orderBy("version", "business_key").collect()
        sent.append([(r.business_key, r.version) for r in got])
        answers = [(r.event_id, not (r.business_key == "b" and r.version == 2), None) for r in got]
        return spark.createDataFrame(answers, "event_id string, ok boolean, error string")

    passed = {(r.business_key, r.version): r.pass_result for r in runner.publish(transport, batch=8).collect()}
    everything = [e for call in sent for e in call]
    assert len(everything) == len(set(everything))
    assert set(everything) == {e for e, result in passed.items() if result in ("PUBLISHED", "FAILED")}
    assert passed["b", 2] == "FAILED" and passed["b", 3] == "HELD_BACK" and passed["c", 3] == "WAITING"


def test_all_landed_pages_are_read(spark, runner):
    pages = []
    for n in range(130):
        doc = customer(f"p{n:03d}", n % 50)[3]
        pages.append((n + 1, json.dumps({"items": [doc], "nextCursor": "c", "hasMore": True})))
    run = runner.run_pages(spark.createDataFrame(pages, "page_no bigint, body string"))
    assert run["extracted"] == run["loaded"] == 130


def test_a_store_keeps_its_bucket_count(spark, runner):
    runner.run_incremental(feed(spark, customer("a", 1)))
    root = runner.store.path.rsplit("/", 1)[0]
    assert FeedStore(spark, root, CUSTOMER_FEED).buckets == 4
    with pytest.raises(ValueError, match="4 buckets"):
        FeedStore(spark, root, CUSTOMER_FEED, buckets=12)


def test_a_failed_run_reports_nothing_loaded(spark, runner):
    run = runner.run_incremental(feed(spark, customer("a", 1), customer("b", 1, firstName="x" * 5000)))
    assert run["status"] == "FAILED" and counts(run)[1:] == (0, 0, 0, 0) and run["extracted"] == 0
    assert not run["drift_detected"] and runner.store.read_state().isEmpty()


def layers(store, name="state"):
    return {b: [tuple(x) for x in parts] for b, parts in store.last_commit()["tables"][name].items()}


def test_a_run_writes_the_rows_it_changes(spark, tmp_path):
    """1,000 keys, then a run that changes 10 of them: 10 rows are written, and the table reads as it should."""
    store = FeedStore(spark, str(tmp_path / "s"), CUSTOMER_FEED, buckets=4)
    runner = FeedRunner(CUSTOMER_FEED, store, Clock())
    runner.run_incremental(feed(spark, *[customer(f"k{i}", 1) for i in range(1000)]))
    before = layers(store)
    assert sum(x[2] for parts in before.values() for x in parts) == 1000
    run = runner.run_incremental(feed(spark, *[customer(f"k{i}", 9, tier="SILVER", deleted=i == 3) for i in range(10)]))
    assert run["loaded"] == 10
    after = layers(store)
    assert all(after[b][: len(parts)] == parts for b, parts in before.items())
    written = [x for parts in after.values() for x in parts if x[0] == 2]
    assert sum(x[2] for x in written) == 10 and {x[1] for x in written} == {"change"}
    rows = {r.business_key: r for r in store.read_state().collect()}
    assert len(rows) == 1000 and store.read_state().count() == 1000
    assert (rows["k2"].tier_rank, rows["k2"].version, rows["k20"].version) == (2, 2, 1) and rows["k3"].deleted_at is not None


def test_buckets_are_folded_when_changes_outgrow_them(spark, tmp_path):
    from feedweave.sinks.keyed_table import KeyedTable

    table = KeyedTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], 3, gone="v < 0", most_layers=3)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k string, v int")
    layout, expected = {}, {}
    for no in range(1, 15):
        changes = {f"k{i}": -1 if (i + no) % 7 == 0 else no for i in range(0, 40, 1 + no % 5)} if no < 9 else {"k1": no}
        layout = table.write(rows(*changes.items()), layout, no)
        expected = {k: v for k, v in {**expected, **changes}.items() if v >= 0}
        assert {r.k: r.v for r in table.read(layout).collect()} == expected
    assert all(len(parts) <= 4 for parts in layout.values()) and any(x[1] == "fold" for parts in layout.values() for x in parts)
    (bucket,) = table.touched(rows(("k1", 1)))
    assert all(x[0] < 9 for b, parts in layout.items() if b != bucket for x in parts)
    assert {r.k for r in table.read(layout, [bucket]).collect()} < set(expected)
    layout = table.write(rows(*[(f"k{i}", -1) for i in range(40)]), layout, 15)
    assert layout == {} and table.read(layout).isEmpty()


def test_quarantine_leaves_other_buckets_alone(spark, runner):
    runner.run_incremental(feed(spark, *[customer(f"k{i}", 1, email="nobody") for i in range(40)]))
    before = layers(runner.store, "quarantine_open")
    assert len(before) == 4 and runner.store.read_set("quarantine_open").count() == 40
    runner.run_incremental(feed(spark, customer("k7", 2)))
    after = layers(runner.store, "quarantine_open")
    changed = [b for b in before if after[b] != before[b]]
    assert len(changed) == 1 and after[changed[0]][-1][2] == 1
    left = runner.store.read_set("quarantine_open")
    assert left.count() == 39 and left.where("business_key = 'k7'").isEmpty()
    # Another version of an open key: the old row closes and the new one takes its place.
    runner.run_incremental(feed(spark, customer("k8", 3, email="nobody else")))
    rows = runner.store.read_set("quarantine_open").where("business_key = 'k8'").collect()
    assert [r.source_updated_at for r in rows] == [T0 + timedelta(minutes=3)]
    closed = {r.business_key: r.resolution_note for r in runner.store.read_log("quarantine_closed").collect()}
    assert closed == {"k7": "a newer version was loaded successfully", "k8": "superseded by a newer quarantined version"}


def test_one_commit_is_opened(spark, runner):
    for i in range(3):
        runner.run_incremental(feed(spark, customer(f"k{i}", i + 1)))
    commits = f"{runner.store.path}/commits"
    # Older commits may be gone; only the newest is read.
    for run_no in (1, 2):
        for name in os.listdir(f"{commits}/run_no={run_no}"):
            if name.endswith(".parquet"):
                with open(f"{commits}/run_no={run_no}/{name}", "wb") as file:
                    file.write(b"not a parquet file")
    assert runner.store.last_commit()["run_no"] == 3 and runner.store.read_state().count() == 3


def sender(folder, refused=()):
    """A transport that runs in tasks: it notes each call in a file of its own and refuses some events."""

    def send(events):
        import uuid

        rows = list(zip(events.column("business_key").to_pylist(), events.column("version").to_pylist(), strict=True))
        with open(f"{folder}/{uuid.uuid4()}.json", "w") as file:
            json.dump(rows, file)
        return ["refused" if r in refused else None for r in rows]

    return send


def calls(folder):
    found = sorted(folder.iterdir(), key=lambda f: f.stat().st_mtime_ns)
    return [[tuple(r) for r in json.loads(f.read_text())] for f in found]


@pytest.mark.parametrize("limit", [None, 2])
def test_the_whole_outbox_is_delivered_by_tasks(spark, runner, tmp_path, limit):
    tiers = ("GOLD", "SILVER", "BRONZE", "GOLD", "SILVER")
    rows = [customer(f"k{k}", i, tier=tier) for i, tier in enumerate(tiers, 1) for k in range(6) if k != 4 or i == 1]
    runner.run_incremental(feed(spark, *rows))
    folder = tmp_path / "sent"
    folder.mkdir()
    refused = {("k1", 2), ("k2", 1), ("k3", 5)}
    passed = {(r.business_key, r.version): r for r in runner.publish_all(sender(str(folder), refused), limit=limit).collect()}
    sent = [e for call in calls(folder) for e in call]
    assert len(sent) == len(set(sent)), "nothing is handed over twice"
    assert all(len({k for k, _ in call}) == len(call) for call in calls(folder)), "one event of a key at a time"
    for key in {k for k, _ in sent}:
        assert [v for k, v in sent if k == key] == sorted(v for k, v in sent if k == key), "in the order of the key"
    held = {("k1", 3), ("k1", 4), ("k1", 5), ("k2", 2), ("k2", 3), ("k2", 4), ("k2", 5)}
    expected = {e: "FAILED" if e in refused else "HELD_BACK" if e in held else "PUBLISHED" for e in passed}
    assert {e: r.pass_result for e, r in passed.items()} == expected and set(sent) == set(passed) - held
    assert (passed["k2", 1].attempts, passed["k2", 1].last_error, passed["k2", 2].attempts) == (1, "refused", 0)
    assert runner.store.read_set("outbox_pending").count() == len(held) + 3
    again = runner.publish_all(sender(str(folder)), limit=limit)
    assert {r.pass_result for r in again.collect()} == {"PUBLISHED"} and runner.store.read_set("outbox_pending").isEmpty()
    assert runner.publish_all(sender(str(folder))).isEmpty(), "an empty outbox is no failure"
    assert runner.store.read_log("outbox_published").count() == len(passed)


def test_a_transport_must_answer_for_every_event(spark, runner):
    runner.run_incremental(feed(spark, customer("a", 1)))
    with pytest.raises(Exception, match="1 events were handed over and 0 answered"):
        runner.publish_all(lambda events: []).collect()
    assert runner.store.read_set("outbox_pending").count() == 1


def test_a_bounded_read_goes_on_where_it_stopped(spark, runner, tmp_path):
    pages = []
    for n in range(1, 8):
        docs = [customer(f"k{(n * 3 + i) % 5}", n, tier=["GOLD", "SILVER"][n % 2])[3] for i in range(3)]
        pages.append((n, json.dumps({"items": docs, "nextCursor": "c" if n < 7 else None, "hasMore": n < 7})))
    landed = spark.createDataFrame(pages, "page_no bigint, body string")
    runs = [runner.run_next_pages(landed, 3) for _ in range(4)]
    assert [r["extracted"] for r in runs] == [9, 9, 3, 0] and runner.store.last_commit()["last_page"] == 7
    whole = FeedRunner(CUSTOMER_FEED, FeedStore(spark, str(tmp_path / "w"), CUSTOMER_FEED, buckets=4), Clock())
    whole.run_pages(landed)
    plain = ["business_key", "tier_rank", "source_updated_at", "version", "content_fingerprint"]
    bounded, once = (sorted(r.store.read_state().select(*plain).collect()) for r in (runner, whole))
    assert bounded == once and len(once) == 5
    broken = spark.createDataFrame([*pages, (8, json.dumps({"items": [{"id": None}], "hasMore": False}))], "page_no bigint, body string")
    assert runner.run_next_pages(broken, 3)["status"] == "FAILED" and runner.store.last_commit()["last_page"] == 7
    later = customer("k9", 9)[3]
    more = spark.createDataFrame([*pages, (8, json.dumps({"items": [later], "hasMore": False}))], "page_no bigint, body string")
    assert runner.run_next_pages(more, 3)["loaded"] == 1 and runner.store.last_commit()["last_page"] == 8


def test_stream_dedup_equals_the_batch_operator_whenever_an_event_repeats(spark, tmp_path):
    """Repeats in the same batch, in the next one, after a restart, and after the state has forgotten the id."""
    late = T0 - timedelta(hours=2)
    rows = [(f"e{i % 11}", "f", f"k{i % 3}", "CREATED", i % 11, "{}", late if i > 30 else T0, None, 0, None) for i in range(40)]
    events = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], OUTBOX + ", delivery_seq bigint")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    deliver = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    for part in range(4):
        events.where(F.floor(F.col("delivery_seq") / 10) == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        # A state that forgets at once leaves every later repeat to the table of ids.
        consume_dedup_stream(stream, str(tmp_path / "seen"), deliver, str(tmp_path / "cp"), "0 seconds" if part else "1 hour").awaitTermination()
    got = spark.read.schema(events.schema).parquet(out + "/*")
    assert sorted(r.event_id for r in got.collect()) == sorted({f"e{i}" for i in range(11)})


def test_a_later_batch_reads_and_writes_no_more_than_an_early_one(spark, tmp_path):
    """Each batch brings two keys; what is written for a batch stays the same, and so do the layers it may read."""
    from feedweave.streaming.driver import VERSIONS, Seen

    index = Seen(spark, str(tmp_path / "seen"), VERSIONS, ["feed", "business_key"], 4)
    sizes = []
    for n in range(30):
        batch = spark.createDataFrame([("f", f"k{n % 6}", n), ("f", f"k{(n + 1) % 6}", n)], VERSIONS)
        layout = index.before(n)
        index.add(batch, layout, n)
        sizes.append(sum(x[2] for parts in index.before(n + 1).values() for x in parts))
    assert max(sizes[20:]) <= max(sizes[6:14]) and index.table.read(index.before(30)).count() == 6
    # A batch that is run again does not see itself.
    assert index.table.read(index.before(0)).isEmpty()
    with pytest.raises(ValueError, match="4 buckets, not 5"):
        Seen(spark, str(tmp_path / "seen"), VERSIONS, ["feed", "business_key"], 5).before(3)


def test_a_record_without_a_version_is_replayed_as_of_now(spark):
    from feedweave.operators.quarantine import SCHEMA, quarantine_replay

    row = ("q", "customers", "a", "r", "DRIFT", "d", "{}", None, T0, "OPEN", None, None)
    rows = spark.createDataFrame([row, ("p", *row[1:7], T0, *row[8:])], SCHEMA)
    ids = spark.createDataFrame([("q",), ("p",)], "quarantine_id string")
    later = T0 + timedelta(hours=1)
    assert {r.quarantine_id: r.source_updated_at for r in quarantine_replay(rows, ids, later).collect()} == {"q": later, "p": T0}


def test_a_run_keeps_its_records_prunable_and_replaces_those_of_the_run_before(spark, runner):
    runner.run_incremental(feed(spark, customer("a", 1), customer("b", 2, tier=...)))
    checked = spark.read.parquet(runner.store.work("checked"))
    kept = {r.business_key: r for r in checked.collect()}
    assert kept["a"].payload is None and json.loads(kept["b"].payload)["id"] == "b", "only rejected payloads are needed"
    assert kept["a"].content.email_address and kept["b"].reject_reason == "DRIFT"
    runner.run_incremental(feed(spark, customer("c", 9)).withColumn("arrival_note", F.lit(None)))
    after = spark.read.parquet(runner.store.work("checked"))
    assert [r.business_key for r in after.collect()] == ["c"] and "arrival_note" not in after.columns
    assert runner.store.read_state().count() == 2 and runner.store.read_set("quarantine_open").count() == 1
