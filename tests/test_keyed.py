"""Splitting big keys must not change any result: random changes against a plain sequential fold."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedweave.functions.keyed import STRETCH, cut_by_rows, highest, last, total, walk_keys
from feedweave.functions.ordering import number_rows, rows_at
from feedweave.operators import merge as M
from feedweave.operators import quarantine as Q
from feedweave.operators.dedup import dedup_in_run
from feedweave.operators.outbox import consume_if_newer

T0 = datetime(2024, 1, 1)
NOW_1, NOW_2 = datetime(2024, 6, 1), datetime(2024, 6, 2)
CHANGES = (
    "business_key string, arrival_seq bigint, source_updated_at timestamp, is_delete boolean, "
    "content_fingerprint string, content struct<name: string>"
)


def random_changes(seed, n, start=0):
    """A third of the changes belong to one key."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.34 else f"k{rnd.randrange(25)}"
        delete = rnd.random() < 0.3
        name = rnd.choice("ab")
        clock = T0 + timedelta(minutes=i + start + rnd.randrange(-6, 6))
        rows.append((key, start + i, clock, delete, None if delete else name, None if delete else (name,)))
    return rows


def fold(rows, state, now):
    """The merge, one change after the other."""
    results = []
    for key, seq, clock, delete, fp, content in sorted(rows, key=lambda r: r[1]):
        row = state.get(key)
        before = after = None
        if row is None:
            if delete:
                results.append((key, seq, M.UNCHANGED, 0, clock, None, None))
                continue
            state[key] = dict(c=content[0], t=clock, v=1, d=None, f=now, l=now)
            results.append((key, seq, M.CREATED, 1, clock, None, content[0]))
            continue
        if clock < row["t"]:
            results.append((key, seq, M.STALE, row["v"], row["t"], row["c"], None))
            continue
        if delete:
            outcome = M.UNCHANGED if row["d"] else M.DELETED
            if outcome == M.DELETED:
                before = row["c"]
                row["d"], row["v"] = now, row["v"] + 1
        elif row["d"] is None and row["c"] == content[0]:
            outcome, before = M.UNCHANGED, row["c"]
        else:
            outcome = M.CREATED if row["d"] else M.UPDATED
            before, after = (None if row["d"] else row["c"]), content[0]
            row["c"], row["d"], row["v"] = content[0], None, row["v"] + 1
        row["t"], row["l"] = clock, now
        results.append((key, seq, outcome, row["v"], clock, before, after))
    return results


@pytest.mark.parametrize("limit", [1_000_000, 50, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_fold(spark, limit, seed):
    first, second = random_changes(seed, 400), random_changes(seed + 10, 400, start=400)
    state = {}
    fold(first, state, NOW_1)
    stored = M.merged_state(spark.createDataFrame(first, CHANGES), None, NOW_1, limit)
    expected = fold(second, state, NOW_2)
    annotated = M.annotate(spark.createDataFrame(second, CHANGES), stored, NOW_2, limit)
    got = [
        (r.business_key, r.arrival_seq, r.outcome, r.version, r.source_updated_at, r.b, r.a)
        for r in M.before_after_of(annotated)
        .select("*", F.col("before.content.name").alias("b"), F.col("after.content.name").alias("a"))
        .collect()
    ]
    assert sorted(got, key=lambda r: r[1]) == sorted(expected, key=lambda r: r[1])
    rows = {
        r.business_key: dict(c=r.name, t=r.source_updated_at, v=r.version, d=r.deleted_at, f=r.first_synced_at, l=r.last_synced_at)
        for r in M.state_of(annotated).collect()
    }
    assert rows == state


def test_state_of_untouched_keys_stays(spark):
    state = {}
    rows = random_changes(5, 100)
    fold(rows, state, NOW_1)
    stored = M.merged_state(spark.createDataFrame(rows, CHANGES), None, NOW_1)
    again = M.merged_state(spark.createDataFrame([], CHANGES), stored, NOW_2)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in stored.collect()}


def test_shuffled_versions_converge(spark):
    """Ten versions twice, in random order: one row with the newest content."""
    versions = [("k", 0, T0 + timedelta(hours=i), False, f"n{i}", (f"n{i}",)) for i in range(10)] * 2
    random.Random(7).shuffle(versions)
    rows = [(k, i, *rest) for i, (k, _, *rest) in enumerate(versions)]
    (row,) = M.merged_state(spark.createDataFrame(rows, CHANGES), None, NOW_1, 3).collect()
    assert (row.name, row.source_updated_at) == ("n9", T0 + timedelta(hours=9))


@pytest.mark.parametrize("limit", [1_000_000, 9])
def test_running_values(spark, limit):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else f"k{i % 7}", i, rnd.choice([None, i % 11])) for i in range(300)]

    def body(walk, df):
        value = F.col("value")
        return walk.before(df, top=highest(value), sum=total(value), latest=last(value))

    got = walk_keys(spark.createDataFrame(rows, "key string, seq bigint, value int"), ["key"], "seq", body, limit)
    seen, expected = {}, {}
    for key, seq, value in rows:
        past = [v for v in seen.setdefault(key, []) if v is not None]
        expected[seq] = (max(past), sum(past), past[-1]) if past else (None, None, None)
        seen[key].append(value)
    assert {r.seq: (r.top, r.sum, r.latest) for r in got.collect()} == expected


def test_stretches_follow_rows_not_numbers(spark):
    """Landed pages number records with gaps: a key over many pages still has few stretches, and none is too long."""
    rows = spark.createDataFrame([("hot", page * 1_000_000 + pos) for page in range(100) for pos in range(10)], "key string, seq bigint")
    cut = cut_by_rows(rows, ["key"], "seq", 20).groupBy(STRETCH).agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    found = cut.orderBy(STRETCH).collect()
    assert 10 <= len(found) <= 20
    assert max(r.n for r in found) <= 100 and sum(r.n for r in found) == 1000
    assert all(a.high < b.low for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("limit", [1_000_000, 8])
def test_dedup_looks_at_the_previous_record_only(spark, limit):
    rnd = random.Random(11)
    rows = [("f", "hot" if i % 3 else f"k{i % 5}", T0 + timedelta(days=rnd.randrange(2)), i) for i in range(200)]
    schema = "feed string, business_key string, source_updated_at timestamp, arrival_seq bigint"
    kept = {r.arrival_seq for r in dedup_in_run(spark.createDataFrame(rows, schema), limit).collect()}
    previous, expected = {}, set()
    for _, key, clock, seq in rows:
        if previous.get(key) != clock:
            expected.add(seq)
        previous[key] = clock
    assert kept == expected


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_quarantine_equals_fold(spark, limit):
    rnd = random.Random(23)
    rejected, passes, steps = [], [], []
    for i in range(500):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(9)}"
        clock = T0 + timedelta(days=rnd.randrange(6))
        if rnd.random() < 0.5:
            rejected.append(("f", key, clock, i, "DRIFT", "d", "{}"))
        else:
            passes.append(("f", key, i, clock))
        steps.append((key, i, clock, i in {r[3] for r in rejected}))
    rejected_df = spark.createDataFrame(
        rejected,
        "feed string, business_key string, source_updated_at timestamp, arrival_seq bigint, reason string, "
        "details string, payload string",
    )
    passes_df = spark.createDataFrame(passes, "feed string, business_key string, arrival_seq bigint, source_updated_at timestamp")
    episodes = Q.quarantine_episodes(None, rejected_df, passes_df, "r", NOW_1, limit)
    open_rows, expected = {}, []
    for key, _, clock, is_reject in steps:
        row = open_rows.get(key)
        if is_reject and not (row and row[1] == clock):
            if row:
                row[2] = Q.NEWER_NOTE
            open_rows[key] = [key, clock, None]
            expected.append(open_rows[key])
        elif not is_reject and row and row[1] <= clock:
            row[2] = Q.LOADED_NOTE
            del open_rows[key]
    got = sorted((r.business_key, r.source_updated_at, r.resolution_note or "") for r in episodes.collect())
    assert got == sorted((k, c, n or "") for k, c, n in expected)


@pytest.mark.parametrize("limit", [1_000_000, 6])
def test_consume_if_newer(spark, limit):
    rnd = random.Random(4)
    rows = [("f", "hot" if i % 2 else "cold", rnd.randrange(40), i) for i in range(120)]
    events = spark.createDataFrame(rows, "feed string, business_key string, version int, delivery_seq bigint")
    held = spark.createDataFrame([("f", "hot", 5)], "feed string, business_key string, version int")
    newest, expected = {"hot": 5}, set()
    for _, key, version, seq in rows:
        if version > newest.get(key, -1):
            newest[key] = version
            expected.add(seq)
    assert {r.delivery_seq for r in consume_if_newer(events, held, limit).collect()} == expected


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(5000).select((F.hash("id") % 50).alias("k"), "id").repartition(7)
    rows = number_rows(df, "k", "id").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 5001))
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


@pytest.mark.parametrize("most", [1, 7, 60, 10_000])
def test_pages_are_found_by_their_rank(spark, most):
    """Times that tie, one time that very many rows share, and rows without a time."""
    rng = random.Random(3)
    start = datetime(2026, 1, 1)
    times = [start + timedelta(minutes=rng.randint(0, 40)) for _ in range(150)] + [start + timedelta(minutes=20)] * 120 + [None] * 30
    rows = [(t, f"id{i:03d}") for i, t in enumerate(times)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "at timestamp, id string").repartition(3)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] - start).total_seconds() if r[0] else 0, r[1]))
    for first, count in ((0, 10), (95, 10), (150, 20), (260, 15), (290, 20), (400, 5)):
        got = [tuple(r) for r in rows_at(table, "at", "id", first, count, most).collect()]
        assert sorted(got, key=repr) == sorted(ordered[first : first + count], key=repr)
    assert rows_at(table.where("false"), "at", "id", 500, 5, 1).collect() == []
