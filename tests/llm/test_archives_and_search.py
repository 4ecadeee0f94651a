"""WARC round trips, nearest neighbours, quality and decontamination."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from feedweave.llm import decontamination, neighbours, quality, warc

PAGES = "page_id bigint, url string, html string, payload_bytes string"


def pages():
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", "<p>" + "".join(rng.choice("abcé🙂") for _ in range(rng.randint(0, 4000))), "c") for i in range(60)]
    rows += [(100 + i, None, rows[3][2], "c") for i in range(25)]
    rows += [(200, "u\r\nInjected: 1", "short", "c"), (201, "u", "short", "c"), (202, "u", None, "c"), (203, "u", "", "c")]
    rows += [(None, "u", rows[3][2], "c"), (None, "u", "z" * 200, "c"), (3, rows[3][1], rows[3][2], "c"), (204, "u", "y" * 300_000, "c")]
    return rows


def expected_records(rows):
    payloads = [(t or "").encode() for _, _, t, _ in rows]
    least = {}
    for (i, _, _, _), p in zip(rows, payloads, strict=True):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    out = []
    for (i, _, _, _), p in zip(rows, payloads, strict=True):
        first = least.get(p)
        revisit = len(p) >= 100 and payloads.count(p) > 1 and first is not None and (i is None or i > first)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [997, 1 << 20])
def test_round_trip_in_splits(spark, split):
    rows = pages()
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3))
    back = warc.read_archives(manifest, split_bytes=split).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr)
    assert got == expected_records(rows)
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): (t or "").encode() for _, _, t, _ in rows}
    assert all(bytes(r.payload) == texts[r.payload_digest] for r in back if r.record_type == "response")


def test_archives_are_gzip_members(spark):
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "<p>x", "c")], PAGES)).collect()
    (path,) = (warc._filesystem(m.path)[1] for m in manifest)
    raw = gzip.decompress(open(path, "rb").read())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"<p>x\r\n\r\n")


def test_candidates_inside_members_are_not_records():
    inner = warc._member(b"no record", 6)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = stored.compress(b"WARC/1.1\r\n" + inner * 3) + stored.flush()
    raw = outer + warc._member(b"WARC/1.1\r\nnext", 6)
    archive = lambda: warc._Archive(pa.BufferReader(raw), len(raw))
    whole = [p for p, _ in warc.records_in(archive(), 0, len(raw))]
    assert whole == [0, len(outer)]
    split = [p for at in range(0, len(raw), 7) for p, _ in warc.records_in(archive(), at, min(at + 7, len(raw)))]
    assert split == whole


VECTORS = "vec_id bigint, embedding array<float>, score string"


def vectors(n=600, hot=200):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist(), "x") for i in range(n)]
    rows += [(1000 + i, rows[5][1], "x") for i in range(hot)]
    rows += [(5000, None, "x"), (5020, [0.0] * 8, "x"), (5040, [1.0] * 7 + [float("nan")], "x"), (5060, [1.0] * 7 + [None], "x")]
    rows += [(None, rows[0][1], "x"), (5080, [1.0] * 9, "x"), (7, rows[7][1], "x"), (20, rows[20][1], "x")]
    return rows


def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    out = {}
    for q, v in {i: v for i, v in ok if i % every == 0}.items():
        scored = sorted((-float((v * x).sum()), i) for i, x in ok if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def test_search_of_all_leaves_is_exact(spark):
    rows = vectors()
    docs = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = neighbours.nearest(docs, k=7, sample=300, leaves=30, recall=2.0, block=64).collect()
    expected = brute_nearest(rows, 7, 20)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(expected)
    for q, found in by.items():
        assert [i for i, _ in found] == [i for i, _ in expected[q]]
        assert [s for _, s in found] == pytest.approx([s for _, s in expected[q]], abs=1e-12)


def test_calibrated_recall(spark):
    rows = vectors(3000, 0)
    docs = spark.createDataFrame(rows, VECTORS)
    got = neighbours.nearest(docs, k=10, sample=1500, leaves=75).collect()
    expected = brute_nearest(rows, 10, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found.get(q, set()) & {i for i, _ in e}) for q, e in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_fewer_candidates_than_asked_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [0.5, 1.0], "x")], VECTORS)
    assert [tuple(r) for r in neighbours.nearest(few).collect()] == [(0, 1, 1, 0.5)]
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).collect() == []


DOCS = "doc_id bigint, text string, score string, matches string"
LABELS = "doc_id bigint, quality int, toxic int"


def prose(rng, n):
    words = "the river runs past old houses where people keep small gardens and sell bread every morning to travellers".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def test_quality_is_learnt_and_held_out_rows_are_right(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        good = i % 3 > 0
        text = prose(rng, rng.randint(20, 90)) if good else " | ".join(prose(rng, 1) for _ in range(rng.randint(20, 60)))
        rows.append((i, text, "s", "m"))
        labels.append((i, int(good), 0))
    rows += [(9000, None, "s", "m"), (9001, "", "s", "m"), (None, prose(rng, 30), "s", "m"), (5, rows[5][1], "s", "m")]
    labels += [(None, 1, 0), (1, None, 0)]
    got = quality.score_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, int(r.doc_id % 3 > 0)) for r in got if r.held_out and r.doc_id < 9000]
    assert len(held) > 90 and sum(p == y for p, y in held) >= 0.97 * len(held)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "m")], DOCS)
    assert [r.score for r in quality.score_quality(docs, spark.createDataFrame([], LABELS)).collect()] == [0.5]
    assert quality.score_quality(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 0)], LABELS)).collect() == []


def test_flattened_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = quality.BoostedTrees(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


ITEMS = "item_id bigint, text string"


def plain_alignment(item, passage):
    best, h = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            step = 2 if item[i - 1] == passage[j - 1] else -1
            h[i][j] = max(0, h[i - 1][j - 1] + step, h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, passage = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 30))
        score, first, last = decontamination.align(item, passage)
        assert score == plain_alignment(item.tolist(), passage.tolist())
        if score:
            assert plain_alignment(item.tolist(), passage[first : last + 1].tolist()) == score


def test_copies_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(25)) + ".") for i in range(30)]
    text = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for i in range(120):
        middle = ""
        if i % 3 == 0:
            item = items[i % 30]
            words = item[1].rstrip(".").split()
            if i % 2:
                words = [w.upper() + "," if rng.random() > 0.2 else word() for w in words]
            middle = " ".join(words)
            planted[i] = item[0]
        rows.append((i, text(rng.randint(0, 80)) + " " + middle + " " + text(rng.randint(0, 80)), "s", "m"))
    rows += [(500, None, "s", "m"), (501, "", "s", "m"), (None, items[4][1], "s", "m")]
    items += [(900, None), (901, ""), (902, "too short"), (None, text(20))]
    for sketch_bits in (25, 6):  # six bits rule nothing out
        got = decontamination.mark_contaminated(
            spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), sketch_bits=sketch_bits
        ).collect()
        assert len(got) == len(rows)
        found = {r.doc_id: [m["item_id"] for m in r.matches] for r in got}
        assert {d: m for d, m in found.items() if m and d is not None} == {d: [i] for d, i in planted.items()}
        assert found[None] == [4]
    nothing = decontamination.mark_contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], ITEMS))
    assert all(r.matches == [] for r in nothing.collect())
    assert decontamination.mark_contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []


def test_case_does_not_hide_a_copy_in_any_script(spark):
    item = "la forêt éclaire après dîner où les élèves mangent straße größe ähnlich über köln grüße çà naïve œuvre"
    docs = [(1, "avant " + item.upper() + " APRÈS", "s", "m"), (2, "rien à voir ici", "s", "m"), (3, item.title(), "s", "m")]
    marked = decontamination.mark_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item)], ITEMS))
    assert {r.doc_id: [(m["item_id"], m["score"]) for m in r.matches] for r in marked.collect()} == {1: [(7, 1.0)], 2: [], 3: [(7, 1.0)]}


def found_items(spark, docs, items, **kw):
    rows = decontamination.mark_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **kw).collect()
    return {r.doc_id: sorted(m["item_id"] for m in r.matches) for r in rows}


def test_items_that_share_their_words_and_items_of_two_words_are_found(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("hijklmn") for _ in range(6))
    around = lambda middle: " ".join([word() for _ in range(30)] + [middle] + [word() for _ in range(30)])
    frame = [word() for _ in range(20)]
    items = [(i, " ".join(frame[:10] + [word()] + frame[10:])) for i in range(5)]
    short = [word() for _ in range(4)]
    items += [(10 + i, " ".join([*short, word()])) for i in range(5)]
    items += [(20, word() + " " + word()), (21, " ".join([word()] * 9)), (22, word())]
    docs = [(i, around(t), "s", "m") for i, t in items]
    docs += [(30, around(items[0][1]) + " " + around(items[0][1]), "s", "m"), (31, around(""), "s", "m")]
    family = {i: list(range(5)) for i in range(5)} | {i: list(range(10, 15)) for i in range(10, 15)}
    expected = family | {20: [20], 21: [21], 22: [], 30: sorted([*range(5), *range(5)]), 31: []}
    assert found_items(spark, docs, items) == expected
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
        assert found_items(spark, docs + docs, items, broadcast_rows=0) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_matches_equal_the_alignment_of_every_item_with_every_text(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, [word() for _ in range(rng.randint(6, 25))]) for i in range(12)]
    docs = []
    for i in range(50):
        _, copied = rng.choice(items)
        keep = rng.choice([1.0, 0.9, 0.8, 0.6, 0.0])
        copied = [w if rng.random() < keep else word() for w in copied]
        docs.append((i, [*(word() for _ in range(rng.randint(0, 40))), *copied, *(word() for _ in range(rng.randint(0, 40)))]))
    docs += [(100 + i, docs[i][1]) for i in range(0, 50, 7)]  # repeated rows
    rows = [(i, " ".join(w), "s", "m") for i, w in docs]
    tests = [(i, " ".join(w)) for i, w in items]
    marked = decontamination.mark_contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(tests, ITEMS)).collect()
    pairs = {(r.doc_id, m["item_id"]): m["score"] for r in marked for m in r.matches}
    expected = {}
    for doc_id, text in docs:
        for item_id, own in items:
            # Two words of the item side by side are the least there must be for a seed.
            seeded = {*zip(own, own[1:])} & {*zip(text, text[1:])}
            score = plain_alignment(own, text) / (2 * len(own))
            if score >= decontamination.LEAST_SCORE and seeded:
                expected[doc_id, item_id] = score
    assert len(marked) == len(docs) and len(expected) > 30
    assert pairs == pytest.approx(expected)


def test_every_copy_with_as_many_words_replaced_as_the_least_score_allows_is_found(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("opqrstu") for _ in range(7))
    docs, items = [], []
    for n in (10, 12, 15, 20, 40):
        own = [word() for _ in range(n)]
        items.append((n, " ".join(own)))
        # Two of five words replaced: of the pairs of words those between two fives are left.
        edited = [word() if i % 5 in (1, 3) and i < 5 * (n // 5) else w for i, w in enumerate(own)]
        docs.append((n, " ".join([*(word() for _ in range(20)), *edited, *(word() for _ in range(20))]), "s", "m"))
    assert found_items(spark, docs, items) == {n: [n] for n in (10, 12, 15, 20, 40)}


def test_a_long_passage_of_a_longer_item_is_found(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    text = lambda n: [word() for _ in range(n)]
    long, middle = text(1000), text(59)
    edited = [word() if i % 15 == 9 else w for i, w in enumerate(long[100:200])]
    glued = [*middle[:20], *text(14), *middle[34:54]]
    docs = [(1, long[400:700]), (2, middle[30:50]), (3, middle[30:45]), (4, edited), (5, glued), (6, middle)]
    docs = [(i, " ".join([*text(25), *t, *text(25)]), "s", "m") for i, t in docs]
    items = [(1, " ".join(long)), (2, " ".join(middle))]
    marked = decontamination.mark_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    got = {r.doc_id: [(m["item_id"], m["score"], m["first_word"], m["last_word"]) for m in r.matches] for r in marked}
    assert got[1] == [(1, 0.3, 25, 324)]
    assert got[2] == [(2, pytest.approx(20 / 59), 25, 44)]
    assert got[3] == [] and got[6] == [(2, 1.0, 25, 83)]
    assert [m[0] for m in got[4]] == [1] and [m[0] for m in got[5]] == [2]


@pytest.mark.parametrize("count", [1, 2, 15, 21, 22, 25])
def test_small_tables_give_every_candidate_or_k(spark, count):
    rng = np.random.default_rng(count)
    rows = [(i * 10, [float(c) for c in rng.normal(size=6)]) for i in range(count)]
    rows.append(rows[0])  # the query's own vector once more
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), sample=12, leaves=6).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.vec_id)
    for query in {i for i, _ in rows if i % 20 == 0}:
        candidates = sum(i != query for i, _ in rows)
        assert len(found.get(query, [])) == min(20, candidates) and query not in found.get(query, [])


def test_every_split_has_a_task_of_its_own(spark, tmp_path):
    """Small splits are not put into one task by adaptive execution."""
    from pyspark.sql import functions as F

    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 512), F.lit(9)).alias("html"))
    manifest = warc.write_archives(pages.repartition(3), folder=str(tmp_path))
    back = warc.read_archives(manifest, split_bytes=2000, payloads=False)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    tasks = back.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 60 and len(tasks) > 3


def test_an_empty_table_of_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(spark, pages).collect() == []
