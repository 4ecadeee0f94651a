"""Suffix-array and substring dedup against brute force."""

import hashlib
import random

import pytest

from feedweave.llm import substring_dedup, suffix_dedup
from feedweave.llm.units import Words, sliding_minimum, utf8

DOCS = "doc_id bigint, text string, spans string"


def passages(seed, docs=40, alphabet="ab é"):
    """Texts stitched from shared passages, edited copies, exact copies, empty and null ones."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.randint(5, 60)) for _ in range(6)]
    out = []
    for i in range(docs):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(0, 30)) for _ in range(rng.randint(0, 4))]
        out.append((i, "".join(parts), "x"))
    out += [(100, None, "x"), (101, "", "x"), (None, out[0][1], "x"), (3, out[3][1], "x"), (3, out[4][1], "x")]
    return out + [(200 + i, shared[0] + shared[1], "y") for i in range(8)]


def brute_bytes(rows, length):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for (doc, _, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = [s for s in bytes(gone).split(b"\x00") if s]
        out.append((doc, len(t), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), len(kept)))
    return out


def brute_words(rows, length):
    texts = [(t or "").encode().split() for _, t, _ in rows]
    order = lambda d: (1 << 63) - 1 if d is None else d
    least = {}
    for (doc, _, _), w in zip(rows, texts, strict=True):
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            least[key] = min(least.get(key, order(doc)), order(doc))
    out = []
    for (doc, _, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if least[tuple(w[p : p + length])] < order(doc):
                gone[p : p + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_equals_brute_force(spark, seed):
    rows = passages(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, length=12, seed=4, step=3))
    assert ordered(got.collect()) == ordered(brute_bytes(rows, 12))


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = passages(seed, alphabet="ab c d  ")
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = substring_dedup.digest(substring_dedup.remove_repeated_words(docs, length=6, seed=2))
    assert ordered(got.collect()) == ordered(brute_words(rows, 6))


def test_runs_of_one_character_and_long_texts(spark):
    rows = [(1, "a" * 3000, "x"), (2, "a" * 399, "x"), (3, "b" * 400, "x"), (4, "c" * 400 + "a" * 400, "x")]
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)))
    assert ordered(got.collect()) == ordered(brute_bytes(rows, 400))
    words = [(1, "a " * 900, "x"), (2, "a " * 60, "x"), (3, "b " * 50, "x"), (4, "b " * 49 + "a " * 50, "x")]
    got = substring_dedup.digest(substring_dedup.remove_repeated_words(spark.createDataFrame(words, DOCS)))
    assert ordered(got.collect()) == ordered(brute_words(words, 50))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect() == []
    assert substring_dedup.digest(substring_dedup.remove_repeated_words(docs)).collect() == []


def test_one_sequence_over_many_buckets(spark):
    """A third of all rows share one passage; with more buckets than keys, equal rows still meet."""
    passage = "the quick brown fox jumps over it"
    rows = [(i, f"{i * 7919 % 1000:04d}" * 3 + passage + f"{i * 104729 % 1000:04d}" * 3, "x") for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, length=12, seed=4, step=3)).collect()
        words = [(i, " ".join(t), "x") for i, t, _ in rows]
        got_words = substring_dedup.digest(
            substring_dedup.remove_repeated_words(spark.createDataFrame(words, DOCS), length=6, seed=2)
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ordered(got) == ordered(brute_bytes(rows, 12))
    assert ordered(got_words) == ordered(brute_words(words, 6))


def test_words_and_minima():
    import numpy as np
    import pyarrow as pa

    texts = ["a  b\tc", None, "", " \n ", "é\x0bx y"]
    words = Words(*utf8(pa.array(texts)))
    assert words.counts.tolist() == [len((t or "").encode().split()) for t in texts]
    values = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 3, 200, 201):
        expected = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
        assert sliding_minimum(values, width).tolist() == expected
