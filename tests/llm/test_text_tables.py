"""Token counts, sharding and mixing: against the library, and by the laws they promise."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedweave.llm import mixing, sharding, token_counts

DOCS = "doc_id bigint, text string, source string, size string"


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    words = ["a", "the", "naïve", "x" * 30, "1234", "don't", "日本", " ", "<|endoftext|>", "🙂", "!!", "\n\n", " ", "\t"]
    rows = [
        (i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["a", "é", "z", None]), "s")
        for i in range(n)
    ]
    rows += [(n, None, "a", "s"), (n + 1, "", None, None), (None, "no id", "b", "s"), (5, rows[5][1], rows[5][2], "s")]
    rows += [(200 + i, "copied text of some words", "hot", "s") for i in range(60)]
    return rows


def test_counts_equal_the_library(spark):
    texts = [t for _, t, _, _ in corpus(n=300)]
    texts += ["  lead", "trail  ", "a\u0085b \x1c c", "<|endoftext|><|endoftext|>", "e" * 5000, "ab" * 3000, "'s'LL we'll", "\r\n \r\n"]
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == expected
    assert all(got[i].n_bytes == len((t or "").encode()) for i, t in enumerate(texts))
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.values())


def test_forgetting_changes_no_count(monkeypatch):
    counter = token_counts.TextCounter(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = [t for _, t, _, _ in corpus(3)]
    before = [counter(t) for t in texts]
    monkeypatch.setattr(token_counts, "REMEMBERED", 2)
    counter.merger.remembered.clear()
    assert [counter(t) for t in texts] == before


@pytest.mark.parametrize("shards", [4, 16, 1000])
def test_shards_are_balanced_contiguous_and_gapless(spark, shards):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sharding.shard_by_bytes(docs, shards=shards).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 1 for _, t, _, _ in rows)
    total = sum(r.size for r in got)
    largest = max(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for shard in range(shards):
        held = sum(r.size for r in by.get(shard, []))
        assert abs(held - total / shards) <= largest + 2 * 0.01 * total / shards
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))


def test_small_groups_of_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 300}" * 3, "s", "x") for i in range(900)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS), shards=4, tight=0.05).collect()
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values())


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % 3]) for i, s in enumerate(order)}
    target, total = {}, share * sum(sizes.values())
    open_ = set(order)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
    return target


def test_mix_meets_its_targets(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    mixed = mixing.mix(docs, shards=4, blocks=16)
    got = mixed.collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    expected = brute_targets(sizes)
    for s in sizes:
        of = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(expected[s]) for r in of)
        assert sum(r.taken for r in of) == round(expected[s])
    assert all(r.size == size(r.text) and 0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix(docs.repartition(3), shards=4, blocks=16).collect()
    key = lambda r: (repr(r.doc_id), repr(r.text), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    # Every block lies in one shard, and each source's blocks are dealt over the shards.
    blocks = {}
    for r in got:
        for d in r.draws:
            blocks.setdefault((r.source, d["block"]), set()).add(d["shard"])
    assert all(len(s) == 1 and None not in s for s in blocks.values())
    assert len({next(iter(s)) for (source, _), s in blocks.items() if source == "hot"}) >= 3
    assert mixing.drawn(mixed).count() == sum(len(r.draws) for r in got)


def test_hypergeometric_draws_have_the_law(spark):
    from pyspark.sql import functions as F

    draws = spark.range(4000).select(
        mixing._hypergeometric(F.lit(10), F.lit(8), mixing._uniform(F.lit(1), "id")).alias("k")
    )
    ks = [r.k for r in draws.collect()]
    assert min(ks) >= 2 and max(ks) <= 8
    assert sum(ks) / len(ks) == pytest.approx(5, abs=0.1)
    variance = sum((k - 5) ** 2 for k in ks) / len(ks)
    assert variance == pytest.approx(10 * 0.5 * 0.5 * (16 - 10) / (16 - 1), abs=0.15)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for result in (mixing.mix(docs), sharding.shard_by_bytes(docs), token_counts.count_tokens(docs)):
        assert result.collect() == []
    empty = spark.createDataFrame([(1, None, None, None), (2, "", "a", None)], DOCS)
    assert [r.taken for r in mixing.mix(empty).collect()] == [0, 0]
