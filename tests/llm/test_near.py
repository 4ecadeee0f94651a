"""Near-duplicates against brute force."""

import random

import pytest

from feedweave.llm import minhash_dedup
from feedweave.llm.components import components

DOCS = "doc_id bigint, text string, kept string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return lower.encode().split()


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < 5:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    parent[find(i)] = find(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = []
    for i, (doc, _, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc is not None and doc == component))
    return sorted(out, key=repr)


def edited(rng, words_, share):
    return " ".join(w if rng.random() > share else f"e{rng.randint(0, 999)}" for w in words_)


def corpus(seed, n=60):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = [(i, edited(rng, rng.choice(bases), rng.choice([0, 0.01, 0.03, 0.06, 0.3])), "x") for i in range(n)]
    rows += [(90, None, "x"), (91, "", "x"), (92, " \t ", "x"), (93, "One", "x"), (94, "oNE", "x"), (95, "one two", "x")]
    rows += [(None, rows[0][1].upper(), "x"), (7, rows[7][1], "x"), (97, "É é", "x"), (98, "é é", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = minhash_dedup.mark_near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr) == brute(rows)


def test_a_chain_of_copies_is_one_component(spark):
    """Each text is near the next only; the ends are far from each other."""
    base = [f"w{i}" for i in range(100)]
    rows = [(50 - k, " ".join(base[: 100 - 4 * k] + [f"n{k}_{i}" for i in range(0)] + [f"m{i}" for i in range(4 * k)]), "x") for k in range(20)]
    got = minhash_dedup.mark_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr) == brute(rows)


def test_copies_near_their_original_and_far_from_each_other(spark, monkeypatch):
    """Most copies link with the original alone, some with a copy alone; blocks smaller than the group."""
    monkeypatch.setattr(minhash_dedup._within_centres, "__defaults__", (16,))
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = [(1000, " ".join(base), "x")]
    for i in range(90):
        words_ = list(base)
        for at in rng.sample(range(150), rng.choice([3, 4, 5, 5, 6])):
            words_[at] = f"e{i}_{at}"
        rows.append((i, " ".join(words_), "x"))
        if i % 10 == 0:
            words_[rng.randrange(150)] = "again"
            rows.append((500 + i, " ".join(words_), "x"))
    got = minhash_dedup.mark_near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert minhash_dedup.mark_near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_the_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    copied, nameless, other, near = text(), text(), text(), text()
    rows = [(7, copied, "x"), (7, copied, "x"), (7, copied, "y"), (9, copied, "x"), (None, copied, "x"), (7, other, "x")]
    rows += [(None, nameless, "x")] * 3 + [(5, near, "x"), (4, near.upper() + " end", "x"), (6, "", "x"), (6, "", "x"), (8, None, "x")]
    rows += [(None, "", "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    expected = [(7, copied), (7, other), (None, nameless), (4, near.upper() + " end"), (6, ""), (8, None), (None, ""), (None, "")]
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=repr) == sorted(expected, key=repr)
