"""Collocations, fingerprints and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from feedweave.llm import collocations, periodic_runs, simhash_dedup

#: Extra columns that have names of results or of inner columns, in either case.
DOCS = "doc_id bigint, text string, lang string, `Key` string, fingerprint string, n_runs string, phrase string, `_c0` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "f", "r", "p", 1) for r in rows], DOCS).repartition(3)


# Collocations.


def brute_collocations(rows, least, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 4):
                    if i + k <= len(w):
                        counts[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    by_lang = {}
    for (lang, w), a in found.items():
        if len(w) == 2 and any(len(v) == 3 and o == lang and w in (v[:2], v[1:]) and 100 * b >= 50 * a for (o, v), b in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, counts[lang, w[:k]], counts[lang, w[k:]]))
    out = []
    for lang, phrases in by_lang.items():
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(phrases)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, totals[lang], -score))
    return sorted(out)


def talk(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "new", "york", "Straße", "x\x01", "a", "b", "-", "\x1f", "é"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " ,"]) for _ in range(rng.randint(0, 60)))
    rows = [(i, text(), rng.choice(["en", "de", None, "und", "a\tb", "", "a|tb", "|/\t|"])) for i in range(n)]
    return rows + [(90, None, "en"), (91, "", None), (92, " .. ", "fr"), (None, "new york " * 30, "en"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", range(2))
def test_collocations_equal_brute_force(spark, seed, monkeypatch):
    """Many ranges, so that phrases and languages go on over their edges; chunks smaller than a text."""
    monkeypatch.setattr(collocations, "_CHUNK", 7)
    rows = talk(seed)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = collocations.collocations(frame(spark, rows), least=3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(tuple, got)) == brute_collocations(rows, 3)


def test_ranks_stop_at_the_limit(spark):
    rows = talk(5)
    got = collocations.collocations(frame(spark, rows), least=3, top=4).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 3, 4)


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: the same phrase with counts near 10^12."""
    from pyspark.sql import functions as F

    big = 10**12 + 7
    rows = [(0, ["x"], 3 * big), (1, ["a"], 2 * big), (1, ["b"], big + 3), (2, ["a", "b"], big)]
    counts = spark.createDataFrame(rows, "level int, words array<string>, n bigint").withColumn("lang", F.lit("en"))
    got = collocations.ranked_phrases(counts).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big, 2 * big, big + 3, 3 * big, 10**6 * big * big // (2 * big * (big + 3)))]


def test_no_documents_no_collocations(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None)])).collect() == []


# Fingerprints.


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, docs, bits=4):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = list(parent)
    for i, x in enumerate(known):
        for y in known[:i]:
            if (x ^ y).bit_count() <= bits:
                parent[find(x)] = find(y)
    least = {}
    for p, d in zip(prints, docs, strict=True):
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return [least.get(find(p)) for p in prints]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    bases = [[f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 90))] for _ in range(12)]
    rows = []
    for i in range(80):
        words = [w if rng.random() > 0.02 else "Edit" for w in rng.choice(bases)]
        rows.append((i, " ".join(words), "en"))
    rows += [(90, None, None), (91, "", "en"), (92, "\t", "en"), (None, rows[0][1].upper(), "en"), rows[3], rows[3]]
    rows += [(None, "only without an id", "en"), (93, "É é", "en"), (94, "two  Words", "en"), (95, "tWO words", "en")]
    got = simhash_dedup.mark_simhash_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "Key", "n_runs", "phrase", "_c0", "fingerprint", "component_id"]
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    expected = [(d, f"{p:016x}", c) for (d, _, _), p, c in zip(rows, prints, brute_components(prints, [r[0] for r in rows]), strict=True)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=repr) == sorted(expected, key=repr)


def test_long_lists_are_refined_and_lose_no_link(spark):
    """Lists and blocks far shorter than the groups: every way of refining is taken."""
    from feedweave.llm.components import components

    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in (0, rng.getrandbits(64), 0xFFFF_FFFF_0000_0000):
        for _ in range(50):
            prints.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 9))}))
        for _ in range(60):  # the same four bytes
            prints.add(base ^ sum({1 << rng.randrange(32) for _ in range(rng.randint(0, 9))}))
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    found = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "_print bigint"), long=6, block=9)
    pairs = found.collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in pairs)
    roots = {r.node: r.root for r in components(found).collect()}
    expected = brute_components(prints, range(len(prints)))
    group = {}
    for s, c in zip(signed, expected, strict=True):
        group.setdefault(c, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in group.values()) and len({next(iter(g)) for g in group.values()}) == len(group)
    assert len(group) > 20


def test_no_documents_no_fingerprints(spark):
    assert simhash_dedup.mark_simhash_duplicates(frame(spark, [])).collect() == []


# Periodic runs.


def brute_runs(w):
    out, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - start
            if size >= max(6, 4 * q):
                out.setdefault((start, size), q)
    return sorted((s, size, q) for (s, size), q in out.items())


def brute_digest(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *first, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def babble(rng):
    """Words of a small alphabet with repeats inside repeats."""
    if rng.random() < 0.3:
        return [rng.choice("ab") for _ in range(rng.randint(0, 40))]
    part = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
    part = part * rng.randint(1, 5) + [rng.choice("abc")] * rng.randint(0, 7)
    return [rng.choice("abc") for _ in range(rng.randint(0, 5))] + part * rng.randint(1, 6) + part[: rng.randint(0, 9)]


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_words_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [babble(rng) for _ in range(400)] + [[], ["a"] * 5, ["a"] * 6, ["a"] * 300, list("ab") * 100, list("abc" * 60 + "x") * 5]
    length = np.array([len(t) for t in texts])
    begin = np.cumsum(length + 1) - length - 1
    numbers = {w: i + 1 for i, w in enumerate("abcx")}
    words = np.concatenate([[numbers[w] for w in t] + [10 + i] for i, t in enumerate(texts)]).astype(np.int64)
    text, start, size, q = periodic_runs.find_runs(words, begin, length)
    got = [[] for _ in texts]
    for i, *run in zip(text.tolist(), start.tolist(), size.tolist(), q.tolist(), strict=True):
        got[i].append(tuple(run))
    assert got == [brute_runs(t) for t in texts]


def test_extensions_equal_brute_force():
    rng = random.Random(9)
    for n in (1, 2, 5, 40, 700):
        words = np.array([rng.choice([1, 1, 1, 2]) for _ in range(n)] + [3], dtype=np.int64)
        e = periodic_runs.Extensions(words)
        i, j = np.array([(i, j) for i in rng.sample(range(n + 1), min(n + 1, 30)) for j in rng.sample(range(n + 1), min(n + 1, 30)) if i != j]).T
        expected = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            k = 0
            while max(a, b) + k <= n and words[a + k] == words[b + k]:
                k += 1
            expected.append(k)
        assert e.of(i, j).tolist() == expected


def test_periodic_runs_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "\n", "  "]).join(babble(rng)), "en") for i in range(120)]
    rows += [(200, None, "en"), (201, "", "en"), (None, "x " * 9, None), (None, None, None), rows[0], rows[0], (202, "é " * 2000, "en")]
    found = periodic_runs.collapse_runs(frame(spark, rows), key="doc_id", change=periodic_runs.with_periods)
    assert found.columns == ["doc_id", "text", "lang", "Key", "fingerprint", "phrase", "_c0", "n_words", "n_runs", "runs", "kept_text"]
    got = sorted((tuple(r) for r in periodic_runs.digest(found).collect()), key=repr)
    assert got == sorted((brute_digest(d, t) for d, t, _ in rows), key=repr)
    assert sum(r[1] > 1 for r in got) > 30


def test_no_documents_no_runs(spark):
    assert periodic_runs.digest(periodic_runs.collapse_runs(frame(spark, []))).collect() == []
