"""Periodic runs: stretches of words that repeat themselves with a period, and what is left without the repeats.

A run is a stretch with smallest period q, at least `max(6, 4 * q)` words long, that no neighbouring word extends. The
words of a batch of texts lie one after the other, each text closed by an end mark that occurs once.

* **Longest common extensions.** `Extensions` sorts only the suffixes at positions whose remainder modulo `PERIOD` is in
  a difference cover. For any two positions some shift below `PERIOD` brings both to sampled ones: so few words are
  compared one by one, and the rest is a range minimum over the common prefixes of neighbours in the sorted order,
  answered by a sparse table. Ties of the sort are refined by doubling, only among suffixes still tied.
* **Harmonic grid.** In a run of period q at least 3 * q positions have the word that stands q further on, so one of them
  is a multiple of 3 * q. The grid has n / (3 * q) positions for each q, n log n in all. Positions whose word differs
  from the one q further on are dropped, the others extended to the right, checked to reach 3 * q positions by one more
  extension, and extended to the left by bisection. A stretch found with several periods has the smallest.

Nothing is shuffled; a text is processed whole in one task, in about 150 bytes for each of its words. A null or empty
text has no words, no runs and nothing kept. Repeated rows are all returned. Input columns that have the name of a
result column are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import Aside, carried, column, extended
from feedweave.llm.units import pieces

# A difference cover of the remainders modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
PERIOD = 31
LEAST_WORDS = 6
LEAST_POWER = 4
RESULTS = ("n_words", "n_runs", "runs", "kept_text")
_PAIRS = 1 << 21


def _shifts() -> np.ndarray:
    """For two remainders the least shift that brings both into the cover."""
    inside = np.zeros(2 * PERIOD, dtype=bool)
    inside[list(COVER)] = True
    inside[PERIOD:] = inside[:PERIOD]
    out = np.zeros((PERIOD, PERIOD), dtype=np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            out[i, j] = next(d for d in range(PERIOD) if inside[(i + d) % PERIOD] and inside[(j + d) % PERIOD])
    return out


_SHIFT = _shifts()
_PLACE = np.full(PERIOD, -1, dtype=np.int64)
_PLACE[list(COVER)] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions of positions in one array of word numbers (from 1) that ends with a unique one."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.zeros(2 * PERIOD, dtype=np.int64)])
        at = (np.arange(-(-n // PERIOD))[:, None] * PERIOD + np.array(COVER)).ravel()
        at = at[at < n]
        levels = self._sorted(at, int(words.max(initial=1)).bit_length())
        self.rank = levels[-1]
        order = np.empty(len(at), dtype=np.int64)
        order[self.rank] = np.arange(len(at))
        self.tables = self._minima(self._common(at, order, levels))

    def _sorted(self, at: np.ndarray, bits: int) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first PERIOD words, twice that, and so on until no two are tied."""
        count = len(at)
        rank, tied = np.zeros(count, dtype=np.int64), np.arange(count)
        packed = max(1, 62 // bits)
        for first in range(0, PERIOD, packed):
            key = np.zeros(len(tied), dtype=np.int64)
            for k in range(first, min(first + packed, PERIOD)):
                key = (key << bits) | self.words[at[tied] + k]
            tied = self._refined(rank, tied, key)
        levels, step = [rank.copy()], len(COVER)
        while len(tied):
            ahead = tied + step
            key = np.where(ahead < count, levels[-1][np.minimum(ahead, count - 1)], -1)
            tied = self._refined(rank, tied, key)
            levels.append(rank.copy())
            step *= 2
        return levels

    @staticmethod
    def _refined(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Order the tied suffixes of each rank by the key; returns those still tied."""
        if not len(tied):
            return tied
        order = np.lexsort((key, rank[tied]))
        tied, key = tied[order], key[order]
        old = rank[tied]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = old[1:] != old[:-1]
        places = np.arange(len(tied))
        slot = old + places - np.maximum.accumulate(np.where(new, places, 0))
        new[1:] |= key[1:] != key[:-1]
        rank[tied] = np.maximum.accumulate(np.where(new, slot, 0))
        alone = new & np.append(new[1:], True)
        return tied[~alone]

    def _common(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each suffix has in common with the next in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for level in range(len(levels) - 2, -1, -1):
            step = len(COVER) << level
            same = levels[level][a] == levels[level][b]
            a[same] += step
            b[same] += step
            common[same] += PERIOD << level
        return common + self._compared(at[a], at[b], np.full(len(a), PERIOD))

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        tables = [values]
        while 2 << (len(tables) - 1) <= len(values):
            half = 1 << (len(tables) - 1)
            tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
        return tables

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from two positions on, compared one by one up to `most`."""
        equal = np.zeros(len(i), dtype=np.int64)
        going = np.flatnonzero(most > 0)
        step = 0
        while len(going):
            going = going[self.words[i[going] + step] == self.words[j[going] + step]]
            step += 1
            equal[going] = step
            going = going[most[going] > step]
        return equal

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from positions i and j on, i <> j."""
        shift = _SHIFT[i % PERIOD, j % PERIOD]
        equal = self._compared(i, j, shift)
        rest = np.flatnonzero(equal == shift)
        a, b = i[rest] + shift[rest], j[rest] + shift[rest]
        a = self.rank[a // PERIOD * len(COVER) + _PLACE[a % PERIOD]]
        b = self.rank[b // PERIOD * len(COVER) + _PLACE[b % PERIOD]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            table = self.tables[k]
            equal[rest[own]] += np.minimum(table[low[own]], table[high[own] - (1 << k)])
        return equal


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place in the owner of every element."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _grid(begin: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grid positions of all periods of all texts: text, position and period, in blocks of bounded size."""
    text, period = _spread(np.maximum(length // LEAST_POWER, 0))
    period += 1
    counts = (length[text] - period - 1) // ((LEAST_POWER - 1) * period) + 1
    block = np.cumsum(counts) // _PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(text)]
    for first, last in zip(cuts, cuts[1:], strict=False):
        own, place = _spread(counts[first:last])
        q = period[first:last][own]
        yield text[first:last][own], begin[text[first:last][own]] + place * (LEAST_POWER - 1) * q, q


def find_runs(words: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of texts at `begin` of `length` words: text, start, length and period, in order."""
    none = np.empty(0, dtype=np.int64)
    found = [(none, none, none, none)]
    extensions = None
    for text, at, q in _grid(begin, length):
        same = words[at] == words[at + q]
        text, at, q = text[same], at[same], q[same]
        if not len(at):
            continue
        extensions = extensions or Extensions(words)
        reach = at + extensions.of(at, at + q)
        # The grid positions of one stretch follow each other and reach equally far; one of them is enough.
        once = np.ones(len(at), dtype=bool)
        once[1:] = (reach[1:] != reach[:-1]) | (q[1:] != q[:-1])
        text, at, q, reach = (x[once] for x in (text, at, q, reach))
        # The stretch of positions equal to the one q further on must hold 3 * q of them, and 6 - q.
        least = np.maximum((LEAST_POWER - 1) * q, LEAST_WORDS - q)
        low = np.minimum(at, reach - least)
        inside = low >= begin[text]
        text, at, q, reach, low = (x[inside] for x in (text, at, q, reach, low))
        far = extensions.of(low, low + q) >= at - low
        text, at, q, reach, low = (x[far] for x in (text, at, q, reach, low))
        least_start = begin[text]
        while len(going := np.flatnonzero(least_start < low)):
            middle = (least_start[going] + low[going]) // 2
            reaches = extensions.of(middle, middle + q[going]) >= low[going] - middle
            low[going[reaches]] = middle[reaches]
            least_start[going[~reaches]] = middle[~reaches] + 1
        found.append((text, low - begin[text], reach - low + q, q))
    text, start, size, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, size, start, text))
    text, start, size, q = (x[order] for x in (text, start, size, q))
    first = np.ones(len(text), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    text, start, size, q = (x[first] for x in (text, start, size, q))
    order = np.lexsort((q, start, text))
    return tuple(x[order] for x in (text, start, size, q))


def _collapsed(change: Callable[[object, list[bytes]], list[bytes]] | None):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            texts = [(t or b"").split() for t in batch.column("_text").cast(pa.binary()).to_pylist()]
            if change is not None:
                texts = [change(k, t) for k, t in zip(batch.column("_key").to_pylist(), texts, strict=True)]
            length = np.fromiter(map(len, texts), np.int64, len(texts))
            begin = np.cumsum(length + 1) - length - 1
            flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
            words = np.empty(int(length.sum()) + len(texts), dtype=np.int64)
            is_end = np.zeros(len(words), dtype=bool)
            is_end[begin + length] = True
            words[~is_end] = flat.indices.to_numpy().astype(np.int64) + 1
            words[is_end] = len(flat.dictionary) + 1 + np.arange(len(texts))
            text, start, size, q = (x.tolist() for x in find_runs(words, begin, length))
            runs: list[list[dict]] = [[] for _ in texts]
            for i, s, n, p in zip(text, start, size, q, strict=True):
                runs[i].append({"start": s, "length": n, "period": p})
            kept = [b" ".join(_without(t, r)).decode() for t, r in zip(texts, runs, strict=True)]
            rest = [n for n in batch.schema.names if n not in ("_text", "_key")]
            run = pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()})
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in rest),
                    pa.array(length),
                    pa.array([len(r) for r in runs], pa.int64()),
                    pa.array(runs, pa.list_(run)),
                    pa.array(kept, pa.string()),
                ],
                names=[*rest, *RESULTS],
            )

    return of


def _without(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), dtype=bool)
    for r in runs:
        kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def with_periods(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Words of one document in ten go round in a circle from some place on, as doc_id says; none for a null id."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    circle = words[a : a + p]
    return words[:a] + [circle[i % p] for i in range(n - a)]


def collapse_runs(
    docs: DataFrame,
    text: str = "text",
    key: str | None = None,
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """The documents with `n_words`, `n_runs`, `runs` (by start, then period) and `kept_text`.

    `change(value of the column key, words)` may give other words than the text's.
    """
    aside = Aside(carried(docs, *RESULTS))
    source = docs.select(
        *aside.out(),
        column(text).alias("_text"),
        *([column(key).alias("_key")] if change else []),
    )
    results = "n_words bigint, n_runs bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept_text string"
    found = source.mapInArrow(_collapsed(change), extended(source, aside.inner, results))
    return found.select(*aside.back(), *RESULTS)


def digest(found: DataFrame) -> DataFrame:
    """One row for each document: its longest run, and hashes of all runs and of what is left."""
    best = F.array_max(
        F.transform(
            "runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
        )
    )
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("_best", best).select(
        "doc_id",
        "n_runs",
        (-F.col("_best.s")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.p)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )

