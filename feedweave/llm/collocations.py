"""Phrase collocations: phrases of two and three words whose words belong together, best first for each language.

The layout is that of external n-gram estimation: counts are streams in sorted order, and what a phrase needs from other
phrases comes from reading two streams side by side.

* **Prefix order.** Every word starts one window of up to three words that ends with its piece. Windows are counted
  inside batches first, then dealt over ranges between sampled splitters and sorted by language and words, so that a task
  reads the counts of one, two and three words off one pass over its range: all windows that start with a phrase stand together. Phrases that a
  range's first or last row belongs to may go on in the next range; their partial counts (two rows for each range and
  length at most) are added up. Rarer phrases than `least` end here: neither they nor longer ones can be candidates.
* **Left and extension counts** come from the same order: a two-word phrase and the three-word phrases that it begins
  are neighbours. **Right counts**, and extensions to the left, come from the stream sorted anew in suffix order, where
  a two-word phrase meets the three-word phrases that it ends. Counts of single words join by sorted merge.
* **Score**: for each cut `scale * a * a / (l * r)` rounded down, in decimals of 38 digits: exact up to a = 10^15.

A word that starts a third of all windows is dealt over as many ranges as its windows ask for; one exact phrase has at
most one row for each batch of the input. Null texts are empty; a null language is `und`. Repeated rows count again.
Texts are processed whole. Other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.common import column, stored
from feedweave.llm.units import pieces, utf8

LEAST = 10
TOP = 2000
SCALE = 1_000_000
COVERED = 50
PARTS = 32
SAMPLED_DOCS = 2_000
SAMPLE = 50_000
_BATCH_BYTES = 1 << 22
_CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LARGE = pa.large_binary()
#: How a language's own tabs are written: a vertical bar no longer stands alone, so the pairs can be told back.
_ESCAPES = (("|", "|/"), ("\t", "|t"))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, its text, and how many words from it on (3 at most) are in its piece."""
    inside = ~(_BLANK | _STOP)[data]
    filled = np.diff(offsets) > 0
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[first] = inside[first]
    ends[last] = inside[last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    # The number of stops before each byte tells pieces apart, together with the text.
    piece = np.cumsum(_STOP[data], dtype=np.int32)[start] if len(start) else start
    goes_on = np.zeros(len(start) + 2, dtype=np.int64)
    goes_on[: max(len(start) - 1, 0)] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    size = 1 + goes_on[:-2] * (1 + goes_on[1:-1])
    return start, stop, text, size


def _strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Slices of one buffer, in order and without overlap, as a binary column."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[start] += 1
    inside[stop] -= 1
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    kept = data[np.cumsum(inside[:-1]).astype(bool)]
    return pa.LargeBinaryArray.from_buffers(
        _LARGE, len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))]
    )


def _windows(splitters: list[bytes]):
    """The different windows of `_CHUNK` words at a time with their counts and the range that each falls in."""
    ranges = _Ranges(splitters)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _BATCH_BYTES):
            data, offsets = utf8(batch.column("text"))
            data = _LOWER[data]
            start, stop, text, size = _words(data, offsets)
            names = batch.column("lang").dictionary_encode()
            lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
            for at in range(0, len(start), _CHUNK):
                to = min(at + _CHUNK, len(start))
                far = min(to + 2, len(start))
                words = _strings(data[start[at] : stop[far - 1]], start[at:far] - start[at], stop[at:far] - start[at])
                coded = words.dictionary_encode()
                # Number 0 stands for no word; a chunk has fewer than 2^21 words.
                ids = np.zeros(to - at + 2, dtype=np.int64)
                ids[: far - at] = coded.indices.to_numpy().astype(np.int64) + 1
                n = size[at:to]
                key = ids[:-2] << 42 | np.where(n > 1, ids[1:-1], 0) << 21 | np.where(n > 2, ids[2:], 0)
                # Each word ends with a blank, so that the windows that begin with a phrase stand together in byte order.
                blank = pc.binary_join_element_wise(coded.dictionary, pa.scalar(b"", _LARGE), pa.scalar(b" ", _LARGE))
                table = pa.concat_arrays([pa.array([b""], _LARGE), blank])
                order = np.argsort(lang[at:to], kind="stable")
                own = lang[at:to][order]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                for first, last in zip(cuts, cuts[1:], strict=False):
                    head = names.dictionary[int(own[first])].as_py().encode() + b"\t"
                    yield from _rows(head, table, ranges, *np.unique(key[order[first:last]], return_counts=True))

    return found


def _rows(head: bytes, words: pa.Array, ranges: _Ranges, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    low = (1 << 21) - 1
    for at in range(0, len(key), 1 << 16):
        part = key[at : at + (1 << 16)]
        text = [words.take(pa.array(ids)) for ids in (part >> 42, part >> 21 & low, part & low)]
        joined = pc.binary_join_element_wise(pa.scalar(head, _LARGE), *text, pa.scalar(b"", _LARGE)).cast(pa.binary())
        yield pa.RecordBatch.from_pydict(
            {
                "window": joined.cast(pa.string()),
                "n": pa.array(count[at : at + (1 << 16)].astype(np.int64)),
                "part": pa.array(ranges.of(joined)),
            }
        )


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; the buffer ends with eight more bytes."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))


class _Ranges:
    """Ranges of windows in byte order, between splitters."""

    def __init__(self, splitters: list[bytes]):
        self.splitters = np.array(sorted(set(splitters)), dtype=object)
        self.heads = np.array([int.from_bytes(s[:8].ljust(8, b"\0"), "big") for s in self.splitters], dtype=np.uint64)

    def of(self, windows: pa.Array) -> np.ndarray:
        data, offsets = utf8(windows)
        size = np.diff(offsets)
        head = _eights(np.append(data, np.zeros(8, np.uint8)))[offsets[:-1]].byteswap()
        beyond = np.maximum(8 - size, 0).astype(np.uint64) * np.uint64(8)
        head = head >> beyond << beyond
        part = np.searchsorted(self.heads, head, side="left")
        # The first eight bytes decide for nearly all; the others are compared as a whole.
        tied = np.flatnonzero(part < np.searchsorted(self.heads, head, side="right"))
        if len(tied):
            whole = np.array(windows.take(pa.array(tied)).to_pylist(), dtype=object)
            part[tied] = np.searchsorted(self.splitters, whole, side="right")
        return part.astype(np.int32)


class _Level:
    """Counts of the phrases of one length on a pass over sorted windows; the last phrase stays open between batches."""

    def __init__(self, least: int):
        self.least = least
        self.open: bytes | None = None
        self.count = 0
        self.first = True

    def feed(self, starts: np.ndarray, name, counts: np.ndarray) -> Iterator[tuple[bytes, int, bool]]:
        """Phrases that end in this batch. `name(i)` is the phrase that begins at `starts[i]`, empty for none."""
        if not len(starts):
            self.count += int(counts.sum())
            return
        self.count += int(counts[: starts[0]].sum())
        yield from self.closed()
        sums = np.add.reduceat(counts, starts)
        for i in np.flatnonzero((sums >= self.least) | (self.first & (np.arange(len(sums)) == 0))).tolist():
            if i < len(sums) - 1 and (phrase := name(i)):
                yield phrase, int(sums[i]), self.first and i == 0
        self.first = self.first and len(sums) == 1
        self.open, self.count = name(len(sums) - 1), int(sums[-1])

    def closed(self, last: bool = False) -> Iterator[tuple[bytes, int, bool]]:
        if self.open is None:
            return
        edge = self.first or last
        if self.open and (edge or self.count >= self.least):
            yield self.open, self.count, edge
        self.first, self.open, self.count = False, None, 0


def _ends(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Bytes of each window up to its language, first, second and third word; beyond the window for words it lacks."""
    begin, size = offsets[:-1], np.diff(offsets)
    marks = np.flatnonzero((data == 32) | (data == 9))
    first = np.searchsorted(marks, begin)
    count = np.searchsorted(marks, offsets[1:]) - first
    marks = np.append(marks, [0] * 4)
    return [np.where(count > k, marks[first + k] + 1 - begin, size + 1) for k in range(4)]


def _common(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Leading bytes that each window has in common with the one before, eight bytes at a time."""
    begin, size = offsets[:-1], np.diff(offsets)
    least = np.append(0, np.minimum(size[1:], size[:-1]))
    eights = _eights(np.append(data, np.zeros(8, np.uint8)))
    common = np.zeros(len(size), dtype=np.int64)
    going = np.flatnonzero(least > 0)
    while len(going):
        differ = eights[begin[going] + common[going]] ^ eights[begin[going - 1] + common[going]]
        equal = (np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        common[going] += np.where(differ == 0, 8, equal)
        going = going[(differ == 0) & (common[going] < least[going])]
    return np.minimum(common, least)


def _counted(least: int):
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of a range of sorted windows: all languages, and phrases with `least` occurrences or at an edge."""
        levels = [_Level(least if k else 0) for k in range(4)]
        before = b""
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_arrays([pa.array([before.decode()], pa.string()), batch.column("window")])
            data, offsets = utf8(rows)
            counts = batch.column("n").to_numpy()
            ends = [x[1:] for x in _ends(data, offsets)]
            common, begin, size = _common(data, offsets)[1:], offsets[1:-1], np.diff(offsets)[1:]
            raw = data.tobytes()
            found = []
            for k, level in enumerate(levels):
                starts = np.flatnonzero(common < ends[k])

                def name(i: int, k: int = k, starts: np.ndarray = starts) -> bytes:
                    row = starts[i]
                    return raw[begin[row] : begin[row] + ends[k][row]] if ends[k][row] <= size[row] else b""

                found += [(k, *x) for x in level.feed(starts, name, counts)]
            before = raw[offsets[-2] :]
            yield _found(found)
        yield _found([(k, *x) for k, level in enumerate(levels) for x in level.closed(last=True)])

    return phrases


def _found(rows: list[tuple[int, bytes, int, bool]]) -> pa.RecordBatch:
    level, phrase, n, edge = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(level, pa.int32()), pa.array([p.decode() for p in phrase], pa.string()), pa.array(n, pa.int64()), pa.array(edge, pa.bool_())],
        names=["level", "phrase", "n", "edge"],
    )


def _splitters(source: DataFrame, parts: int) -> list[bytes]:
    """Bounds of ranges with about as many windows each, from some windows of about `SAMPLED_DOCS` documents.

    They only say which task counts a window: results don't depend on them. Spark's own range partitioning would take
    its sample from the windows of all texts.
    """
    rows = source.count()
    share = min(1.0, SAMPLED_DOCS / max(rows, 1))
    some = source.sample(share, seed=7) if share < 1 else source
    windows = some.mapInArrow(_windows([]), "window string, n bigint, part int").select("window")
    # About 32 documents' worth of windows, whatever the number of tasks that bring them.
    thin = max(1, min(rows, SAMPLED_DOCS) // 32)
    drawn = windows.where(F.pmod(F.xxhash64("window"), F.lit(thin)) == 0).limit(SAMPLE).collect()
    drawn = sorted(row[0].encode() for row in drawn)
    return [drawn[len(drawn) * k // parts] for k in range(1, parts)] if len(drawn) >= parts else drawn[: parts - 1]


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """Counts (level, lang, words, n) of phrases of one to three words with `least` occurrences; level 0: all words."""
    # A tab ends the language in a window, so a language's own tabs are written in another way.
    named = F.coalesce(column(lang), F.lit("und"))
    for plain, written in _ESCAPES:
        named = F.replace(named, F.lit(plain), F.lit(written))
    source = docs.select(column(text).alias("text"), named.alias("lang"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = source.mapInArrow(_windows(_splitters(source, parts)), "window string, n bigint, part int")
    windows = found.repartitionById(parts, "part").select("window", "n")
    counted = stored(
        windows.sortWithinPartitions("window").mapInArrow(
            _counted(least), "level int, phrase string, n bigint, edge boolean"
        ),
        "phrases",
    )
    edges = counted.where("edge").groupBy("level", "phrase").agg(F.sum("n").alias("n")).where(
        (F.col("level") == 0) | (F.col("n") >= least)
    )
    whole = counted.where("not edge").select("level", "phrase", "n").unionAll(edges)
    parts = F.split(F.col("phrase"), "\t")
    named = parts[0]
    for plain, written in reversed(_ESCAPES):
        named = F.replace(named, F.lit(written), F.lit(plain))
    return stored(
        whole.select(
            "level",
            named.alias("lang"),
            F.when(F.col("level") > 0, F.split(F.rtrim(parts[1]), " ")).alias("words"),
            "n",
        ),
        "counts",
    )


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED
) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n and score.

    `covered`: a phrase is left out if a longer one that holds it occurs that many per cent as often.
    """
    return ranked_phrases(phrase_counts(docs, text, lang, least), top, covered)


def ranked_phrases(counts: DataFrame, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """Each language's best phrases from the counts of all phrases that have enough occurrences."""
    word = lambda name, n: counts.where("level = 1").select(
        "lang", F.col("words")[0].alias(name), F.col("n").alias(n)
    )
    phrases = counts.where("level > 1").select(
        "lang", "level", "words", F.col("n").alias("a"), F.col("words")[0].alias("first"), F.element_at("words", -1).alias("last")
    )
    in_prefix_order = Window.partitionBy("lang", F.col("words")[0], F.col("words")[1])
    in_suffix_order = Window.partitionBy("lang", F.element_at("words", -2), F.element_at("words", -1))
    of = lambda level, order: F.max(F.when(F.col("level") == level, F.col("a"))).over(order)
    joined = (
        phrases.withColumns({"head": of(2, in_prefix_order), "to_right": of(3, in_prefix_order)})
        .withColumns({"tail": of(2, in_suffix_order), "to_left": of(3, in_suffix_order)})
        .where(
            (F.col("level") == 3)
            | ~(100 * F.greatest(F.coalesce("to_left", F.lit(0)), F.coalesce("to_right", F.lit(0))) >= covered * F.col("a"))
        )
        .join(word("first", "n_first").hint("merge"), ["lang", "first"])
        .join(word("last", "n_last").hint("merge"), ["lang", "last"])
    )
    exact = {name: F.col(name).cast("decimal(15,0)").alias(name) for name in ("a", "head", "tail", "n_first", "n_last")}
    numbers = joined.select("lang", "level", "words", *exact.values())

    def cut(left: str, right: str) -> Column:
        score = F.expr(f"(a * a * {SCALE}) div ({left} * {right})")
        return F.struct(score.alias("score"), F.col(left).cast("bigint").alias("l"), F.col(right).cast("bigint").alias("r"))

    one, two = cut("n_first", "tail"), cut("head", "n_last")
    chosen = F.when(F.col("level") == 2, cut("n_first", "n_last")).when(one["score"] <= two["score"], one).otherwise(two)
    scored = numbers.withColumn("cut", chosen).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("a").cast("bigint").alias("a"), "cut.l", "cut.r", "cut.score"
    )
    # The best of parts of a language first, so that what meets in the last step does not grow with the tasks.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    of_part = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
    some = scored.withColumn("rank", of_part).where(F.col("rank") <= top)
    best = Window.partitionBy("lang").orderBy(*order)
    ranked = some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    totals = counts.where("level = 0").select("lang", "n")
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
