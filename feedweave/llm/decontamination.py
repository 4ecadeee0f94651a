"""Benchmark decontamination: passages of documents that copy a test item, also when edited.

n-grams of the items are the seeds: those that occur in at most `rare` items of the benchmark, and of each item its
rarest ones up to a number of which `SEEDS` are left after the most words that may be replaced or left out at
`least_score` (all its n-grams, if there are fewer). Documents are joined to items on seeds by a Spark join; a place
where as many seeds of one item gather on one diagonal as such edits leave (`SEEDS` at most, one at least) is a
candidate passage, and Smith-Waterman alignment of the passage's words with the item's words scores it. A passage
counts from `least_score` of the score of an exact copy; so does a stretch of any part of an item that is worth
`stretch` copied words, where an edit costs `EDIT` / 2 of them. Such a stretch keeps its share of the whole item as its
score. So that stretches have seeds too, the rarest n-grams of every run of `stretch` words are seeds, more than the
edits of a stretch can take. Passages of one item do not overlap. A copy whose edits leave
no two of its words side by side has no seed and is not found.

Seeds are a table (n-gram, item, place), chosen in tasks from counts over the whole benchmark. One pass over the
documents lists the n-grams that a sketch of all seeds does not rule out; the sketch is a bit set of `SKETCH_BITS`
bits whatever the benchmark's size, and what it lets through by chance meets no seed in the join. Hits of one text and
item are clustered into candidate passages: where the documents lie if the seeds are few enough to be broadcast, else
after a shuffle by text. Texts go by their hash (two of 64 bits), so copies of a text are one text from there on. Of the
documents only texts with a candidate are moved, one row of each, to be aligned with their items' words as those stream
by. Seeds, texts with candidates and matches are broadcast up to `broadcast_rows` rows, counted; beyond that they are
joined without. Words are compared without case (of all scripts)
and punctuation. Items of fewer words than a seed, null and empty ones are not looked for; null and empty texts match
nothing. Items with the same item_id are looked for one by one. Texts are processed whole. Matches are in
the order of their first and last word and item_id. A column of the input that has the name of the result column is
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.common import Aside, carried, column, ints, stored
from feedweave.llm.prefix import placed
from feedweave.llm.units import PUNCTUATION, U64, Words, mixed, pieces, signed, utf8

SEED_WORDS = 2
SEEDS = 3
RARE_ITEMS = 3
LEAST_SCORE = 0.4
STRETCH = 20
EDIT = 8
# Some words in a row of a stretch are copied without an edit, and on average there are more than EDIT / MATCH of them.
VERBATIM = EDIT // 2 + 1
SKETCH_BITS = 25
BROADCAST_ROWS = 200_000
MATCH, MISMATCH, GAP = 2, -1, -1
RESULTS = ("matches",)
_TYPE = "array<struct<item_id: bigint, score: double, first_word: bigint, last_word: bigint>>"
#: A text, whatever the rows that have it.
_TEXT = ("_text_a", "_text_b")


def _runs_of(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words."""
    n = max(len(codes) - size + 1, 0)
    hashed = np.zeros(n, dtype=U64)
    for k in range(size if n else 0):
        hashed = mixed(hashed * U64(0x9E3779B97F4A7C15) + codes[k : n + k])
    return hashed


def _grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run of `size` words inside one text."""
    hashed = _runs_of(words.codes, size)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    inside = owner[: len(hashed)] == owner[size - 1 :] if len(hashed) else np.empty(0, dtype=bool)
    start = np.flatnonzero(inside)
    return start, hashed[start]


def align(item: np.ndarray, passage: np.ndarray, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int, int]:
    """Smith-Waterman: best local score, and the first and last word of the passage it covers."""
    steps = np.arange(len(passage) + 1) * -gap
    above = np.zeros(len(passage) + 1, dtype=np.int64)
    origin_above = np.arange(len(passage) + 1)
    best, first, last = 0, 0, 0
    for word in item:
        diagonal = above[:-1] + np.where(passage == word, MATCH, mismatch)
        up = above[1:] + gap
        here = np.zeros(len(passage) + 1, dtype=np.int64)
        here[1:] = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.arange(len(passage) + 1)
        origin[1:] = np.where(diagonal >= np.maximum(up, 1), origin_above[:-1], np.where(up > 0, origin_above[1:], origin[1:]))
        # A gap in the item: the best cell to the left, less its distance.
        lifted = here + steps
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(len(here)), 0))
        above, origin_above = np.maximum(reach - steps, 0), origin[source]
        top = int(np.argmax(above))
        if above[top] > best:
            best, first, last = int(above[top]), int(origin_above[top]), top - 1
    return best, first, last


def _lost(lengths: np.ndarray, size: int, least: float) -> np.ndarray:
    """The most n-grams of an item that a passage can lack by words replaced or left out and still score `least`."""
    return size * np.floor(lengths * (1 - least) * MATCH / (MATCH - MISMATCH) + 1e-9).astype(np.int64)


def _rarest_of_runs(rank: np.ndarray, owner: np.ndarray, size: int, stretch: int) -> np.ndarray:
    """Whether an n-gram is among the rarest of any `stretch` words in a row of its item."""
    run = stretch - size + 1
    # An edit takes `size` n-grams and has to have so many copied words beside it.
    most = max(SEEDS, -(-run * size // VERBATIM))
    out = np.zeros(len(rank), dtype=bool)
    if len(rank) < run or run <= most:
        return out if run > most else ~out
    inside = owner[: len(owner) - run + 1] == owner[run - 1 :]
    windows = np.lib.stride_tricks.sliding_window_view(rank, run)
    for starts in np.array_split(np.flatnonzero(inside), len(rank) // 65_536 + 1):
        out[(np.argpartition(windows[starts], most, axis=1)[:, :most] + starts[:, None]).ravel()] = True
    return out


def _grams_of_items(size: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words_of"):
            words = Words(*utf8(batch.column("words_of")), breaks=PUNCTUATION)
            start, hashed = _grams(words, size)
            owner = np.searchsorted(words.offsets, start, side="right") - 1
            columns = {
                "no": batch.column("no").take(pa.array(owner)),
                "length": pa.array(words.counts[owner].astype(np.int64)),
                "place": pa.array(start - words.offsets[owner]),
                "gram": pa.array(signed(hashed)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return listed


def _chosen(size: int, rare: int, least: float, stretch: int):
    """The seeds of items, from rows with an item's n-grams in order and in how many items each occurs."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("grams")
            count = ints(pc.list_value_length(lists))
            owner = np.repeat(np.arange(len(count)), count)
            place, spread, gram = (ints(pc.struct_field(lists.flatten(), f)) for f in ("place", "spread", "gram"))
            by_spread = np.lexsort([gram, spread, owner])
            rank = np.empty(len(owner), dtype=np.int64)
            rank[by_spread] = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            lengths = ints(batch.column("length"))
            lost = _lost(lengths, size, least)
            use = (rank < lost[owner] + SEEDS) | (spread <= rare) | _rarest_of_runs(rank, owner, size, stretch)
            # How many seeds a passage must have.
            needed = np.clip(np.bincount(owner[use], minlength=len(count)) - lost, 1, SEEDS)
            columns = {
                "gram": pa.array(gram[use]),
                "no": batch.column("no").take(pa.array(owner[use])),
                "place": pa.array(place[use]),
                "length": pa.array(lengths[owner[use]]),
                "needed": pa.array(needed[owner[use]]),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return choose


def _sketch(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bit set of the seeds' hashes: at most 2 ** `bits` bits reach the driver, whatever the number of seeds."""
    at = F.shiftrightunsigned("gram", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = seeds.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=U64)
    out[ints(found.column("word"))] = ints(found.column("bits")).view(U64)
    return out


def _likely_seeds(sketch: np.ndarray, bits: int, size: int):
    """The n-grams of documents that the sketch of all seeds does not rule out; `row` tells a task's documents apart."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in pieces(batches, "_text"):
            words = Words(*utf8(batch.column("_text")), breaks=PUNCTUATION)
            start, hashed = _grams(words, size)
            at = hashed >> U64(64 - bits)
            met = (sketch[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) > 0
            start, hashed = start[met], hashed[met]
            owner = np.searchsorted(words.offsets, start, side="right") - 1
            columns = {k: batch.column(k).take(pa.array(owner)) for k in _TEXT}
            columns |= {"row": pa.array(owner + rows), "at": pa.array(start - words.offsets[owner])}
            columns |= {"gram": pa.array(signed(hashed))}
            rows += batch.num_rows
            yield pa.RecordBatch.from_pydict(columns)

    return listed


def _clusters(rows: pa.Table) -> pa.Table:
    """Clusters of seeds of one item that lie near one diagonal of one text, with the words around that may belong.

    Clusters that overlap are one passage.
    """
    row, no, place, at, length, needed = (ints(rows.column(c)) for c in ("row", "no", "place", "at", "length", "needed"))
    begin = at - place
    order = np.lexsort([begin, no, row])
    row, no, place, begin, length, needed = (x[order] for x in (row, no, place, begin, length, needed))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (no[1:] != no[:-1]) | (begin[1:] - begin[:-1] > length[1:] // 4 + 1)
    cluster = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(order))
    # The same seed on two diagonals of a cluster counts once.
    span = int(place.max(initial=0)) + 1
    distinct = np.unique(cluster * span + place) // span
    enough = np.flatnonzero(np.bincount(distinct, minlength=len(starts)) >= needed[starts])
    starts, stops = starts[enough], stops[enough]
    slack = length[starts] // 2
    first = np.maximum(begin[starts] - slack, 0)
    last = begin[stops - 1] + length[starts] + slack
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (row[starts[1:]] != row[starts[:-1]]) | (no[starts[1:]] != no[starts[:-1]]) | (first[1:] >= last[:-1])
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(new))[: len(heads)] - 1
    found = rows.select([*_TEXT, "no"]).take(pa.array(order[starts[heads]]))
    return found.append_column("first", pa.array(first[heads])).append_column("last", pa.array(last[ends]))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate passages, from hits in which those of one text follow each other; one text's hits are held at most."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        if not rows.num_rows:
            continue
        row = ints(rows.column("row"))
        cut = int(np.flatnonzero(row != row[-1])[-1]) + 1 if row[0] != row[-1] else 0
        yield from _clusters(rows.slice(0, cut)).to_batches()
        held = rows.slice(cut)
    if held is not None:
        yield from _clusters(held.combine_chunks()).to_batches()


def _common(codes: np.ndarray, offsets: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many words of its item each passage (`first` to `last`) has anywhere: no alignment matches more."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    out = np.zeros(len(item), dtype=np.int64)
    lengths = offsets[item + 1] - offsets[item]
    part = np.cumsum(lengths) >> 20
    for rows in np.split(np.arange(len(item)), np.flatnonzero(np.diff(part)) + 1):
        count = lengths[rows]
        owner = np.repeat(rows, count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + offsets[item[owner]]
        low = np.searchsorted(ordered, codes[at], side="left")
        end = np.searchsorted(ordered, codes[at], side="right")
        high = end.copy()
        # The first place of the word from `first` on, by halving inside the word's places.
        while (open_ := low < high).any():
            middle = (low + high) // 2
            before = open_ & (order[np.minimum(middle, len(order) - 1)] < first[owner])
            low, high = np.where(before, middle + 1, low), np.where(open_ & ~before, middle, high)
        met = (low < end) & (order[np.minimum(low, len(order) - 1)] < last[owner])
        out += np.bincount(owner[met], minlength=len(item))
    return out


def _copies(
    own: np.ndarray, codes: np.ndarray, first: int, last: int, least: float, stretch: int, whole: bool
) -> Iterator[tuple[float, int, int]]:
    """(score, first word, last word) of the passages between `first` and `last` that copy the item or a stretch of it.

    Without `whole` only stretches are looked for.
    """
    todo = [(first, last, whole)]
    while todo:
        first, last, whole = todo.pop()
        passage = codes[first:last]
        a = None
        if whole and len(passage) >= least * len(own):
            score, a, b = align(own, passage)
            score /= MATCH * len(own)
            if score < least:
                a = None
        # Where the whole item is met from a shorter passage on, stretches add none.
        if a is None and stretch < least * len(own) and len(passage) >= stretch:
            whole = False
            if np.isin(_runs_of(passage, VERBATIM), _runs_of(own, VERBATIM)).any():
                strict, a, b = align(own, passage, -EDIT, -EDIT)
                if strict >= MATCH * stretch:
                    score = align(own, passage[a : b + 1])[0] / (MATCH * len(own))
                else:
                    a = None
        if a is not None:
            yield score, first + a, first + b
            todo += [(first + b + 1, last, whole), (first, first + a, whole)]


def _aligned(least: float, stretch: int):
    """Matches, from rows in which each text (`first` is null) comes before its passages, which bring their item's text.

    Only the text of the passages at hand is held.
    """

    def align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, dtype=U64)
        for batch in pieces(batches, "_text"):
            words = Words(*utf8(batch.column("_text")), breaks=PUNCTUATION)
            codes, offsets = np.concatenate([held, words.codes]), words.offsets + len(held)
            passage = pc.is_valid(batch.column("first")).to_numpy(zero_copy_only=False)
            text = np.maximum.accumulate(np.where(passage, -1, np.arange(len(passage))))
            row = np.flatnonzero(passage)
            begin = np.where(text[row] >= 0, offsets[text[row]], 0)
            end = np.where(text[row] >= 0, offsets[text[row] + 1], len(held))
            first, last = (ints(batch.column(c).take(pa.array(row))).astype(np.int64) for c in ("first", "last"))
            first, last = begin + first, np.minimum(begin + last, end)
            common, fewest = _common(codes, offsets, row, first, last), least * (offsets[row + 1] - offsets[row])
            whole = common >= fewest
            found = []
            for c in np.flatnonzero(whole | ((common >= stretch) & (stretch < fewest))):
                own = codes[offsets[row[c]] : offsets[row[c] + 1]]
                for score, a, b in _copies(own, codes, int(first[c]), int(last[c]), least, stretch, bool(whole[c])):
                    found.append((row[c], score, a - begin[c], b - begin[c]))
            of, score, a, b = zip(*found, strict=True) if found else ((),) * 4
            columns = {k: batch.column(k).take(pa.array(of, pa.int64())) for k in (*_TEXT, "item_id")}
            columns |= {"score": pa.array(score, pa.float64())}
            columns |= {"first_word": pa.array(a, pa.int64()), "last_word": pa.array(b, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)
            if text[-1] >= 0:
                held = codes[offsets[text[-1]] : offsets[text[-1] + 1]].copy()

    return align_rows


def folded(text: Column) -> Column:
    """Text without case; `ß` as its upper case form `SS`."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _seeds(items: DataFrame, size: int, rare: int, least: float, stretch: int) -> DataFrame:
    """(gram, item's number, place, words of the item, seeds a passage of it must have)."""
    grams = items.mapInArrow(_grams_of_items(size), "no bigint, length bigint, place bigint, gram bigint")
    spread = grams.select("gram", "no").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("spread"))
    whole = grams.join(spread, "gram").groupBy("no", "length")
    return whole.agg(F.sort_array(F.collect_list(F.struct("place", "spread", "gram"))).alias("grams")).mapInArrow(
        _chosen(size, rare, least, stretch), "gram bigint, no bigint, place bigint, length bigint, needed bigint"
    )


def _few(rows: DataFrame, most: int) -> bool:
    """Whether a table is small enough to broadcast, by counting no further than that."""
    return rows.limit(most + 1).count() <= most


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = SEED_WORDS,
    rare: int = RARE_ITEMS,
    least_score: float = LEAST_SCORE,
    stretch: int = STRETCH,
    sketch_bits: int = SKETCH_BITS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The documents with `matches`: item_id, score, first_word and last_word of each passage that copies an item."""
    listed = benchmark.select(
        column(item_id).cast("bigint").alias("item_id"), folded(column(item_text)).alias("words_of")
    ).where(F.length("words_of") > 0)
    items = placed(listed, "item_id", "words_of").select(
        (F.shiftleft(F.col("_part").cast("bigint"), 33) + F.col("_slot")).alias("no"), "item_id", "words_of"
    )
    seeds = stored(_seeds(items, size, rare, least_score, stretch), "seeds")

    aside = Aside(carried(docs, *RESULTS))
    plain = folded(column(text))
    hashes = [F.xxhash64(plain).alias(_TEXT[0]), F.xxhash64(F.lit(1), plain).alias(_TEXT[1])]
    texts = docs.select(*hashes, plain.alias("_text"))
    key = ", ".join(f"{k} bigint" for k in _TEXT)
    likely = texts.mapInArrow(
        _likely_seeds(_sketch(seeds, sketch_bits), sketch_bits, size), f"{key}, row bigint, at bigint, gram bigint"
    )
    if _few(seeds, broadcast_rows):
        # A text's hits stay together where its row is.
        hits = likely.join(F.broadcast(seeds), "gram").drop("gram")
    else:
        # Copies of a text are one text before its hits meet in a task.
        distinct = likely.drop("row").join(seeds, "gram").drop("gram").distinct()
        hits = distinct.repartition(*_TEXT).sortWithinPartitions(*_TEXT).withColumn("row", F.xxhash64(*_TEXT))
    passages = stored(
        hits.mapInArrow(_passages, f"{key}, no bigint, first bigint, last bigint").distinct(), "passages"
    )

    # One row of each text before it moves, and then its passages.
    ids = passages.select(*_TEXT).distinct()
    wanted = texts.join(F.broadcast(ids) if _few(ids, broadcast_rows) else ids, [*_TEXT], "left_semi")
    once = wanted.groupBy(*_TEXT).agg(F.first("_text").alias("_text"))
    rows = once.select(
        *_TEXT, *[F.lit(None).cast("bigint").alias(c) for c in ("first", "last", "item_id")], "_text"
    ).unionByName(passages.join(items.withColumnRenamed("words_of", "_text"), "no").drop("no"))
    in_order = rows.repartition(*_TEXT).sortWithinPartitions(*_TEXT, F.col("first").asc_nulls_first())
    found = in_order.mapInArrow(
        _aligned(least_score, stretch), f"{key}, item_id bigint, score double, first_word bigint, last_word bigint"
    )
    ordered = F.sort_array(F.collect_list(F.struct("first_word", "last_word", "item_id", "score")))
    fields = ("item_id", "score", "first_word", "last_word")
    matches = stored(
        found.groupBy(*_TEXT).agg(F.transform(ordered, lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias("matches")),
        "matches",
    )
    known = F.broadcast(matches) if _few(matches, broadcast_rows) else matches
    marked = docs.select(*aside.out(), *hashes).join(known, [*_TEXT], "left")
    return marked.select(*aside.back(), F.coalesce("matches", F.array().cast(_TYPE)).cast(_TYPE).alias("matches"))
