"""Substring dedup: remove words of passages that an earlier document has.

Seed and extend. Documents are joined on winnowed anchors: every window of `length` words has one, chosen by its
content alone. The join sorts the anchors by range (seed, then all words that a window around the anchor can reach,
then document), so that a frequent seed is dealt over as many tasks as its rows ask for and no pair of documents is
ever written out. An anchor whose whole surroundings occur in a smaller document extends fully. The first documents of
surroundings that share only the seed are extended on both sides word by word: every window around the anchor is
looked up among those of the other surroundings. The windows found are merged into maximal repeats.

A null text has no words and keeps nothing removed. A null doc_id counts as larger than all others. Documents with the
same doc_id, and repeated rows, do not remove words from each other. Documents are told apart by a 64-bit hash of
doc_id and text. Texts are processed whole. A column of the input that has the name of a result column is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import Aside, carried, column, extended, ints, merged, stored
from feedweave.llm.units import U64, Anchors, Fingerprints, Words, mixed, pieces, signed, utf8

LENGTH = 50
SEED = 12
RESULTS = ("n_words", "kept_text", "spans")
_LAST = (1 << 63) - 1


def _anchors(length: int, seed: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(*utf8(batch.column("text")))
            prints = Fingerprints(words.codes)
            a = Anchors(prints, words.offsets, length, seed)
            low, high = np.maximum(a.at - (length - seed), a.begin), np.minimum(a.at + length, a.end)
            place = mixed((a.at - low).astype(U64) * U64(1 << 20) + (high - a.at).astype(U64))
            yield pa.RecordBatch.from_pydict(
                {
                    "t0": signed(prints.of(a.at, a.at + seed)),
                    "t1": signed(prints.of(low, high) ^ place),
                    "doc": ints(batch.column("doc"))[a.text],
                    "key": ints(batch.column("key"))[a.text],
                    "pos": (a.at - a.begin).astype(np.int32),
                    "first": (a.first - a.begin).astype(np.int32),
                    "last": (a.last - a.begin).astype(np.int32),
                }
            )

    return found


def _extended(length: int):
    """Every window around the open anchors of a document."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(*utf8(batch.column("text")))
            prints = Fingerprints(words.codes)
            anchors = batch.column("anchors")
            owner = np.repeat(np.arange(batch.num_rows), ints(anchors.value_lengths()))
            flat = anchors.flatten()
            begin = words.offsets[owner]
            at, first, last = (ints(flat.field(n)).astype(np.int64) + begin for n in ("pos", "first", "last"))
            count = last - first + 1
            row = np.repeat(np.arange(len(at)), count)
            start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            yield pa.RecordBatch.from_pydict(
                {
                    "t0": ints(flat.field("t0"))[row],
                    "t1": signed(prints.of(start, start + length) ^ mixed((at[row] - start).astype(U64))),
                    "doc": ints(batch.column("doc"))[owner[row]],
                    "key": ints(batch.column("key"))[owner[row]],
                    "first": (start - begin[row]).astype(np.int32),
                    "last": (start - begin[row]).astype(np.int32),
                }
            )

    return windows


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of the sorted anchors.

    state 2: a smaller document has both tokens; 1: the first token has other second tokens, or may have them in the
    next range. `head` marks rows whose smaller document can only be in an earlier range, `tail` the range's last pair
    of tokens with its smallest document.
    """
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    part = pa.Table.from_batches(batches)
    t0, t1, doc = (ints(part.column(n)) for n in ("t0", "t1", "doc"))
    order = np.lexsort([doc, t1, t0])
    t0, t1, doc = t0[order], t1[order], doc[order]
    new0 = np.append(True, t0[1:] != t0[:-1])
    new1 = np.append(True, t1[1:] != t1[:-1]) | new0
    starts = np.flatnonzero(new1)
    run = np.cumsum(new1) - 1
    least = doc[starts][run]
    seed_run = np.cumsum(new0) - 1
    several = (np.bincount(seed_run, weights=new1) > 1)[seed_run]
    at_end = (seed_run == 0) | (seed_run == seed_run[-1])
    state = np.where(doc > least, 2, np.where(several | at_end, 1, 0)).astype(np.int32)
    head = (run == 0) & (state < 2)
    tail = np.zeros(len(order), dtype=bool)
    tail[starts[-1]] = True
    keep = (state > 0) | head | tail
    out = part.take(pa.array(order[keep]))
    for name, values in (("state", state), ("head", head), ("tail", tail)):
        out = out.append_column(name, pa.array(values[keep]))
    out = out.append_column("part", pa.array(np.full(out.num_rows, TaskContext.get().partitionId(), dtype=np.int32)))
    yield from out.to_batches(max_chunksize=50_000)


def _looked_up(rows: DataFrame, name: str) -> DataFrame:
    """Join rows with themselves on their tokens; state 2 where a smaller document has the same two tokens."""
    types = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    done = stored(
        rows.repartitionByRange("t0", "t1", "doc", "key", "first").mapInArrow(
            _joined, f"{types}, state int, head boolean, tail boolean, part int"
        ),
        name,
    )
    # One row for each range at most.
    tails = F.broadcast(
        done.where("tail").select("t0", "t1", F.col("doc").alias("_doc"), F.col("part").alias("_part"))
        .groupBy("t0", "t1").agg(F.min("_doc").alias("_doc"))
    )
    heads = done.where("head").join(tails, ["t0", "t1"], "left")
    heads = heads.withColumn("state", F.when(F.col("_doc") < F.col("doc"), 2).otherwise(F.col("state"))).drop("_doc")
    return done.where("not head").unionByName(heads).where("state > 0").drop("head", "tail", "part")


def _numbered(docs: DataFrame, text: str, doc_id: str) -> list:
    return [
        column(text).alias("text"),
        F.coalesce(column(doc_id).cast("bigint"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(column(doc_id), column(text)).alias("key"),
    ]


def repeated_words(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, seed: int = SEED
) -> DataFrame:
    """Word spans (key, start, end) that windows of a smaller document cover; `key` is xxhash64(doc_id, text)."""
    rows = docs.select(*_numbered(docs, text, doc_id)).where(F.octet_length("text") >= 2 * length - 1)
    anchors = _looked_up(
        rows.mapInArrow(
            _anchors(length, seed), "t0 bigint, t1 bigint, doc bigint, key bigint, pos int, first int, last int"
        ),
        "anchors",
    )
    open_anchors = (
        anchors.where("state = 1")
        .groupBy("key")
        .agg(F.collect_list(F.struct("t0", "pos", "first", "last")).alias("anchors"))
    )
    windows = _looked_up(
        rows.join(open_anchors, "key").mapInArrow(
            _extended(length), "t0 bigint, t1 bigint, doc bigint, key bigint, first int, last int"
        ),
        "windows",
    )
    span = ("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    return anchors.where("state = 2").select(*span).unionAll(windows.where("state = 2").select(*span))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text"):
        data, offsets = utf8(batch.column("_text"))
        raw = data.tobytes()
        found = batch.column("_spans")
        lengths = ints(found.value_lengths().fill_null(0))
        flat = found.flatten()
        start, end = ints(flat.field("start")).astype(np.int64), ints(flat.field("end")).astype(np.int64)
        until = np.cumsum(lengths)
        counts, kept, spans = [], [], []
        for i, n in enumerate(lengths.tolist()):
            words = raw[offsets[i] : offsets[i + 1]].split()
            counts.append(len(words))
            spans.append([])
            if n:
                a, b = merged(start[until[i] - n : until[i]], end[until[i] - n : until[i]])
                edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(words)]
                words = [w for j in range(0, len(edges), 2) for w in words[edges[j] : edges[j + 1]]]
                spans[-1] = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            kept.append(b" ".join(words).decode())
        rest = [n for n in batch.schema.names if n not in ("_text", "_spans")]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n) for n in rest),
                pa.array(counts, pa.int64()),
                pa.array(kept, pa.string()),
                pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
            ],
            names=[*rest, *RESULTS],
        )


def remove_repeated_words(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, seed: int = SEED
) -> DataFrame:
    """The documents with `n_words`, `kept_text` (kept words, one space between) and `spans` (maximal removed runs)."""
    spans = (
        repeated_words(docs, text, doc_id, length, seed)
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    )
    aside = Aside(carried(docs, *RESULTS))
    rows = docs.select(
        *aside.out(),
        column(text).alias("_text"),
        F.xxhash64(column(doc_id), column(text)).alias("key"),
    )
    joined = rows.join(spans, "key", "left").select(*aside.inner, "_text", "_spans")
    results = "n_words bigint, kept_text string, spans array<struct<start: bigint, end: bigint>>"
    return joined.mapInArrow(_cut, extended(rows, aside.inner, results)).select(*aside.back(), *RESULTS)


def digest(removed: DataFrame) -> DataFrame:
    """One row for each document: counts and the hash of what is left."""
    span = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return removed.select(
        "doc_id", "n_words", span.alias("n_removed"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )
