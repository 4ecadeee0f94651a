"""Suffix-array dedup: remove every byte that a long string occurring elsewhere covers.

The suffixes of all texts are range-partitioned by their leading tokens with sampled splitters, each bucket is sorted
by multikey quicksort, and neighbours are compared, over bucket boundaries too. A token is the fingerprint of a run of
bytes, so that a suffix travels as a few integers whatever its length.

Not every suffix has to be sorted at once. The suffixes are thinned by content and refined in three rounds:

1. one suffix for each winnowed anchor. Tokens: the anchor's seed, then everything that any window around the anchor
   can reach. Equal in both: all windows of the anchor repeat. Seed alone in common: undecided. Else: none repeats.
2. of undecided anchors, one suffix for each block of `STEP` windows. Tokens: what all windows of the block share, then
   what any of them reaches.
3. of undecided blocks, the suffix of every window. Tokens: what the block shares, then the window itself.

Anchors are chosen by a window's content alone, so two equal windows always meet in the same round under the same
token: nothing is lost. Groups of equal suffixes are dealt over as many buckets as their size asks for.

Nulls and empty texts keep nothing removed. Exact copies of a text of at least `length` bytes are removed entirely.
Texts are told apart by a 64-bit hash. A text is processed as a whole (about 60 bytes of memory for each of its bytes).
Repeated rows count as copies of each other. A column of the input that has the name of a result column is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.common import Aside, carried, column, extended, ints, merged, stored
from feedweave.llm.units import (
    U64,
    Anchors,
    Fingerprints,
    byte_codes,
    mixed,
    pieces,
    signed,
    utf8,
)

LENGTH = 400
SEED = 64
STEP = 16
RESULTS = ("kept", "spans")
_SMALL = 1 << 14
_KEYS = ["t0", "t1", "key", "pos"]


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several tokens: three-way partitioning on one token, the next token only among equals."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        part = order[low:high]
        if depth == len(columns) or high - low < 2:
            continue
        if high - low <= _SMALL:
            order[low:high] = part[np.lexsort([c[part] for c in reversed(columns[depth:])])]
            continue
        token = columns[depth][part]
        pivot = np.sort(token[:: max(1, len(token) // 63)])[-32:][0]
        less, more = token < pivot, token > pivot
        equal = ~(less | more)
        n_less, n_equal = int(less.sum()), int(equal.sum())
        order[low:high] = np.concatenate([part[less], part[equal], part[more]])
        todo += [
            (low, low + n_less, depth),
            (low + n_less, low + n_less + n_equal, depth + 1),
            (low + n_less + n_equal, high, depth),
        ]
    return order


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort a bucket and compare neighbours: rows that share a first token, and the bucket's two ends."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    bucket = pa.Table.from_batches(batches)
    keys = [ints(bucket.column(k)) for k in _KEYS]
    order = multikey_order(keys)
    t0, t1, key, pos = (k[order] for k in keys)
    same0, same1 = t0[1:] == t0[:-1], t1[1:] == t1[:-1]
    again = np.append(False, same0 & same1 & (key[1:] == key[:-1]) & (pos[1:] == pos[:-1]))
    if again.any():  # one suffix met twice, from copies of a text
        order = order[~again]
        t0, t1 = t0[~again], t1[~again]
        same0, same1 = t0[1:] == t0[:-1], t1[1:] == t1[:-1]
    shared = same0.astype(np.int32) + (same0 & same1)
    state = np.maximum(np.append(0, shared), np.append(shared, 0)).astype(np.int32)
    new0 = np.append(True, ~same0)
    new1 = np.append(True, ~(same0 & same1))
    run = np.cumsum(new0) - 1
    several = np.bincount(run, weights=new1)[run] > 1
    goes_on = new1 & (several | (run == 0) | (run == run[-1]))
    side = np.zeros(len(order), dtype=np.int32)
    side[0] += 1
    side[-1] += 2
    keep = (state > 0) | (side > 0)
    out = bucket.take(pa.array(order[keep]))
    for name, values in (("state", state), ("goes_on", goes_on), ("side", side)):
        out = out.append_column(name, pa.array(values[keep]))
    out = out.append_column("bucket", pa.array(np.full(out.num_rows, TaskContext.get().partitionId(), dtype=np.int32)))
    yield from out.to_batches(max_chunksize=50_000)


def _compared(suffixes: DataFrame, name: str) -> DataFrame:
    """State of every suffix that is not alone: 2 if both tokens occur elsewhere, 1 if only the first does.

    `goes_on` marks what the next round has to look at: one suffix of each pair of tokens, where the first token has
    more than one second token (or a bucket's end leaves that open). Spark samples the splitters. Equal rows never straddle a boundary; of what does, only the two ends of a bucket
    can change, so that the comparison over boundaries touches two rows of each bucket.
    """
    types = ", ".join(f"`{n}` {t}" for n, t in suffixes.dtypes)
    rows = stored(
        suffixes.repartitionByRange(*_KEYS).mapInArrow(_neighbours, f"{types}, state int, goes_on boolean, side int, bucket int"), name
    )
    along = Window.orderBy("bucket", "side")

    def over_boundary(step) -> F.Column:
        other = lambda c: step(c).over(along)
        met = (other("bucket") != F.col("bucket")) & (other("t0") == F.col("t0"))
        return F.when(met, F.when(other("t1") == F.col("t1"), 2).otherwise(1)).otherwise(0)

    ends = rows.where("side > 0").withColumn("state", F.greatest("state", over_boundary(F.lag), over_boundary(F.lead)))
    return rows.where("side = 0").unionByName(ends).where("state > 0").drop("side", "bucket")


def _reach(prints: Fingerprints, low: np.ndarray, at: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Token of [low, high) that also tells where inside it `at` lies."""
    return prints.of(low, high) ^ mixed((at - low).astype(U64) * U64(0x2545F4914F6CDD1D) + (high - at).astype(U64))


def _anchor_suffixes(length: int, seed: int):
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, "text"):
            keys = ints(batch.column("key"))
            fresh = [i for i, k in enumerate(keys.tolist()) if not (k in seen or seen.add(k))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            keys = keys[fresh]
            data, offsets = utf8(batch.column("text"))
            prints = Fingerprints(byte_codes(data))
            a = Anchors(prints, offsets, length, seed)
            low, high = np.maximum(a.at - (length - seed), a.begin), np.minimum(a.at + length, a.end)
            yield pa.RecordBatch.from_pydict(
                {
                    "t0": signed(prints.of(a.at, a.at + seed)),
                    "t1": signed(_reach(prints, low, a.at, high)),
                    "key": keys[a.text],
                    "pos": (a.at - a.begin).astype(np.int32),
                    "first": (a.first - a.begin).astype(np.int32),
                    "last": (a.last - a.begin).astype(np.int32),
                }
            )

    return suffixes


def _block_suffixes(length: int, step: int):
    side = step - 1

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, "text"):
            keys = ints(batch.column("key"))
            fresh = [i for i, k in enumerate(keys.tolist()) if not (k in seen or seen.add(k))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            keys = keys[fresh]
            data, offsets = utf8(batch.column("text"))
            prints = Fingerprints(byte_codes(data))
            anchors = batch.column("anchors")
            owner = np.repeat(np.arange(len(keys)), ints(anchors.value_lengths()))
            flat = anchors.flatten()
            at, first, last = (ints(flat.field(n)).astype(np.int64) + offsets[owner] for n in ("pos", "first", "last"))
            lowest, highest = (at - last) // step, (at - first) // step
            count = highest - lowest + 1
            row = np.repeat(np.arange(len(at)), count)
            block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lowest[row]
            c = at[row] - block * step
            begin, end = offsets[owner[row]], offsets[owner[row] + 1]
            core_end = c + length - side
            low, high = np.maximum(c - side, begin), np.minimum(c + length, end)
            left = data[np.clip(c[:, None] - np.arange(1, step), 0, len(data) - 1)]
            right = data[np.clip(core_end[:, None] + np.arange(side), 0, len(data) - 1)]
            around = np.concatenate([left, right], axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "t0": signed(prints.of(c, core_end) ^ mixed(block.astype(U64))),
                    "t1": signed(_reach(prints, low, c, high)),
                    "key": keys[owner[row]],
                    "pos": (c - begin).astype(np.int32),
                    "first": (np.maximum(first[row], c - side) - begin).astype(np.int32),
                    "last": (np.minimum(last[row], c) - begin).astype(np.int32),
                    "around": pa.Array.from_buffers(
                        pa.binary(),
                        len(c),
                        [
                            None,
                            pa.py_buffer(np.arange(len(c) + 1, dtype=np.int32) * (2 * side)),
                            pa.py_buffer(np.ascontiguousarray(around)),
                        ],
                    ),
                }
            )

    return suffixes


def _window_suffixes(step: int):
    side = step - 1

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            around, _ = utf8(batch.column("around"))
            codes = byte_codes(around.reshape(-1, 2 * side))
            weights = mixed(np.arange(1, 2 * side + 1, dtype=U64)) | U64(1)
            sums = np.zeros((len(codes), step, 2), dtype=U64)
            np.cumsum(codes[:, :side] * weights[:side], axis=1, out=sums[:, 1:, 0])
            np.cumsum(codes[:, side:] * weights[side:], axis=1, out=sums[:, 1:, 1])
            t0, key, pos, first, last = (ints(batch.column(n)) for n in ("t0", "key", "pos", "first", "last"))
            count = last - first + 1
            row = np.repeat(np.arange(len(t0)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            left = pos[row] - at
            token = sums[row, left, 0] + sums[row, side - left, 1] + left.astype(U64) * U64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_pydict(
                {"t0": t0[row], "t1": signed(mixed(token)), "key": key[row], "pos": at.astype(np.int32)}
            )

    return suffixes


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED, step: int = STEP):
    """Byte spans (key, start, end) of texts that a string of `length` bytes occurring elsewhere covers.

    `key` is `xxhash64(text)`; spans may overlap. Copies of a text give one span over the whole text.
    """
    texts = docs.select(column(text).alias("text"), F.xxhash64(column(text)).alias("key")).where(
        F.octet_length("text") >= length
    )
    whole = (
        texts.groupBy("key")
        .agg(F.count(F.lit(1)).alias("rows"), F.max(F.octet_length("text")).alias("end"))
        .where("rows > 1")
    )
    anchors = _compared(
        texts.mapInArrow(
            _anchor_suffixes(length, seed), "t0 bigint, t1 bigint, key bigint, pos int, first int, last int"
        ),
        "anchors",
    )
    open_anchors = (
        anchors.where("goes_on")
        .groupBy("key")
        .agg(F.collect_list(F.struct("pos", "first", "last")).alias("anchors"))
    )
    blocks = _compared(
        texts.join(open_anchors, "key").mapInArrow(
            _block_suffixes(length, step),
            "t0 bigint, t1 bigint, key bigint, pos int, first int, last int, around binary",
        ),
        "blocks",
    )
    windows = _compared(
        blocks.where("goes_on").mapInArrow(_window_suffixes(step), "t0 bigint, t1 bigint, key bigint, pos int"),
        "windows",
    )
    spans = [
        whole.select("key", F.lit(0).alias("start"), "end"),
        *(
            rows.where("state = 2").select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
            for rows in (anchors, blocks)
        ),
        windows.where("state = 2").select("key", F.col("pos").alias("start"), (F.col("pos") + length).alias("end")),
    ]
    return spans[0].unionAll(spans[1]).unionAll(spans[2]).unionAll(spans[3])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text"):
        data, offsets = utf8(batch.column("_text"))
        raw = data.tobytes()
        found = batch.column("_spans")
        lengths = ints(found.value_lengths().fill_null(0))
        flat = found.flatten()
        start, end = ints(flat.field("start")).astype(np.int64), ints(flat.field("end")).astype(np.int64)
        until = np.cumsum(lengths)
        kept, spans = [], []
        for i, n in enumerate(lengths.tolist()):
            low, high = int(offsets[i]), int(offsets[i + 1])
            if not n:
                kept.append(raw[low:high])
                spans.append([])
                continue
            a, b = merged(start[until[i] - n : until[i]], end[until[i] - n : until[i]])
            edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), high - low]
            kept.append(b"".join(raw[low + edges[j] : low + edges[j + 1]] for j in range(0, len(edges), 2)))
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        done = pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})))],
            names=RESULTS,
        )
        rest = [n for n in batch.schema.names if n not in ("_text", "_spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *done.columns], names=[*rest, *RESULTS])


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, **tuning: int) -> DataFrame:
    """The documents with `kept` (the remaining bytes, concatenated) and `spans` (maximal removed runs) added."""
    spans = (
        repeated_spans(docs, text, length, **tuning)
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    )
    aside = Aside(carried(docs, *RESULTS))
    rows = docs.select(*aside.out(), column(text).alias("_text"), F.xxhash64(column(text)).alias("key"))
    joined = rows.join(spans, "key", "left").select(*aside.inner, "_text", "_spans")
    results = "kept binary, spans array<struct<start: bigint, end: bigint>>"
    return joined.mapInArrow(_cut, extended(rows, aside.inner, results)).select(*aside.back(), *RESULTS)


def digest(removed: DataFrame) -> DataFrame:
    """One row for each document: sizes and the hash of what is left."""
    span = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return removed.select(
        "doc_id",
        (F.octet_length("kept") + span).cast("bigint").alias("n_bytes"),
        span.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("bigint").alias("kept_bytes"),
    )
