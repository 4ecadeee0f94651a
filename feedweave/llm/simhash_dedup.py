"""SimHash near-dedup: link documents whose 64-bit fingerprints differ in a few bits.

A fingerprint is the bitwise majority of the XXH64 (seed 42) of a text's word shingles. Two fingerprints that differ in
4 bits or fewer have at least 4 of their 8 bytes in common, each at its own place. The index is inverted by byte
positions: lists of the distinct fingerprints that have the same bytes at the same places. Any 4 of 8 places include
two of one of the groups (0 1 2), (3 4 5), (6 7), so the seven lists by two places of a group see every pair that
counts. Inside a list the shared positional bytes of each pair are tallied, pairs with fewer than 4 are dropped and the
rest are verified bit by bit.

A list of more than `LONG` fingerprints is not compared: its members must have more bytes in common, so it is refined by
a third place and then a fourth, over as many places as make sure that one of them is shared. Lists that are long even
with four places are compared block by block, each pair of blocks a task's work of its own. Nothing is dropped for
length. What a list finds is written as a forest, not as all pairs.

Equal fingerprints are one entry of the index, so exact copies cost nothing. Null and empty texts have fingerprint zero
and are linked like any other. A null doc_id counts as larger than all others: a component without any doc_id has none.
Repeated rows are all returned. Texts are processed whole. Input columns that have the name of a result column are left
out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import Aside, carried, column, extended, stored
from feedweave.llm.components import components
from feedweave.llm.units import U64, pieces, signed

WORDS = 4
BITS = 4
LONG = 1024
BLOCK = 4096
RESULTS = ("fingerprint", "component_id")
_SEED = 42
_CHUNK = 1 << 16
_PLACES = ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (6, 7))


def _mask(places: tuple[int, ...]) -> int:
    """The bytes at these places, as Spark's `bigint`."""
    bits = sum(0xFF << (8 * p) for p in places)
    return bits - (1 << 64) if bits >> 63 else bits


def _refined(lists: list[tuple[int, ...]], shared: int) -> list[tuple[int, int]]:
    """From each mask to those with one place more, of which a pair that counts shares one at least."""
    steps = []
    for places in lists:
        rest = [p for p in range(8) if p not in places]
        steps += [(_mask(places), _mask((*places, p))) for p in rest[: len(rest) - (4 - shared) + 1]]
    return steps


def majority(text: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of one text."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    if len(found) > words:
        starts, stops = starts[: 1 - words], stops[words - 1 :]
    else:
        starts, stops = starts[:1], stops[-1:]
    ones, h = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), stops[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([h(joined[a:b], _SEED) for a, b in spans], dtype=U64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(U64)[0])


def _fingerprints(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            prints = np.fromiter((majority(t, words) for t in texts), dtype=U64, count=len(texts))
            rest = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.array(signed(prints))], names=[*rest, "_print"]
            )

    return of


def forest(group: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of fingerprints, sorted by group: enough of them to hold each component together."""
    ends = np.searchsorted(group, group, side="right")
    parent = np.arange(len(prints))
    a, b = [], []

    def root(nodes: np.ndarray) -> np.ndarray:
        up = parent[nodes]
        while True:
            further = parent[up]
            if np.array_equal(further, up):
                return up
            up = further

    step, at = 1, np.flatnonzero(ends > np.arange(len(prints)) + 1)
    while len(at):
        differing = prints[at] ^ prints[at + step]
        shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = at[shared >= 8 - bits]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= bits]
        left, right = root(near), root(near + step)
        new = left != right
        a.append(near[new])
        b.append(near[new] + step)
        np.minimum.at(parent, np.maximum(left, right)[new], np.minimum(left, right)[new])
        step += 1
        at = at[ends[at] > at + step]
    none = np.empty(0, dtype=np.int64)
    return prints[np.concatenate([none, *a])], prints[np.concatenate([none, *b])]


def _tallied(bits: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole lists, sorted by their key, in batches that may end inside one."""
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(x.num_rows for x in kept) >= _CHUNK:
                done, rest = _whole_lists(kept)
                kept = [rest]
                yield from _links_of(done, bits)
        if kept:
            yield from _links_of(pa.Table.from_batches(kept), bits)

    return links


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _starts(rows: pa.Table) -> np.ndarray:
    keys = [_numbers(rows, n) for n in rows.column_names if n != "_print"]
    new = np.ones(rows.num_rows, dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _whole_lists(batches: list[pa.RecordBatch]) -> tuple[pa.Table, pa.RecordBatch]:
    """All but the last list, and the last, which may go on."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    last = int(np.flatnonzero(_starts(rows))[-1])
    return rows.slice(0, last), rows.slice(last).combine_chunks().to_batches()[0]


def _links_of(rows: pa.Table, bits: int) -> Iterator[pa.RecordBatch]:
    if rows.num_rows:
        a, b = forest(np.cumsum(_starts(rows)), _numbers(rows, "_print").view(U64), bits)
        yield pa.RecordBatch.from_pydict({"a": signed(a), "b": signed(b)})


def _compared(lists: DataFrame, keys: list[str], bits: int) -> DataFrame:
    rows = lists.select(*keys, "_print").repartition(*keys).sortWithinPartitions(*keys, "_print")
    return rows.mapInArrow(_tallied(bits), "a bigint, b bigint")


def links(prints: DataFrame, bits: int = BITS, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that hold together all distinct fingerprints (`_print`) that differ in `bits` bits at most."""
    if not 0 <= bits <= 4:
        raise ValueError("fingerprints may differ in 4 bits at most")
    by = lambda mask: F.struct(F.lit(mask).alias("mask"), F.col("_print").bitwiseAND(F.lit(mask)).alias("key"))
    spark, key = prints.sparkSession, ["mask", "key"]
    lists = stored(prints.select(F.inline(F.array(*[by(_mask(p)) for p in _PLACES])), "_print"), "lists")
    masks, found = list(_PLACES), []
    for shared in (2, 3, 4):
        sizes = stored(lists.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long), "long")
        if sizes.isEmpty():
            return _union([*found, _compared(lists, key, bits)])
        found.append(_compared(lists.join(sizes, key, "left_anti"), key, bits))
        if shared < 4:
            # At most 7 x 5 rows, then 35 x 5.
            steps = spark.createDataFrame(_refined(masks, shared), "mask bigint, next bigint")
            refined = lists.join(sizes, key, "left_semi").join(F.broadcast(steps), "mask")
            lists = stored(
                refined.select(
                    F.col("next").alias("mask"), F.col("_print").bitwiseAND(F.col("next")).alias("key"), "_print"
                ).distinct(),
                "lists",
            )
            masks = sorted({tuple(sorted((*m, p))) for m in masks for p in range(8) if p not in m})
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("_print"), blocks).cast("int")
    paired = lists.join(sizes, key).select(
        *key, "_print", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    )
    paired = paired.select(*key, F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), "_print")
    return _union([*found, _compared(paired, [*key, "b0", "b1"], bits)])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def mark_simhash_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, bits: int = BITS, carry: list[str] | None = None
) -> DataFrame:
    """The documents with `fingerprint` (16 hex digits) and `component_id` (smallest doc_id reachable by links)."""
    names = carried(docs, *RESULTS) if carry is None else carry
    aside = Aside(names)
    source = docs.select(
        *aside.out(),
        column(doc_id).cast("bigint").alias("_doc"),
        column(text).alias("_text"),
    )
    schema = extended(source, [*aside.inner, "_doc"], "_print bigint")
    rows = stored(source.mapInArrow(_fingerprints(words), schema), "prints")
    prints = stored(rows.groupBy("_print").agg(F.min("_doc").alias("_least")), "distinct-prints")
    found = components(links(prints.select("_print"), bits)).select(F.col("node").alias("_print"), "root")
    linked = stored(prints.join(found, "_print"), "linked")
    least = linked.groupBy("root").agg(F.min("_least").alias("_component"))
    of_linked = linked.join(least, "root").select("_print", "_component")
    of_print = prints.join(of_linked, "_print", "left").select(
        "_print", F.when(F.col("_component").isNotNull(), F.col("_component")).otherwise(F.col("_least")).alias("_component")
    )
    return rows.join(of_print, "_print").select(
        *aside.back(),
        F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )
