"""Vectorised text units: bytes, words, rolling fingerprints and content-defined anchors of whole Arrow columns.

Every function works on many texts at once. Texts lie one after the other in one buffer; `offsets` says where each
begins. Fingerprints are 64 bits wide and depend on nothing but the content, so that tasks on different machines agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_POSITION_BITS = 28
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.array([bytes([b]).isalnum() is False and b < 128 for b in range(256)]) | _SPACE

_powers = np.ones(1, dtype=U64)
_inverse_powers = np.ones(1, dtype=U64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the life of the worker."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 1 << 19)
        steps = np.full(size, U64(_BASE))
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = U64(_BASE_INVERSE)
        _inverse_powers = np.multiply.accumulate(steps)
    return _powers, _inverse_powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(29))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's `bigint`."""
    return x.view(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(buffers[1], width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most_bytes` of text, so that a task's memory does not follow the batch size.

    A single longer text stays whole.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(start, stop - start)


class Fingerprints:
    """Fingerprints of any run of units, from prefix sums over one buffer of unit codes."""

    def __init__(self, codes: np.ndarray):
        self.powers, self.inverse = _powers_to(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=U64)
        np.cumsum(codes * self.powers[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def all_of(self, length: int) -> np.ndarray:
        """Of every run of `length` units, by its start."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, dtype=U64)


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


class Words:
    """The words of texts: runs of bytes other than ASCII white space.

    `breaks` may name other bytes that end a word. `codes` has each word's fingerprint, `offsets` the first word of each text, `start` and `stop` the words' bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _SPACE):
        inside = ~breaks[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        text_starts = offsets[:-1][np.diff(offsets) > 0]
        begins[text_starts] = inside[text_starts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        text_stops = offsets[1:][np.diff(offsets) > 0] - 1
        ends[text_stops] = inside[text_stops]
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(ends) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        prints = Fingerprints(byte_codes(_LOWER[data] if lower else data))
        self.codes = prints.of(self.start, self.stop) | U64(1)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of `width` values, in two running minima over blocks of that width."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """Winnowed anchors: the least-ranked seed of every window, chosen by the window's content alone.

    Two equal windows have their anchor at the same place inside, so equal windows are found by joining anchors.
    `at` are the anchors' positions, `text` their texts; the windows of an anchor start at `first` to `last`.
    """

    def __init__(self, prints: Fingerprints, offsets: np.ndarray, window: int, seed: int):
        if int(offsets[-1]) >= 1 << _POSITION_BITS:
            raise ValueError("a buffer of texts may hold 2^28 units at most")
        low = U64((1 << _POSITION_BITS) - 1)
        seeds = prints.all_of(seed)
        ranked = (seeds & ~low) | np.arange(len(seeds), dtype=U64)
        least = sliding_minimum(ranked, window - seed + 1)
        lengths = np.diff(offsets)
        fits = lengths >= window
        count = np.where(fits, lengths - window + 1, 0)
        begin = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(lengths)), count)
        starts = np.arange(int(count.sum())) - begin[owner] + offsets[:-1][owner]
        chosen = (least[starts] & low).astype(np.int64)
        new = np.ones(len(chosen), dtype=bool)
        new[1:] = chosen[1:] != chosen[:-1]
        runs = np.flatnonzero(new)
        self.at = chosen[runs]
        self.text = owner[runs]
        self.first = starts[runs]
        self.last = starts[np.append(runs[1:], len(starts)) - 1] if len(runs) else starts[:0]
        self.begin = offsets[:-1][self.text]
        self.end = offsets[1:][self.text]
