"""Token counts by byte-pair merging, without making any token.

A text is cut into pieces by the vocabulary's pre-tokenizer; each piece is a linked list of byte symbols over which a
heap repeatedly gives the adjacent pair of lowest rank. The count is the number of symbols at the start minus the
number of merges. Pieces recur, so each worker remembers the counts of those it has met (`REMEMBERED` at most; the
memory is emptied when full, which costs time and changes no count).

A null text is empty and has no tokens. Special tokens of the vocabulary that occur in a text count as one token, as
is the library's default. Texts are processed whole. A column of the input that has the name of a result column is
left out.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import Aside, carried, column, extended

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
REMEMBERED = 1 << 18
RESULTS = ("n_bytes", "n_tokens", "over_limit")
# Fixed values of byte-level vocabularies: the pre-tokenizer's pattern (white space as Unicode defines it) and the
# bytes that stand for themselves in the vocabulary's spelling.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _spelling() -> dict[str, int]:
    """The byte each character of the vocabulary stands for."""
    others = [b for b in range(256) if b not in set(_PRINTED)]
    return {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(others)}


class PairMerger:
    """Counts what is left of a piece after all merges."""

    def __init__(self, merges: list[tuple[str, str]]):
        symbols: dict[str, int] = {}
        number = lambda s: symbols.setdefault(s, len(symbols))
        by_byte = sorted(_spelling().items(), key=lambda x: x[1])
        for char, _ in by_byte:
            number(char)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.pairs.setdefault((number(left), number(right)), (rank, number(left + right)))
        self.remembered: dict[str, int] = {}

    def count(self, piece: str) -> int:
        known = self.remembered.get(piece)
        if known is None:
            known = self._merged(piece.encode())
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            if len(piece) <= 64:
                self.remembered[piece] = known
        return known

    def _merged(self, piece: bytes) -> int:
        symbol = list(piece)
        n = len(symbol)
        if n < 2:
            return n
        pairs = self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = new, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get((new, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], new, symbol[k]))
            h = before[i]
            if h >= 0:
                found = pairs.get((symbol[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], symbol[h], new))
        return n - merges


def load(path: str) -> tuple[PairMerger, list[str]]:
    """Merger and special tokens of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
    return PairMerger(pairs), [t["content"] for t in whole["added_tokens"]]


class TextCounter:
    def __init__(self, path: str):
        self.merger, specials = load(path)
        self.pieces = regex.compile(PATTERN).findall
        longest_first = sorted(filter(None, specials), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.specials is None or not self.specials.search(text):
            return sum(map(self.merger.count, self.pieces(text)))
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(self.merger.count(p) for part in parts for p in self.pieces(part))


_counters: dict[str, TextCounter] = {}


def _kept_counter(name: str) -> TextCounter:
    """The worker's counter for a vocabulary, found where this worker has its public tokenizers."""
    if name not in _counters:
        if "/" in name:
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _counters[name] = TextCounter(str(path))
    return _counters[name]


def _counting(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _kept_counter(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts = [counter(t) for t in part.column("_text").to_pylist()]
                yield part.drop_columns(["_text"]).append_column("n_tokens", pa.array(counts, pa.int64()))

    return count


def count_tokens(
    docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT
) -> DataFrame:
    """The documents with n_bytes, n_tokens and over_limit. `vocabulary`: a public tokenizer's name, or a path."""
    aside = Aside(carried(docs, *RESULTS))
    rows = docs.select(
        *aside.out(),
        F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("bigint").alias("n_bytes"),
        column(text).alias("_text"),
    )
    counted = rows.mapInArrow(_counting(vocabulary), extended(rows, aside.inner, "n_bytes bigint, n_tokens bigint"))
    return counted.select(*aside.back(), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
