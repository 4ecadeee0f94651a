"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics look at a text's form only (sizes, kinds of characters, repetition), in one pass. Trees grow level by level
on histograms of binned statistics, and are flattened into arrays in which a batch of documents walks all trees at
once. Learning sees at most `SAMPLE` labelled rows, chosen by a hash of doc_id; statistics and scores cover every row.

Null and empty texts have all statistics 0 and get a score like any other. Rows without doc_id are never learnt from
and are not held out. Without labels of both kinds every score is the share of label 1 (0.5 if there are none). Labels
other than 0 and 1 are not used. Repeated rows count as often as they occur. A column of the input that has the name
of a result column is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import Aside, carried, column, extended, ints
from feedweave.llm.units import PUNCTUATION, U64, Fingerprints, Words, byte_codes, mixed, pieces, utf8

SAMPLE = 40_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
CUT = 0.3
FOLDS = 5
RESULTS = ("held_out", "score", "predicted")
STATISTICS = (
    "bytes", "words", "word_length", "long_words", "short_words", "lines", "line_words", "upper", "digits", "symbols",
    "commas", "stops", "other_marks", "wide", "spaces", "upper_words", "capital_words", "marked_words", "bare_words",
    "distinct_words", "top_word", "doubled_words", "distinct_pairs", "distinct_lines",
)


def _shares(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of true flags in each text; 0 where there is nothing."""
    sums = np.append(0, np.cumsum(flags))
    n = np.diff(offsets)
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1)


def _distinct(codes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct codes, and how often the commonest occurs, for each text."""
    order = np.lexsort([codes, owner])
    codes, owner = codes[order], owner[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(codes)))
    most = np.zeros(texts)
    np.maximum.at(most, owner[starts], counts)
    return np.bincount(owner[starts], minlength=texts), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of `STATISTICS` for each text."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    words = Words(data, offsets)
    counts = words.counts
    lengths = words.stop - words.start
    owner = np.repeat(np.arange(n), counts)
    upper = (data >= 65) & (data <= 90)
    letters = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    uppers, lettered = np.append(0, np.cumsum(upper)), np.append(0, np.cumsum(letters))
    in_word = lambda sums: sums[words.stop] - sums[words.start]
    marks = PUNCTUATION[data] & (data > 32)
    last = data[words.stop - 1] if len(words.stop) else data[:0]
    newline = data == 10
    line_starts = np.zeros(len(data), dtype=bool)
    line_starts[1:] = newline[:-1]
    line_starts[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(line_starts)
    end = np.append(begin[1:], len(data))
    prints = Fingerprints(byte_codes(data))
    line_owner = np.searchsorted(offsets, begin, side="right") - 1
    line_counts = np.bincount(line_owner, minlength=n) if len(begin) else np.zeros(n, dtype=np.int64)
    follows = np.zeros(len(owner), dtype=bool)
    follows[1:] = owner[1:] == owner[:-1]
    doubled = follows & (words.codes == np.roll(words.codes, 1))
    pair_codes = mixed(words.codes * U64(0x9E3779B97F4A7C15) + np.roll(words.codes, 1))[follows]
    distinct, top = _distinct(words.codes, owner, n)
    pairs, _ = _distinct(pair_codes, owner[follows], n)
    lines, _ = _distinct(prints.of(begin, end), line_owner, n)
    some = np.maximum(counts, 1)
    of_words = lambda flags: _shares(flags, words.offsets)
    of_bytes = lambda flags: _shares(flags, offsets)
    stop = np.isin(last, np.frombuffer(b".!?", np.uint8))
    comma = np.isin(last, np.frombuffer(b",;:", np.uint8))
    is_marked = (marks[words.stop - 1] if len(words.stop) else marks[:0]) & ~stop & ~comma
    columns = [
        np.log1p(np.diff(offsets)), np.log1p(counts), np.bincount(owner, weights=lengths, minlength=n) / some,
        of_words(lengths > 12), of_words(lengths < 3), np.log1p(line_counts), counts / np.maximum(line_counts, 1),
        of_bytes(upper), of_bytes((data >= 48) & (data <= 57)), of_bytes(marks), of_words(comma), of_words(stop),
        of_bytes(np.isin(data, np.frombuffer(b"|#$%&*@~^<>{}[]=+_\\/", np.uint8))), of_bytes(data >= 128),
        of_bytes(PUNCTUATION[data] & (data <= 32)),
        of_words((in_word(uppers) == in_word(lettered)) & (in_word(lettered) > 1)),
        of_words(upper[words.start] if len(words.start) else upper[:0]), of_words(is_marked),
        of_words(in_word(lettered) == 0), distinct / some, top / some, of_words(doubled),
        pairs / np.maximum(counts - 1, 1), lines / np.maximum(line_counts, 1),
    ]
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


class BoostedTrees:
    """Trees of one depth in heap order: the children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE):
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        self.base, self.depth = float(np.log(share / (1 - share))), depth
        inner = (1 << depth) - 1
        self.feature = np.zeros((trees, inner), dtype=np.int64)
        self.bound = np.full((trees, inner), np.inf)
        self.leaf = np.zeros((trees, 1 << depth))
        if len(y) and 0 < y.sum() < len(y):
            edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
            binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
            raw = np.full(len(y), self.base)
            for t in range(trees):
                p = 1 / (1 + np.exp(-raw))
                raw += self._grow(t, binned, edges, p - y, p * (1 - p), bins, rate)

    def _grow(self, t, binned, edges, slope, curve, bins, rate) -> np.ndarray:
        node = np.zeros(len(slope), dtype=np.int64)
        for level in range(self.depth):
            first, nodes = (1 << level) - 1, 1 << level
            at = node - first
            total = [np.bincount(at, weights=w, minlength=nodes) for w in (slope, curve)]
            best = np.full(nodes, 1e-3)
            for f, codes in enumerate(binned):
                if not len(edges[f]):
                    continue
                cell = at * bins + codes
                g, h = (np.cumsum(np.bincount(cell, weights=w, minlength=nodes * bins).reshape(nodes, bins), axis=1)[:, : len(edges[f])] for w in (slope, curve))
                rest_g, rest_h = total[0][:, None] - g, total[1][:, None] - h
                gain = g**2 / (h + 1) + rest_g**2 / (rest_h + 1) - (total[0] ** 2 / (total[1] + 1))[:, None]
                gain[(h < 1) | (rest_h < 1)] = 0
                cut = np.argmax(gain, axis=1)
                gained = gain[np.arange(nodes), cut]
                better = gained > best
                best[better] = gained[better]
                self.feature[t, first : first + nodes][better] = f
                self.bound[t, first : first + nodes][better] = edges[f][cut[better]]
            chosen = self.feature[t, node]
            limits = self.bound[t, node]
            value = np.empty(len(node))
            for f in np.unique(chosen):
                of = chosen == f
                codes = binned[f][of]
                e = edges[f]
                value[of] = np.where(codes < len(e), e[np.minimum(codes, len(e) - 1)] if len(e) else 0, np.inf)
            node = 2 * node + 1 + ((value > limits) & np.isfinite(limits))
        at = node - ((1 << self.depth) - 1)
        g, h = (np.bincount(at, weights=w, minlength=1 << self.depth) for w in (slope, curve))
        self.leaf[t] = -rate * g / (h + 1)
        return self.leaf[t][at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: every row walks all trees, one level at a time."""
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.bound[trees, node])
        raw = self.base + self.leaf[trees, node - ((1 << self.depth) - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fold(doc_id: Column) -> Column:
    """Remainder of the crc32 of a document's id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _stated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text"):
        rest = batch.drop_columns(["_text"])
        x = statistics(batch.column("_text"))
        flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS), pa.array(x.ravel()))
        yield rest.append_column("_stats", flat)


def _scorer(model: BoostedTrees):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            scores = model.score(statistics(batch.column("_text")))
            yield batch.drop_columns(["_text"]).append_column("score", pa.array(scores))

    return score


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> BoostedTrees:
    """Learn from the labelled documents (_doc, _text) that are not held out, at most `sample` of them."""
    truth = labels.select(column("doc_id").cast("bigint").alias("_id"), column(label).cast("int").alias("_label"))
    truth = truth.where(F.col("_label").isin(0, 1) & (fold(F.col("_id")) != 0))
    chosen = F.broadcast(truth.orderBy(F.xxhash64("_id"), "_id").limit(sample))  # bounded by the parameter
    rows = docs.join(chosen, docs["_doc"] == chosen["_id"]).select("_doc", "_label", "_text")
    stats = rows.mapInArrow(_stated, "_doc bigint, _label int, _stats array<double>")
    held = stats.orderBy(F.xxhash64("_doc"), "_doc").limit(sample).toArrow()
    flat = ints(held.column("_stats").combine_chunks().flatten()) if held.num_rows else np.empty(0)
    return BoostedTrees(flat.reshape(-1, len(STATISTICS)), ints(held.column("_label")).astype(np.float64))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    cut: float = CUT,
    sample: int = SAMPLE,
) -> DataFrame:
    """The documents with held_out, score (higher: label 1 likelier) and predicted (1 from `cut`)."""
    aside = Aside(carried(docs, *RESULTS))
    rows = docs.select(*aside.out(), column(doc_id).cast("bigint").alias("_doc"), column(text).alias("_text"))
    model = fit(rows.select("_doc", "_text"), labels, sample)
    scored = rows.mapInArrow(_scorer(model), extended(rows, aside.inner, "_doc bigint, score double"))
    return scored.select(
        *aside.back(),
        F.coalesce(fold(F.col("_doc")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
