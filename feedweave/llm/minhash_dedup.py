"""MinHash near-dedup with min-max hashing.

Each of `permutations` random permutations of the shingles gives two signature values, the smallest and the largest
shingle, so half as many hash evaluations give as many unbiased samples of the similarity, with less variance than
independent ones. Signatures are banded: 48 bands of 5 values miss a pair of similarity 0.75 once in 400,000 times.

Documents with equal shingle sets form a class and are represented by one text. Inside a band's bucket no pairs are
written out; classes are linked in rounds, and every link is confirmed on the full sets:

1. each class with the most popular class that it shares a bucket with: its centre. The original of a group of copies
   is more popular than the copies, which are nearer to it than to each other. One pair for each class;
2. where the classes of one centre are still several components, blocks of them against blocks: a task counts common
   shingles of two blocks as one matrix product and returns confirmed links only;
3. classes of different centres that share a bucket and are still in different components: every such pair.

So no link is lost and none is looked for twice inside a component.

A set: distinct runs of five words, A-Z in lower case; with fewer words the whole sequence; no words (null and empty
texts too): empty, linked with nothing. Documents without doc_id take part, but name no component; a component of such
documents alone has a null id and none is kept. Shingles and sets are told apart by 64-bit hashes. A column of the
input that has the name of a result column is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.common import Aside, carried, column, ints, stored
from feedweave.llm.components import components
from feedweave.llm.units import U64, Words, mixed, pieces, signed, utf8

SHINGLE = 5
BANDS = 48
ROWS = 5
PERCENT = 75
BLOCK = 512
RESULTS = ("n_shingles", "component_id", "kept")


class Shingles:
    """Distinct shingles of each text, in order of text: `values`, and `offsets` of the texts in them."""

    def __init__(self, column_: pa.Array, size: int):
        words = Words(*utf8(column_), lower=True)
        counts = words.counts
        n = len(words.codes)
        hashed = np.zeros(n, dtype=U64)
        for k in range(size):
            m = max(n - k, 0)
            hashed[:m] = mixed(hashed[:m] * U64(0x9E3779B97F4A7C15) + words.codes[k:])
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(n) - words.offsets[:-1][owner]
        full = place + size <= counts[owner]
        whole = self._short(words, counts, size)
        values = np.concatenate([hashed[full], whole[1]])
        owners = np.concatenate([owner[full], whole[0]])
        order = np.lexsort([values, owners])
        values, owners = values[order], owners[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
        self.values, self.owners = values[new], owners[new]
        self.offsets = np.searchsorted(self.owners, np.arange(len(counts) + 1))

    @staticmethod
    def _short(words: Words, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts of fewer words than a shingle have one: the whole sequence."""
        texts = np.flatnonzero((counts > 0) & (counts < size))
        value = mixed(counts[texts].astype(U64))
        for k in range(size - 1):
            there = counts[texts] > k
            code = words.codes[np.minimum(words.offsets[texts] + k, len(words.codes) - 1)]
            value = np.where(there, mixed(value * U64(0xD1342543DE82EF95) + code), value)
        return texts, value


def _signatures(bands: int, rows: int, size: int):
    permutations = -(-bands * rows // 2)
    rng = np.random.default_rng(7)
    factor = rng.integers(0, 1 << 63, permutations, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    offset = rng.integers(0, 1 << 63, permutations, dtype=np.int64).astype(U64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, "text"):
            sets = Shingles(batch.column("text"), size)
            n = np.diff(sets.offsets)
            sums = np.zeros(len(sets.values) + 1, dtype=U64)
            np.cumsum(mixed(sets.values), out=sums[1:])
            key = signed(mixed(sums[sets.offsets[1:]] - sums[sets.offsets[:-1]] + mixed(n.astype(U64))))
            fresh = np.array([bool(c) and not (k in seen or seen.add(k)) for k, c in zip(key.tolist(), n, strict=True)])
            some = np.flatnonzero(n > 0)
            least = np.zeros((2 * permutations, len(n)), dtype=U64)
            if len(some):
                at = sets.offsets[some]
                for i in range(permutations):
                    moved = sets.values * factor[i] + offset[i]
                    least[i, some] = np.minimum.reduceat(moved, at)
                    least[permutations + i, some] = np.maximum.reduceat(moved, at)
            codes = []
            for band in range(bands):
                code = np.full(len(n), U64(band + 1))
                for value in least[band * rows : (band + 1) * rows]:
                    code = mixed(code * U64(0x9E3779B97F4A7C15) + value)
                codes.append(code)
            flat = signed(np.stack(codes, axis=1)[fresh].ravel())
            lengths = np.where(fresh, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    batch.column("text_key"),
                    pa.array(key, mask=n == 0),
                    pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), pa.array(flat)),
                ],
                names=["doc", "text_key", "key", "n", "bands"],
            )

    return sign


def _confirm(percent: int, size: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_a"):
            left, right = (Shingles(batch.column(n), size) for n in ("text_a", "text_b"))
            keep = []
            for i in range(batch.num_rows):
                x = left.values[left.offsets[i] : left.offsets[i + 1]]
                y = right.values[right.offsets[i] : right.offsets[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return links


def _pairs(df: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose set sizes allow the similarity."""
    fit = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("a") != F.col("b"))
    return df.where(fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _cross_links(percent: int, size: int):
    def links(group: pa.Table) -> pa.Table:
        """Confirmed links between the left and the right block, one for each two components."""
        sets = Shingles(group.column("text"), size)
        root, key, side = (ints(group.column(n)) for n in ("root", "key", "side"))
        n = np.diff(sets.offsets)
        shingle, code = np.unique(sets.values, return_inverse=True)
        here = np.zeros((2, len(shingle)), dtype=bool)
        sides = side[sets.owners]
        for s in (0, 1):
            here[s, code[sides != 1 - s]] = True
        both = here.all(axis=0)
        used = np.cumsum(both) - 1
        keep = both[code]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        at = [np.full(len(side), -1), np.full(len(side), -1)]
        at[0][left], at[1][right] = np.arange(len(left)), np.arange(len(right))
        step = 1 << 13
        for low in range(0, int(both.sum()), step):
            blocks = []
            for s, rows in ((0, left), (1, right)):
                of = keep & (at[s][sets.owners] >= 0)
                column_ = used[code[of]]
                now = (column_ >= low) & (column_ < low + step)
                dense = np.zeros((len(rows), min(step, int(both.sum()) - low)), dtype=np.float32)
                dense[at[s][sets.owners[of][now]], column_[now] - low] = 1
                blocks.append(dense)
            common += blocks[0] @ blocks[1].T
        union = n[left][:, None] + n[right][None, :] - common
        near = (100 * common.astype(np.float64) >= percent * union) & (root[left][:, None] != root[right][None, :])
        i, j = np.nonzero(near)
        pairs = np.stack([np.minimum(root[left[i]], root[right[j]]), np.maximum(root[left[i]], root[right[j]])], axis=1)
        _, first = np.unique(pairs, axis=0, return_index=True) if len(pairs) else (None, np.empty(0, dtype=np.int64))
        a, b = key[left[i[first]]], key[right[j[first]]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return links


def _within_centres(rooted: DataFrame, found: DataFrame, percent: int, size: int, block: int = BLOCK) -> DataFrame:
    """Links among the classes of one centre that are in several components.

    A group of m classes becomes m / block blocks, and each pair of blocks is a task of its own: no task holds more than
    two blocks, and a class is sent m / block times.
    """
    several = (
        rooted.groupBy("centre")
        .agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("_low"), F.max("root").alias("_high"))
        .where("_low <> _high")
        .select("centre", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    members = rooted.join(several, "centre").withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select("centre", "key", "root", "mine", other).select(
        "centre",
        F.least("mine", "other").alias("low"),
        F.greatest("mine", "other").alias("high"),
        "key",
        "root",
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    return stored(
        dealt.join(found, "key").groupBy("centre", "low", "high").applyInArrow(_cross_links(percent, size), "a bigint, b bigint"),
        "within",
    )


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    percent: int = PERCENT,
    size: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links): each document's class, each class's component, and confirmed links of classes.

    documents: doc, text_key, key (the class), n (its set's size); classes: key, component (smallest doc_id), root;
    links: a, b (classes), enough of them to connect every component.
    """
    texts = docs.select(
        column(text).alias("text"), column(doc_id).cast("bigint").alias("doc"), F.xxhash64(column(text)).alias("text_key")
    )
    signed_docs = stored(
        texts.select("doc", "text_key", "text").mapInArrow(
            _signatures(bands, rows, size), "doc bigint, text_key bigint, key bigint, n bigint, bands array<bigint>"
        ),
        "signatures",
    )
    documents = signed_docs.select("doc", "text_key", "key", "n")
    banded = signed_docs.select(F.explode("bands").alias("band"), "key", "n")
    shared = (
        banded.groupBy("band")
        .agg(F.min("key").alias("_least"), F.max("key").alias("_most"), F.count(F.lit(1)).alias("size"))
        .where("_least <> _most")
    )
    # Members of buckets that hold more than one class.
    buckets = stored(banded.join(shared.select("band", "size"), "band").distinct(), "buckets")
    wanted = buckets.select("key").distinct()
    chosen = documents.join(wanted, "key").groupBy("key").agg(F.min("text_key").alias("text_key"))
    found = stored(
        texts.join(chosen, "text_key").groupBy("key").agg(F.first("text").alias("text")), "texts"
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = found.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
        right = found.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
        return stored(
            pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(
                _confirm(percent, size), "a bigint, b bigint"
            ),
            "confirmed",
        )

    popular = buckets.groupBy("key").agg(F.sum("size").alias("popularity"))
    ranked = buckets.join(popular, "key").select("band", "key", "n", F.struct("popularity", "key", "n").alias("as_lead"))
    leads = ranked.groupBy("band").agg(F.max("as_lead").alias("lead"))
    centred = stored(
        ranked.join(leads, "band").groupBy("key", "n").agg(F.max("lead").alias("lead")).select(
            "key", "n", F.col("lead.key").alias("centre"), F.col("lead.n").alias("n_b")
        ),
        "centres",
    )
    links = confirmed(
        _pairs(centred.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("centre").alias("b"), "n_b"), percent)
    )

    def rooted_by(links: DataFrame) -> DataFrame:
        roots = components(links).withColumnRenamed("node", "key")
        return centred.join(roots, "key", "left").select("key", "n", "centre", F.coalesce("root", "key").alias("root"))

    links = links.union(_within_centres(rooted_by(links), found, percent, size))
    rooted = rooted_by(links)
    placed = buckets.select("band", "key").join(rooted, "key")
    several = placed.groupBy("band").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high")
    open_rows = stored(placed.join(several.select("band"), "band"), "open")
    left = open_rows.select("band", F.col("key").alias("a"), F.col("n").alias("n_a"), "root", "centre")
    right = open_rows.select(
        "band", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), F.col("centre").alias("centre_b")
    )
    pairs = left.join(right, "band").where("root < root_b and centre <> centre_b")
    links = links.union(confirmed(_pairs(pairs, percent)))
    roots = components(links)
    named = documents.where("key is not null").groupBy("key").agg(F.min("doc").alias("doc"))
    rooted = named.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = rooted.groupBy("root").agg(F.min("doc").alias("component"))
    return documents, stored(rooted.join(ids, "root").select("key", "component", "root"), "classes"), links


def mark_near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, **tuning: int
) -> DataFrame:
    """The documents with n_shingles, component_id (smallest doc_id reachable) and kept (doc_id = component_id)."""
    documents, classes, _ = near_duplicates(docs, text, doc_id, **tuning)
    names = carried(docs, *RESULTS) if carry is None else carry
    of_text = documents.groupBy("text_key").agg(F.first("key").alias("key"), F.first("n").alias("n_shingles"))
    of_text = of_text.join(classes, "key", "left").select("text_key", "key", "n_shingles", "component")
    aside = Aside(names)
    rows = docs.select(*aside.out(), column(doc_id).cast("bigint").alias("_doc"), F.xxhash64(column(text)).alias("text_key"))
    component = F.when(F.col("key").isNull(), F.col("_doc")).otherwise(F.col("component"))
    return rows.join(of_text, "text_key").select(
        *aside.back(),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("_doc") == component, F.lit(False)).alias("kept"),
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **tuning: int) -> DataFrame:
    """One row of each group of near-copies: its smallest doc_id, then the smallest hash of its row.

    Groups in which no row has a doc_id keep one row as well. Empty texts are groups of their own, and of a repeated
    empty row one stays if it has a doc_id.
    """
    documents, classes, _ = near_duplicates(docs, text, doc_id, **tuning)
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "text_key"))
    of_text = documents.where("key is not null").groupBy("text_key", "key").agg(first.alias("first"))
    of_group = of_text.join(classes, "key").groupBy("root").agg(F.min("first").alias("first"))
    row = F.xxhash64("text_key", "doc").alias("_row")
    chosen = of_group.select("first.*").select(row, F.lit(False).alias("_every"))
    empty = documents.where("key is null").select(row, F.col("doc").isNull().alias("_every")).distinct()
    aside = Aside(docs.columns)
    rows = docs.select(
        *aside.out(),
        F.xxhash64(F.xxhash64(column(text)), column(doc_id).cast("bigint")).alias("_row"),
        F.xxhash64(*map(column, docs.columns)).alias("_content"),
    )
    order = F.row_number().over(Window.partitionBy("_row").orderBy("_content"))
    found = rows.join(chosen.union(empty), "_row").withColumn("_turn", order)
    return found.where("_turn = 1 or _every").select(*aside.back())
