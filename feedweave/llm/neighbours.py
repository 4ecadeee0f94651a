"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample (`SAMPLE` vectors, chosen by a hash of vec_id) and has a bounded number of
leaves; every vector is indexed, each in the leaf it descends to. A query walks the tree with a priority queue, always
into the nearest branch not yet visited, and takes the first leaves it reaches. How many leaves it has to visit is
calibrated: the exact neighbours of `CALIBRATION` queries are found by brute force over all vectors, and the visits are
widened until those would have been found with recall `recall`. A query whose leaves hold fewer than k candidates goes on
to further ones, so it gets k neighbours, or all there are.

Vectors get one more component, which makes the largest inner product the nearest vector. Leaves of any size are
searched in blocks of vectors times blocks of queries, so that neither a leaf that holds a third of all vectors nor
one that all queries visit is one task's work. Scores are inner products of the original vectors in double precision;
equal vectors get equal scores, and ties go to the smaller vec_id.

Vectors that are null, zero, or hold null or non-finite components take no part; nor do those without vec_id or with
another number of components than most vectors have. Rows with the vec_id of a query are the query's own; a vec_id that
repeats is one query, and as a candidate each of its rows counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.common import column, ints, stored

SAMPLE = 20_000
BRANCHES = 8
LEAVES = 128
CALIBRATION = 64
RECALL = 0.95
NEAREST = 20
QUERY_EVERY = 20
BLOCK = 8192


class Tree:
    """A k-means tree in flat arrays: `children` of inner nodes, the number of leaves below, centroids."""

    def __init__(self, sample: np.ndarray, branches: int, leaf: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centroids, self.children, self.leaf = [], [], []
        self.leaves = 0
        todo = [(self._node(sample), np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            parts = self._parts(sample[rows], branches, rng) if len(rows) > leaf else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for part in parts:
                child = self._node(sample[rows[part]])
                self.children[node].append(child)
                todo.append((child, rows[part]))
        self.centroids = np.array(self.centroids)
        self.leaf = np.array(self.leaf)

    def _node(self, members: np.ndarray) -> int:
        self.centroids.append(members.mean(axis=0) if len(members) else np.zeros(members.shape[1]))
        self.children.append([])
        self.leaf.append(-1)
        return len(self.children) - 1

    @staticmethod
    def _parts(x: np.ndarray, branches: int, rng) -> list[np.ndarray]:
        """k-means from distinct starting points; fewer parts if there are fewer distinct vectors."""
        start = np.unique(x, axis=0)
        centres = start[rng.permutation(len(start))[:branches]]
        for _ in range(8):
            own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
            centres = np.array([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        return [np.flatnonzero(own == k) for k in range(len(centres)) if (own == k).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child at every level."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            c = self.centroids[kids]
            own = np.argmin((c**2).sum(1) - 2 * x[rows] @ c.T, axis=1)
            todo += [(int(kid), rows[own == k]) for k, kid in enumerate(kids)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first leaves of best-bin-first search, in order."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                kids = self.children[node]
                gaps = ((self.centroids[kids] - query) ** 2).sum(axis=1)
                best = int(np.argmin(gaps))
                for k, kid in enumerate(kids):
                    if k != best:
                        heapq.heappush(queue, (float(gaps[k]), kid))
                node = kids[best]
            found.append(int(self.leaf[node]))
        return found


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return ints(vectors.flatten()).astype(np.float64).reshape(-1, size)


def _raised(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component that gives all vectors the same length."""
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _query_points(x: np.ndarray, longest: float) -> np.ndarray:
    scaled = x * (longest / np.sqrt((x**2).sum(axis=1)))[:, None]
    return np.concatenate([scaled, np.zeros((len(x), 1))], axis=1)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order for every pair of rows, so that equal vectors score equal."""
    return (q * x).sum(axis=-1)


def _best(q: np.ndarray, q_id: int, x: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int):
    """The k best of one query: `near` are quick scores, within `slack` of the exact ones."""
    slack = 1e-9 * max(1.0, float(np.abs(near).max(initial=0.0)))
    own = ids == q_id
    near = np.where(own, -np.inf, near)
    if len(near) > k:
        bound = np.partition(near, len(near) - k)[len(near) - k] - slack
        rows = np.flatnonzero((near >= bound) & ~own)
    else:
        rows = np.flatnonzero(~own)
    exact = _scores(q, x[rows])
    order = np.lexsort([ids[rows], -exact])[:k]
    return ids[rows][order], exact[order]


def _results(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)),
            pa.array(np.concatenate([np.empty(0, np.int64), *(i for _, i, _ in found)]).astype(np.int64)),
            pa.array(np.concatenate([np.empty(0), *(s for _, _, s in found)])),
        ],
        names=["query_id", "vec_id", "score"],
    )


def _searched(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    quick = queries @ x.T if len(x) else np.zeros((len(queries), 0))
    return _results([(int(i), *_best(q, i, x, ids, near, k)) for q, i, near in zip(queries, query_ids, quick, strict=True)])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their number of components."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(
        column(vec_id).cast("bigint").alias("vec_id"), column(embedding).cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda c: c != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = usual["n"] if usual else 0
    return rows.where(F.size("v") == size), size


def nearest(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = NEAREST,
    query_every: int = QUERY_EVERY,
    sample: int = SAMPLE,
    branches: int = BRANCHES,
    leaves: int = LEAVES,
    calibration: int = CALIBRATION,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors of each query (vec_id divisible by `query_every`)."""
    rows, size = usable(vectors, vec_id, embedding)
    queries = (
        rows.where(F.col("vec_id") % query_every == 0)
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own"))
        .withColumnRenamed("vec_id", "query_id")
    )
    if not size:
        return queries.select(
            "query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")
        ).where("false")
    spark = vectors.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    longest = float(rows.agg(F.max(squares)).first()[0]) ** 0.5 * (1 + 1e-9)
    # Bounded by the parameters, whatever the size of the table.
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    tree = Tree(_raised(_matrix(fitted.column("v").combine_chunks(), size), longest), branches, max(1, fitted.num_rows // leaves))
    shared = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.assign(_raised(_matrix(batch.column("v"), size), longest))
                yield batch.append_column("leaf", pa.array(leaf))

    indexed = stored(rows.mapInArrow(index, "vec_id bigint, v array<double>, leaf int"), "index")

    # Exact neighbours of a few queries, to know how many leaves have to be visited.
    asked = queries.orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(calibration).toArrow()
    asked_ids = ints(asked.column("query_id"))
    asked_x = _matrix(asked.column("v").combine_chunks(), size) if asked.num_rows else np.zeros((0, size))

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                yield _searched(asked_x, asked_ids, _matrix(part.column("v"), size), ints(part.column("vec_id")), k)

    hits = "query_id bigint, vec_id bigint, score double"
    truth = _ranked(indexed.select("vec_id", "v").mapInArrow(exactly, hits), k)
    leaf_of = truth.select("query_id", "vec_id").join(indexed.select("vec_id", "leaf"), "vec_id")
    needed = leaf_of.groupBy("query_id", "leaf").agg(F.count(F.lit(1)).alias("n")).toArrow()  # queries * k rows at most
    orders = {
        int(i): {leaf: place for place, leaf in enumerate(tree.visits(q, tree.leaves))}
        for i, q in zip(asked_ids, _query_points(asked_x, longest), strict=True)
    }
    pairs = zip(needed.column("query_id").to_pylist(), needed.column("leaf").to_pylist(), strict=True)
    depth = np.array([orders[q][leaf] for q, leaf in pairs], dtype=np.int64)
    weight = ints(needed.column("n"))
    visits = 1
    while visits < tree.leaves and weight[depth < visits].sum() < recall * weight.sum():
        visits = min(tree.leaves, visits + max(1, visits // 8))

    # One row for each leaf, and the tree bounds the leaves.
    held = np.zeros(tree.leaves, dtype=np.int64)
    for leaf, n in indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        held[leaf] = n

    def leaves_for(point: np.ndarray, own: int) -> list[int]:
        """The first leaves, and further ones until they hold k candidates for sure."""
        most = visits
        while True:
            leaves = shared.value.visits(point, most)
            if len(leaves) < most or held[leaves].sum() >= k + own:
                return leaves
            most *= 2

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _query_points(_matrix(batch.column("v"), size), longest)
            leaves = [leaves_for(q, own) for q, own in zip(points, ints(batch.column("own")), strict=True)]
            yield batch.append_column("leaves", pa.array(leaves, pa.list_(pa.int32())))

    routed = stored(queries.mapInArrow(route, "query_id bigint, v array<double>, own bigint, leaves array<int>"), "routed")
    # One row for each leaf, and the tree bounds the leaves.
    of_leaf = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"))
    of_query = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("asked"))
    blocks = F.broadcast(
        of_leaf.join(of_query, "leaf").select(
            "leaf", F.ceil(F.col("rows") / block).cast("int").alias("parts"), F.ceil(F.col("asked") / block).cast("int").alias("turns")
        )
    )
    some_hash = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30))
    candidates = indexed.join(blocks, "leaf").select(
        "leaf",
        (some_hash("vec_id") % F.col("parts")).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("turns") - 1).cast("bigint"))).alias("turn"),
        F.lit(None).cast("bigint").alias("query_id"),
        "vec_id",
        "v",
    )
    asking = routed.select("query_id", "v", F.explode("leaves").alias("leaf")).join(blocks, "leaf").select(
        "leaf",
        F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("parts") - 1).cast("bigint"))).alias("part"),
        (some_hash("query_id") % F.col("turns")).alias("turn"),
        "query_id",
        F.lit(None).cast("bigint").alias("vec_id"),
        "v",
    )

    def search(table: pa.Table) -> pa.Table:
        is_query = table.column("query_id").is_valid()
        q, x = table.filter(is_query), table.filter(pa.compute.invert(is_query))
        found = _searched(
            _matrix(q.column("v").combine_chunks(), size),
            ints(q.column("query_id")),
            _matrix(x.column("v").combine_chunks(), size),
            ints(x.column("vec_id")),
            k,
        )
        return pa.Table.from_batches([found])

    met = candidates.unionByName(asking).groupBy("leaf", "part", "turn").applyInArrow(search, hits)
    return _ranked(met, k).select("query_id", "rank", "vec_id", "score")
