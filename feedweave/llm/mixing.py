"""Mixing sources to target weights, in DataFrame functions only.

Each source is a stream of words: its documents in a permuted order, read again from the start when the target is above
the source's size. The target is an exact quota of words, cut into blocks. A multivariate-hypergeometric splitting tree
deals the block quota among the output shards: at each node the number of blocks that go to the left half of the shards
is one hypergeometric draw, so that all ways to put the blocks into the shards' slots are equally likely. Each shard
then draws its own blocks of a permutation of the source's blocks (no block twice), and orders what it got by a hash.

Running totals inside a source come from per-partition totals, so a source may hold any part of all rows. Draws depend
on content and seed only: reruns agree. A null or empty text has size 0 and is never taken; a null source is a source
of its own, last in order. Repeated rows are documents of their own. The last document of a quota is cut to the word.
A column of the input that has the name of a result column is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.common import Aside, carried, column
from feedweave.llm.prefix import placed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SHARDS = 16
BLOCKS = 128
SEED = 20240229
RESULTS = ("size", "source_size", "target", "taken", "draws")
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Target of each source (source, source_size): shares of the weights, none above `MOST_REPEATS` times its size.

    The level at which every weight is served is the largest one that the sources which are not at their limit leave;
    one row for each source, two windows over them.
    """
    by_name = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    by_limit = Window.orderBy("_ratio", "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn(
        "_weight", F.element_at(cycle, ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    )
    limited = ranked.withColumn("_limit", F.col("source_size") * float(MOST_REPEATS)).withColumn(
        "_ratio", F.col("_limit") / F.col("_weight")
    )
    full_before = F.coalesce(F.sum("_limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("_weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy()) * share
    levels = limited.withColumn("_level", (everything - full_before) / weight_left)
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(Window.partitionBy())
    return levels.withColumn("target", F.least("_limit", F.coalesce(level, F.lit(0.0)) * F.col("_weight"))).select(
        "_source", "source_size", "target"
    )


def _uniform(*of) -> Column:
    return F.xxhash64(*of).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _hypergeometric(n: Column, half: Column, u: Column) -> Column:
    """How many of n things, dealt at random into 2 * half slots, lie in the first half: the inverse of its law at u."""
    low, high = F.greatest(n - half, F.lit(0)), F.least(n, half)
    ks = F.sequence(low, high)

    def heavier(weight: Column, k: Column) -> Column:
        return weight * (half - k) * (n - k) / ((k + 1) * (half - n + k + 1))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        ks, start, lambda s, k: F.struct(heavier(s["w"], k).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"]
    )
    begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), low.alias("at"))
    found = F.aggregate(
        ks,
        begin,
        lambda s, k: F.struct(
            heavier(s["w"], k).alias("w"),
            (s["sum"] + s["w"]).alias("sum"),
            F.when(s["sum"] <= u * total, k).otherwise(s["at"]).alias("at"),
        ),
        lambda s: s["at"],
    )
    return found


def split_blocks(sources: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """Shard of every block of a source: adds `_block_words` and `_shard_of` (an array, by block) to the sources.

    `shards` must be a power of two. A shard has twice as many slots for a source's blocks as its even share.
    """
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    quota = F.round("target").cast("bigint")
    sized = sources.withColumn("_quota", quota).withColumn(
        "_block_words", F.greatest(F.ceil(F.col("_quota") / blocks), F.lit(1)).cast("bigint")
    )
    sized = sized.withColumn("_blocks", F.ceil(F.col("_quota") / F.col("_block_words")).cast("int"))
    slots = (F.ceil(F.col("_blocks") / shards) * 2).cast("int")
    tree = sized.select("_source", F.lit(0).alias("_node"), F.col("_blocks").alias("_n"), slots.alias("_slots"))
    width = shards
    while width > 1:
        half = (F.col("_slots") * (width // 2)).cast("int")
        left = tree.withColumn(
            "_left", _hypergeometric(F.col("_n"), half, _uniform(F.lit(seed), F.lit(width), "_source", "_node")).cast("int")
        )
        tree = left.select(
            "_source",
            "_slots",
            F.explode(
                F.array(
                    F.struct((F.col("_node") * 2).alias("node"), F.col("_left").alias("n")),
                    F.struct((F.col("_node") * 2 + 1).alias("node"), (F.col("_n") - F.col("_left")).alias("n")),
                )
            ).alias("_child"),
        ).select("_source", "_slots", F.col("_child.node").alias("_node"), F.col("_child.n").alias("_n"))
        width //= 2
    # Shards in order, each as often as it has blocks: dealt to the blocks in a permuted order.
    dealt = tree.groupBy("_source").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("_node", "_n"))), lambda c: F.array_repeat(c["_node"], c["_n"]))
        ).alias("_slots_of")
    )
    numbered = F.when(F.col("_blocks") > 0, F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    permuted = F.array_sort(
        F.transform(numbered, lambda b: F.struct(F.xxhash64(F.lit(seed), "_source", b).alias("key"), b.alias("block")))
    )
    inverse = F.array_sort(
        F.transform(permuted, lambda p, i: F.struct(p["block"].alias("block"), F.element_at("_slots_of", i + 1).alias("shard")))
    )
    both = sized.alias("a").join(dealt.alias("b"), F.col("a._source").eqNullSafe(F.col("b._source")))
    return both.select("a.*", "b._slots_of").select(
        "_source", "source_size", "target", "_quota", "_block_words", F.transform(inverse, lambda p: p["shard"]).alias("_shard_of")
    )


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    shards: int = SHARDS,
    blocks: int = BLOCKS,
    seed: int = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """The documents with size, source_size, target, taken and draws.

    `draws` has an entry for each time a document is taken: pass, shard, block, words and place (the order inside the
    shard). `carry` names the columns to hand on, all by default.
    """
    aside = Aside(carried(docs, *RESULTS) if carry is None else carry)
    rows = placed(
        docs.select(
            *aside.out(),
            column(source).alias("_source"),
            F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(F.lit(seed), column(doc_id), column(text)).alias("_place"),
        ),
        "_source",
        "_place",
    )
    per_part = rows.groupBy("_part", "_source").agg(F.sum("size").alias("_words"))
    sizes = per_part.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    plan = split_blocks(targets(sizes, weights, share), shards, blocks, seed)
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    info = (
        offsets.alias("o")
        .join(plan.alias("p"), F.col("o._source").eqNullSafe(F.col("p._source")))
        .select("o._part", "o._before", "p.*")
        .withColumnsRenamed({"_part": "_info_part", "_source": "_info_source"})
    )
    inside = Window.partitionBy("_part", "_source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.join(
        info, (F.col("_part") == F.col("_info_part")) & F.col("_source").eqNullSafe(F.col("_info_source"))
    ).withColumn("_start", F.col("_before") + F.col("_inside"))

    def draw(turn: int) -> Column:
        at = F.col("_start") + F.col("source_size") * turn
        block = F.floor(at / F.col("_block_words")).cast("int")
        words = F.greatest(F.least("size", F.col("_quota") - at), F.lit(0)).cast("bigint")
        return F.struct(
            F.lit(turn).alias("pass"),
            F.when(words > 0, F.get("_shard_of", block)).alias("shard"),
            block.alias("block"),
            words.alias("words"),
            F.xxhash64(F.lit(seed), "_place", F.lit(turn), "_slot").alias("place"),
        )

    turns = F.filter(F.array(*[draw(t) for t in range(MOST_REPEATS)]), lambda d: d["words"] > 0)
    return joined.withColumn("draws", turns).select(
        *aside.back(),
        "size",
        "source_size",
        "target",
        F.aggregate("draws", F.lit(0).cast("bigint"), lambda n, d: n + d["words"]).alias("taken"),
        "draws",
    )


def drawn(mixed: DataFrame, least_share: float = 0.0, whole_shards: bool = True) -> DataFrame:
    """One row for each time a document is taken: its shard, its place there and how many of its words are taken.

    Draws that take less than `least_share` of a document are left out. With `whole_shards` the rows are dealt over tasks
    by ranges of shard and place, so that writing them keeps a shard together; without, nothing is moved, and each task's
    rows come by shard and place.
    """
    aside = Aside(carried(mixed, *RESULTS, "shard", "place", "words"))
    enough = F.filter("draws", lambda d: d["words"] >= F.col("size") * least_share)
    rows = mixed.select(*aside.out(), F.explode(enough).alias("_draw")).select(*aside.inner, "_draw.shard", "_draw.place", "_draw.words")
    dealt = rows.repartitionByRange("shard", "place") if whole_shards else rows
    return dealt.sortWithinPartitions("shard", "place").select(*aside.back(), "shard", "place", "words")
