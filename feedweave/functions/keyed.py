"""Order-dependent per-key computation that never walks an unbounded group in one task.

Following a key's records in arrival order is a window over the key. That is right for the long tail of keys, but
one key may hold a third of a feed. The rows of keys with more than `rows_per_group` rows are therefore range
partitioned by key and arrival number, and what a key has in one partition is a stretch: each stretch is walked by its
own task, a one-row summary per stretch (map-side combined) is carried across the stretches of the key, and the carried
value is joined back. Ranges are cut by rows, whatever gaps the numbers have, so a key has at most as many stretches as
there are ranges. This works for every
running value that is associative: highest so far, total so far, last non-null so far.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.session import materialize, rows_per_group

STRETCH = "_stretch"
#: Up to so many hot keys are broadcast; more are joined by a shuffle.
MOST_BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Running:
    """A running value over the rows strictly before the current one; nulls do not count."""

    kind: str
    value: Column

    def local(self, window) -> Column:
        if self.kind == "highest":
            return F.max(self.value).over(window)
        if self.kind == "total":
            return F.sum(self.value).over(window)
        return F.last(self.value, ignorenulls=True).over(window)

    def per_stretch(self, seq: str) -> Column:
        if self.kind == "highest":
            return F.max(self.value)
        if self.kind == "total":
            return F.sum(self.value)
        return F.max_by(self.value, F.when(self.value.isNotNull(), F.col(seq)))

    def across(self, name: str, window) -> Column:
        return Running(self.kind, F.col(name)).local(window)

    def combine(self, carried: Column, local: Column) -> Column:
        if self.kind == "highest":
            return F.greatest(carried, local)
        if self.kind == "total":
            return F.when(carried.isNotNull() | local.isNotNull(), F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0)))
        return F.coalesce(local, carried)


def highest(value: Column) -> Running:
    return Running("highest", value)


def total(value: Column) -> Running:
    return Running("total", value)


def last(value: Column) -> Running:
    return Running("last", value)


class WholeKeys:
    """Each key is one window group; used when every key is known to be small enough."""

    def __init__(self, keys: Sequence[str], seq: str):
        self.keys, self.seq = list(keys), seq

    def before(self, df: DataFrame, **running: Running) -> DataFrame:
        window = (
            Window.partitionBy(*self.keys).orderBy(self.seq).rowsBetween(Window.unboundedPreceding, -1)
        )
        return df.withColumns({name: value.local(window) for name, value in running.items()})


class SplitKeys(WholeKeys):
    """Each stretch of a key is one window group; values are carried across stretches."""

    def before(self, df: DataFrame, **running: Running) -> DataFrame:
        group = [*self.keys, STRETCH]
        inside = Window.partitionBy(*group).orderBy(self.seq).rowsBetween(Window.unboundedPreceding, -1)
        across = Window.partitionBy(*self.keys).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
        summary = df.groupBy(*group).agg(*[v.per_stretch(self.seq).alias(n) for n, v in running.items()])
        # One row per stretch. Kept, so that a later step does not compute this one again inside its own summary.
        carried = materialize(
            summary.select(*group, *[v.across(n, across).alias(f"_carried_{n}") for n, v in running.items()])
        )
        local = df.withColumns({f"_local_{n}": v.local(inside) for n, v in running.items()})
        return (
            local.join(carried, group, "left")
            .withColumns(
                {n: v.combine(F.col(f"_carried_{n}"), F.col(f"_local_{n}")) for n, v in running.items()}
            )
            .drop(*[f"_carried_{n}" for n in running], *[f"_local_{n}" for n in running])
        )


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys holding more than `limit` rows, with their rows `_n`: at most rows / limit of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)


def cut_by_rows(df: DataFrame, keys: Sequence[str], seq: str, ranges: int) -> DataFrame:
    """The rows with their stretch: the range they fall in when all are cut into `ranges` by key and arrival number."""
    return df.repartitionByRange(ranges, *keys, seq).withColumn(STRETCH, F.spark_partition_id())


def walk_keys(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    body: Callable[[WholeKeys, DataFrame], DataFrame],
    limit: int | None = None,
) -> DataFrame:
    """Run `body` over the records of every key in `seq` order, splitting keys that are too big for one task.

    `seq` is a number that is unique within a key. Ranges are twice as many as needed, since their bounds are sampled.
    Without big keys (the usual case) the plan is one shuffle by key and the windows on top of it. Keys must not be null.
    """
    limit = rows_per_group(df.sparkSession, limit)
    counted = materialize(hot_keys(df, keys, limit))
    found, rows = counted.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if found == 0:
        return body(WholeKeys(keys, seq), df)
    hot = counted.select(*keys)
    if found <= MOST_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    cold = body(WholeKeys(keys, seq), df.join(hot, list(keys), "left_anti"))
    stretched = cut_by_rows(df.join(hot, list(keys), "left_semi"), keys, seq, 2 * ceil(rows / limit))
    # Kept, so that every walk over the stretches sees the same cuts.
    split = body(SplitKeys(keys, seq), materialize(stretched.repartition(*keys, STRETCH)))
    return cold.unionByName(split.drop(STRETCH))
