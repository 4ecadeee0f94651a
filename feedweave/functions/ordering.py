"""Consecutive numbers over a whole table without pulling it into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.session import materialize

#: So many rows may be sorted in one task to pick a page out of them.
MOST_SORTED = 10_000
_RANGES = 64
_NO_TIME = -(1 << 63)


def number_rows(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """Add 1, 2, 3 … in `order`: range-sort, number inside each partition, add the partition's offset.

    The sorted rows are materialised once, since a range partitioning computed twice may cut differently. Only one
    count per partition goes through a single task. `order` should be close to unique.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_slot", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_slot") + 1)
        .drop("_part", "_slot", "_offset")
    )


def rows_at(df: DataFrame, newest: str, then: str, first: int, count: int, most: int = MOST_SORTED) -> DataFrame:
    """The rows numbered first to first + count - 1 (from 0), newest first by a timestamp, then by another column.

    The page is found by its rank: the rows of ranges of time are counted, the ranges that hold the page are cut into
    finer ones, and so on until they have few rows; only those are sorted. So a page far back costs a few passes that
    move counts, and the sort of what lies around the page, not of all that lies before it. Rows without a time come
    last. If very many rows have one and the same time, those are sorted as a whole, dealt over tasks.
    """
    stamp = F.coalesce(F.unix_micros(newest), F.lit(_NO_TIME))
    order = [F.desc_nulls_last(newest), F.asc(then)]
    before, held, low, high = 0, None, None, None
    rows = df
    while first + count - before > most and (held is None or held > most):
        cuts = rows.agg(F.percentile_approx(stamp, [k / _RANGES for k in range(_RANGES)], 1000)).first()[0]
        cuts = sorted(set(cuts or ()))
        if not cuts or (cuts == [low] and low == high):
            break
        # The range of a row is the number of cuts at or below its time, so ranges begin with their cut.
        place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= stamp))
        found = {r[0]: r[1:] for r in rows.groupBy(place).agg(F.count(F.lit(1)), F.min(stamp), F.max(stamp)).collect()}
        inside, ahead = [], before
        for number in sorted(found, reverse=True):
            size = found[number][0]
            if ahead + size > first and ahead < first + count:
                inside.append((number, ahead))
            ahead += size
        if not inside:
            return df.where(F.lit(False))
        chosen = [found[n] for n, _ in inside]
        bounds = min(c[1] for c in chosen), max(c[2] for c in chosen)
        if bounds == (low, high):
            break
        low, high = bounds
        before, held = inside[0][1], sum(c[0] for c in chosen)
        # The bounds in the column's own type reach the scan.
        rows = df.where(stamp.between(low, high))
        if low > _NO_TIME:
            rows = rows.where(F.col(newest).between(F.timestamp_micros(F.lit(low)), F.timestamp_micros(F.lit(high))))
    if first + count - before <= most or held is None or held <= most:
        return rows.orderBy(*order).offset(first - before).limit(count)
    numbered = number_rows(rows, *order, name="_position")
    return numbered.where(F.col("_position").between(first - before + 1, first - before + count)).drop("_position")
