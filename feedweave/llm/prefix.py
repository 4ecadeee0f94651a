"""Global running totals without pulling a table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.common import stored


def placed(df: DataFrame, *order: str) -> DataFrame:
    """Range-sorted rows, stored with their partition (`_part`) and their place in it (`_slot`).

    They are stored because a range partitioning computed twice may cut differently.
    """
    rows = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_slot", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return stored(rows, "placed")


def totals(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Running totals of placed rows, in their order and for each value of `keys`, without the row itself.

    Inside a partition by a window, whose size is the partition's; over partitions from one row of totals for each
    partition and key that meets it. Sorted by key, a table has at most partitions + keys such rows.
    """
    by = ["_part", *keys]
    inside = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = rows.groupBy(*by).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    offsets = per_part.select(
        *[F.col(k).alias(f"_by_{k}") for k in by],
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    local = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    joined = local.join(offsets, same)
    return joined.select(
        *rows.columns, *[(F.col(n) + F.col(f"_before_{n}")).cast("bigint").alias(n) for n in sums]
    )
