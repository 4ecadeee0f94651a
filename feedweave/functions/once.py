"""Compute expensive columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions are evaluated once per row, whatever is filtered or derived from them later.

    A filter on a projected column is pushed below the projection by repeating the column's expression there; for
    checks of a whole JSON document, which build on each other, that repeats the document's parsing hundreds of times.
    Filters do not move below a generator, so the columns go through one that gives exactly one row. Filters on other
    columns still reach the scan.
    """
    # The columns are computed in a projection, which is compiled, and not inside the generator.
    packed = df.withColumn("_packed", F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return packed.select(*kept, F.explode_outer("_packed").alias("_once")).select(
        *kept, *[F.col(f"_once.{n}").alias(n) for n in columns]
    )
