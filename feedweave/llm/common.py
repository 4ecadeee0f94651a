"""What the operators share: stored intermediate results and text columns."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.session import shared_folder

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the session names for checkpoints."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to shared storage and go on from there.

    Cuts lineage, survives lost executors, and keeps columns prunable. Like checkpoints, the folders belong to the
    cluster's shared folder and expire with it.
    """
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def carried(df: DataFrame, *results: str) -> list[str]:
    """Columns handed on as they are: all but those that have the name of a result column, in whatever case."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]


class Aside:
    """Columns of the user under names of no meaning, so that none can meet a name that an operator uses inside."""

    def __init__(self, names: list[str]):
        self.names = names
        self.inner = [f"_c{i}" for i in range(len(names))]

    def out(self) -> list[Column]:
        return [column(n).alias(i) for n, i in zip(self.names, self.inner, strict=True)]

    def back(self) -> list[Column]:
        return [F.col(i).alias(n) for n, i in zip(self.names, self.inner, strict=True)]


def extended(df: DataFrame, names: list[str], results: str) -> T.StructType:
    """Schema of the named columns and the results (DDL)."""
    return T.StructType([df.schema[n] for n in names] + T.StructType.fromDDL(results).fields)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ints(values) -> np.ndarray:
    """An Arrow column of integers without nulls as numpy."""
    return values.to_numpy(zero_copy_only=False)


def runs_of_true(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs."""
    steps = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs; spans that touch become one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
