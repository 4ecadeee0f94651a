"""Tables with one current row for each key, of which a write touches only what changed.

Rows are cut into hash buckets on shared storage, plain Parquet. A write adds one layer, with the changed rows alone, to
the buckets that its keys fall in; of a key's rows the one in the newest layer counts, and a row marked as gone takes
its key away. Once the rows added to a bucket outgrow the layer they lie on, or there are many layers, the write folds
the bucket into one new layer, so reading stays near the size of the table and writing near the size of the changes.

What a table consists of is its layout: for each bucket its layers, oldest first. Whoever owns the table keeps the
layout in its own commit, so that nothing written is visible before that, and a retry of a write overwrites its files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYERS = "array<struct<no: bigint, kind: string, rows: bigint>>"
LAYOUT = f"map<int, {LAYERS}>"
# "fold" sorts after "change": where both have one number, the fold counts.
CHANGE, FOLD = "change", "fold"
MOST_LAYERS = 8
FOLD_SHARE = 0.5
FILES_PER_BUCKET = 4


def newest_commit(spark: SparkSession, folder: str, schema: str, number: str, below: int | None = None) -> dict | None:
    """The row under the highest `number=N` of a folder of one-row commits, or the highest below a number.

    Commits are found by the names of their folders; one file is opened.
    """
    try:
        files = spark.read.schema(schema).parquet(folder).inputFiles()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    numbered = {int(re.search(rf"/{number}=(\d+)/[^/]*$", f)[1]): f for f in files}
    usable = [n for n in numbered if below is None or n < below]
    return spark.read.schema(schema).parquet(numbered[max(usable)]).first().asDict() if usable else None


def write_commit(spark: SparkSession, folder: str, schema: str, number: str, at: int, row: tuple) -> None:
    """One row is one file and one rename, so it is there or not."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{number}={at}")


@dataclass
class KeyedTable:
    """`keys` make a row's key, the last of them its bucket. `gone` (a SQL condition) marks rows that end a key."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    buckets: int
    gone: str | None = None
    files: int = FILES_PER_BUCKET
    most_layers: int = MOST_LAYERS

    def bucket_of(self) -> Column:
        return F.pmod(F.hash(self.keys[-1]), F.lit(self.buckets))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the rows fall in: at most as many values as there are buckets."""
        return [row[0] for row in rows.select(self.bucket_of().alias("b")).distinct().collect()]

    def _folder(self, layer, bucket: int) -> str:
        return f"{self.path}/no={layer[0]}/kind={layer[1]}/bucket={bucket}"

    def _files(self, paths: list[str]) -> DataFrame:
        schema = f"{self.schema}, no bigint, kind string, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)

    def read(self, layout: dict, buckets: list[int] | None = None) -> DataFrame:
        """Current rows, of all buckets or of some. Only buckets with several layers are shuffled."""
        wanted = layout if buckets is None else [b for b in buckets if b in layout]
        columns = [c.split()[0] for c in self.schema.split(", ")]
        single = [self._folder(layout[b][0], b) for b in wanted if len(layout[b]) == 1]
        layered = [self._folder(layer, b) for b in wanted if len(layout[b]) > 1 for layer in layout[b]]
        rows = self._files(single).select(*columns)
        if layered:
            newest = Window.partitionBy(*self.keys).orderBy(F.desc("no"), F.desc("kind"))
            current = self._files(layered).withColumn("_place", F.row_number().over(newest)).where("_place = 1")
            rows = rows.unionByName(current.select(*columns))
        return rows if self.gone is None else rows.where(~F.coalesce(F.expr(self.gone), F.lit(False)))

    def _written(self, no: int, kind: str) -> dict[int, int]:
        """Rows of each bucket under a number; the counts come from the files' own statistics."""
        found = self._files([f"{self.path}/no={no}/kind={kind}"])
        return {row[0]: row[1] for row in found.groupBy("bucket").agg(F.count(F.lit(1))).collect()}

    def _write(self, rows: DataFrame, no: int, kind: str, files: int) -> dict[int, int]:
        columns = [c.split()[0] for c in self.schema.split(", ")]
        share = F.pmod(F.xxhash64(*self.keys), F.lit(files))
        rows.select(*columns, self.bucket_of().alias("bucket")).repartition("bucket", share).write.mode(
            "overwrite"
        ).partitionBy("bucket").parquet(f"{self.path}/no={no}/kind={kind}")
        return self._written(no, kind)

    def write(self, changes: DataFrame, layout: dict, no: int) -> dict:
        """Add changed rows, one for each key, under a number above all others; returns the layout with them."""
        added = self._write(changes, no, CHANGE, 1)
        new = {b: [tuple(x) for x in layers] for b, layers in layout.items()}
        fold = []
        for bucket, rows in added.items():
            layers = new[bucket] = [*new.get(bucket, []), (no, CHANGE, rows)]
            on_top = sum(x[2] for x in layers[1:])
            if len(layers) > 1 and (len(layers) > self.most_layers or on_top > FOLD_SHARE * layers[0][2]):
                fold.append(bucket)
        if fold:
            folded = self._write(self.read(new, fold), no, FOLD, self.files)
            for bucket in fold:
                new.pop(bucket)
                if bucket in folded:
                    new[bucket] = [(no, FOLD, folded[bucket])]
        return new
