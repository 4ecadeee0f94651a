"""The same pipeline on a stream of landed pages, and stream consumers of change events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedweave.operators.outbox import consume_dedup, consume_if_newer
from feedweave.operators.runs import FAILED
from feedweave.plans.run import FeedRunner
from feedweave.session import materialize
from feedweave.sinks.keyed_table import LAYOUT, KeyedTable, newest_commit, write_commit
from feedweave.sinks.store import DEFAULT_BUCKETS

PAGE = "page_no bigint, body string"
VERSIONS = "feed string, business_key string, version int"
SEEN = f"layout {LAYOUT}, buckets int"


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Landed pages as a stream: JSON files with one page per line."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def follow_feed(runner: FeedRunner, pages: DataFrame, checkpoint: str) -> StreamingQuery:
    """Process landed pages batch by batch until none are left.

    The destination table is the state of the stream, so late records are classified against it and never dropped.
    A batch that was committed before a restart is skipped; a batch that failed is logged and stops the stream, so
    that the restart takes it up again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if runner.store.has_batch(batch_id):
            return
        run = runner.run_pages(batch, batch_id)
        if run["status"] == FAILED:
            raise RuntimeError(f"run {run['run_id']} failed: {run['error_message']}")

    return _follow(pages, apply, checkpoint)


class Seen:
    """What a consumer has seen, as a keyed table with a commit for each batch.

    A batch reads the buckets its keys fall in and writes the rows that are new, so its work follows the batch and not
    the batches before it. A batch that is run again sees what the batches before it left and writes its own anew.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int):
        self.spark, self.folder = spark, f"{folder}/commits"
        self.table = KeyedTable(spark, f"{folder}/rows", schema, keys, buckets)

    def before(self, batch_id: int) -> dict:
        """The layout that the batches before this one left."""
        commit = newest_commit(self.spark, self.folder, SEEN, "batch", below=batch_id)
        if commit is None:
            return {}
        if commit["buckets"] != self.table.buckets:
            raise ValueError(f"what was seen is kept in {commit['buckets']} buckets, not {self.table.buckets}")
        return commit["layout"]

    def rows_for(self, batch: DataFrame, layout: dict) -> DataFrame:
        return self.table.read(layout, self.table.touched(batch))

    def add(self, rows: DataFrame, layout: dict, batch_id: int) -> None:
        """Rows of keys that are new or have moved on, one for each key."""
        row = (self.table.write(rows, layout, batch_id), self.table.buckets)
        write_commit(self.spark, self.folder, SEEN, "batch", batch_id, row)


def consume_if_newer_stream(
    events: DataFrame,
    seen: str,
    deliver: Callable[[DataFrame, int], None],
    checkpoint: str,
    buckets: int = DEFAULT_BUCKETS,
) -> StreamingQuery:
    """Consumer side on a stream: hand on an event only if its version is above all its key has brought so far.

    `events` have `delivery_seq`. The highest version of each key is kept under `seen`, a folder on shared storage, so
    an event may arrive as late as it likes: it is dropped only if its key is already further. `deliver` gets the
    batch's number, so that a batch that is run again can overwrite what it wrote.
    """
    spark = events.sparkSession
    index = Seen(spark, seen, VERSIONS, ["feed", "business_key"], buckets)

    def apply(batch: DataFrame, batch_id: int) -> None:
        layout = index.before(batch_id)
        newer = materialize(consume_if_newer(batch, index.rows_for(batch, layout)))
        deliver(newer, batch_id)
        index.add(newer.groupBy("feed", "business_key").agg(F.max("version").alias("version")), layout, batch_id)

    return _follow(events, apply, checkpoint)


def consume_dedup_stream(
    events: DataFrame,
    seen: str,
    deliver: Callable[[DataFrame, int], None],
    checkpoint: str,
    recent: str = "1 hour",
    buckets: int = DEFAULT_BUCKETS,
) -> StreamingQuery:
    """Consumer side on a stream: hand on each event once, however late it comes again.

    Repeats within `recent` of the first delivery end in Spark's own keyed state, which forgets an id after that time;
    most repeats never leave it. Ids that come again later are looked up in the table of all ids under `seen`. The
    state goes by the time of arrival, not by a time in the event: nothing arrives behind that watermark, so nothing is
    dropped for its age.
    """
    spark = events.sparkSession
    index = Seen(spark, seen, "event_id string", ["event_id"], buckets)
    arrived = events.withColumn("_arrived_at", F.current_timestamp()).withWatermark("_arrived_at", recent)
    once = arrived.dropDuplicatesWithinWatermark(["event_id"]).drop("_arrived_at")

    def apply(batch: DataFrame, batch_id: int) -> None:
        layout = index.before(batch_id)
        held = index.rows_for(batch, layout)
        new = materialize(consume_dedup(batch).join(held, "event_id", "left_anti").select(*events.columns))
        deliver(new, batch_id)
        index.add(new.select("event_id"), layout, batch_id)

    return _follow(once, apply, checkpoint)


def _follow(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Batch by batch until nothing is left."""
    return (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
