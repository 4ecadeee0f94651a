"""Where a feed keeps its tables, and how the changes of a run become visible together.

One folder per feed on shared storage, plain Parquet. A run writes every table it changes under its own run number
and then writes one row under `commits/run_no=N`. A one-row write is one file and one rename, so readers see all tables
of a run or none; what an interrupted run left behind has a number no commit names, and its retry overwrites it.
A feed has one writer at a time. The newest commit says where everything is; older ones are never opened.

Four kinds of table: keyed tables (the destination, open quarantine), of which a run reads the buckets its keys fall in
and writes the rows that changed; sets that stay small (open drift events, watermark), rewritten; pending events, which
a run adds to and a publish pass drains; and logs (runs, closed quarantine, resolved drift events, published events),
appended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.feeds import KEY_WIDTH, FeedSpec
from feedweave.operators import drift_events, outbox, quarantine, runs, watermarks
from feedweave.sinks.keyed_table import FILES_PER_BUCKET, LAYOUT, KeyedTable, newest_commit, write_commit

COMMIT = (
    "run_no bigint, run_id string, batch_id bigint, sets map<string, array<bigint>>, "
    f"tables map<string, {LAYOUT}>, last_page bigint, bucket_count int"
)
SETS = {
    "drift_open": drift_events.SCHEMA,
    "outbox_pending": outbox.SCHEMA,
    "watermark": watermarks.SCHEMA,
}
LOGS = {
    "runs": runs.SCHEMA,
    "quarantine_closed": quarantine.SCHEMA,
    "drift_resolved": drift_events.SCHEMA,
    "outbox_published": outbox.SCHEMA,
}
STATE, OPEN_QUARANTINE = "state", "quarantine_open"
DEFAULT_BUCKETS = 64
NOTHING = {
    "run_no": 0, "run_id": None, "batch_id": None, "sets": {}, "tables": {}, "last_page": None, "bucket_count": None
}


class TooWide(ValueError):
    """A destination value does not fit its column; the run fails and commits nothing."""


class FeedStore:
    """`buckets` is fixed by the first commit: a store is read and written with the count it was made with.

    Naming another count for an existing store is refused. `files` tasks write each bucket that is folded.
    """

    def __init__(
        self, spark: SparkSession, root: str, spec: FeedSpec, buckets: int | None = None, files: int = FILES_PER_BUCKET
    ):
        self.spark, self.spec = spark, spec
        self.path = f"{root}/{spec.name}"
        made_with = self.last_commit()["bucket_count"]
        if made_with is not None and buckets not in (None, made_with):
            raise ValueError(f"the store at {self.path} has {made_with} buckets, not {buckets}")
        self.buckets = made_with or buckets or DEFAULT_BUCKETS
        keyed = {
            STATE: (spec.destination.state_ddl, ["business_key"], None),
            OPEN_QUARANTINE: (quarantine.SCHEMA, quarantine.KEYS, f"status <> '{quarantine.OPEN}'"),
        }
        self.tables = {
            name: KeyedTable(spark, f"{self.path}/{name}", schema, keys, self.buckets, gone, files)
            for name, (schema, keys, gone) in keyed.items()
        }

    def work(self, name: str) -> str:
        """The folder of an intermediate result of a run. The next run replaces it, since a feed has one writer."""
        return f"{self.path}/work/{name}"

    def last_commit(self) -> dict:
        return newest_commit(self.spark, f"{self.path}/commits", COMMIT, "run_no") or dict(NOTHING)

    def has_batch(self, batch_id: int) -> bool:
        """A streaming batch that was committed before a restart is not applied again; batches are numbered upwards."""
        last = self.last_commit()["batch_id"]
        return last is not None and batch_id <= last

    def read_set(self, name: str, commit: dict | None = None) -> DataFrame:
        commit = commit or self.last_commit()
        if name in self.tables:
            return self.read_table(name, None, commit)
        parts = commit["sets"].get(name) or []
        if not parts:
            return self.spark.createDataFrame([], SETS[name])
        return self.spark.read.schema(SETS[name]).parquet(*[f"{self.path}/{name}/run_no={at}" for at in parts])

    def read_log(self, name: str, commit: dict | None = None) -> DataFrame:
        upto = (commit or self.last_commit())["run_no"]
        try:
            rows = self.spark.read.schema(f"{LOGS[name]}, run_no bigint").parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], LOGS[name])
            raise
        return rows.where(F.col("run_no") <= upto).drop("run_no")

    def bucket_of(self) -> Column:
        return self.tables[STATE].bucket_of()

    def touched(self, records: DataFrame) -> list[int]:
        """Buckets a batch falls in, the same for all keyed tables."""
        return self.tables[STATE].touched(records)

    def read_table(self, name: str, buckets: list[int] | None = None, commit: dict | None = None) -> DataFrame:
        layout = (commit or self.last_commit())["tables"].get(name) or {}
        return self.tables[name].read(layout, buckets)

    def read_state(self, buckets: list[int] | None = None, commit: dict | None = None) -> DataFrame:
        """Destination rows, of all buckets or of some."""
        return self.read_table(STATE, buckets, commit)

    def write_table(self, name: str, changes: DataFrame, run_no: int, commit: dict) -> dict:
        """Changed rows of a keyed table, one for each key; returns {name: layout} for the commit."""
        return {name: self.tables[name].write(changes, commit["tables"].get(name) or {}, run_no)}

    def check_widths(self, changes: DataFrame) -> None:
        """Fail before anything is written when a value is wider than its destination column."""
        wide = [F.length(f"content.{c}") > w for c, w in self.spec.destination.widths.items()]
        wide.append(F.length("business_key") > KEY_WIDTH)
        found = changes.where(reduce(lambda a, b: a | b, [F.coalesce(w, F.lit(False)) for w in wide]))
        row = found.select("business_key").first()
        if row is not None:
            raise TooWide(f"a value of record '{row[0]}' is too long for the destination")

    def write(self, name: str, rows: DataFrame, run_no: int) -> None:
        columns = [c.split()[0] for c in {**SETS, **LOGS}[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/run_no={run_no}")

    def commit(
        self,
        last: dict,
        run_no: int,
        run_id: str,
        batch_id: int | None = None,
        sets: dict[str, list[int]] | None = None,
        tables: dict[str, dict] | None = None,
        last_page: int | None = None,
    ) -> None:
        """Make a run visible. What is not named stays as the last commit has it."""
        kept = lambda name, value: last[name] if value is None else value
        row = (
            run_no,
            run_id,
            kept("batch_id", batch_id),
            {**last["sets"], **(sets or {})},
            {**last["tables"], **(tables or {})},
            kept("last_page", last_page),
            self.buckets,
        )
        write_commit(self.spark, f"{self.path}/commits", COMMIT, "run_no", run_no, row)


def merge_sink(store: FeedStore, changed: DataFrame, changes: DataFrame, run_no: int, last: dict) -> dict:
    """Write the destination rows that a batch changed; they become visible with the run's commit."""
    store.check_widths(changes)
    return store.write_table(STATE, changed, run_no, last)
