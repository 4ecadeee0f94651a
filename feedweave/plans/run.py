"""Whole runs of one feed: incremental, backfill, replay, and the publish pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.feeds import FeedSpec
from feedweave.operators import drift_events as E
from feedweave.operators import outbox as O
from feedweave.operators import quarantine as Q
from feedweave.operators import runs as R
from feedweave.operators import watermarks as W
from feedweave.plans.process import changes_of, check_records, keep_checked, process_batch
from feedweave.session import materialize, shared_folder, stored
from feedweave.sinks.store import LOGS, OPEN_QUARANTINE, FeedStore, merge_sink
from feedweave.sources.change_feed import DEFAULT_OVERLAP, in_window, incremental_window, read_watermark
from feedweave.sources.pages import bounded_pages, page_records, require_trackable

# Run modes and triggers.
INCREMENTAL, BACKFILL, REPLAY = "INCREMENTAL", "BACKFILL", "REPLAY"
SCHEDULED, MANUAL = "SCHEDULED", "MANUAL"


def _clock() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class FeedRunner:
    """Runs a feed against its store. Every run ends with a row in the run log, failed ones included.

    A failed run commits nothing but that row: the watermark stays, the next run reads the same window again, and the
    merge makes that harmless.
    """

    def __init__(self, spec: FeedSpec, store: FeedStore, clock: Callable[[], datetime] = _clock):
        self.spec, self.store, self.clock = spec, store, clock
        self.spark = store.spark

    def records_of(self, pages: DataFrame) -> DataFrame:
        """All landed pages (page_no, body) of one read as feed records.

        Kept, since a run looks at its records more than once and the page bodies should be parsed once.
        """
        return materialize(require_trackable(page_records(self.spec.read_pages(pages), self.spec.name)))

    def run_incremental(
        self,
        feed: DataFrame,
        trigger: str = SCHEDULED,
        overlap: timedelta = DEFAULT_OVERLAP,
    ) -> dict:
        """Read from watermark - overlap on, process, and move the watermark forward."""
        mark = read_watermark(self.store.read_set("watermark"), self.spec.name)
        run = self._start(INCREMENTAL, trigger, mark)
        return self._execute(run, lambda: incremental_window(feed, mark, overlap))

    def run_pages(self, pages: DataFrame, batch_id: int | None = None, trigger: str = SCHEDULED) -> dict:
        """Process landed pages, which already are the part of the feed to process; as one batch of a stream or alone."""
        mark = read_watermark(self.store.read_set("watermark"), self.spec.name)
        run = self._start(INCREMENTAL, trigger, mark)
        return self._execute(run, lambda: self.records_of(pages), batch_id=batch_id)

    def run_next_pages(self, pages: DataFrame, most: int, trigger: str = SCHEDULED) -> dict:
        """Process at most `most` of the landed pages that no such run has read yet, as far as the feed goes.

        The last page read is part of the run's commit, so the next run takes up the read there, and a failed run
        leaves it where it was. Pages of a feed are numbered upwards.
        """
        if most < 1:
            raise ValueError("a run must be allowed to read a page")
        reached = self.store.last_commit()["last_page"]
        rest = pages if reached is None else pages.where(F.col("page_no") > reached)
        mark = read_watermark(self.store.read_set("watermark"), self.spec.name)
        run = self._start(INCREMENTAL, trigger, mark)
        # Page bodies are parsed once for the bounds, and again only for the pages inside.
        facts = materialize(self.spec.read_pages(rest).select("page_no", "next_cursor", "has_more"))
        last_page = bounded_pages(facts, most).agg(F.max("page_no")).first()[0]
        due = rest.where(F.col("page_no") <= (reached or 0) if last_page is None else F.col("page_no") <= last_page)
        return self._execute(run, lambda: self.records_of(due), last_page=last_page)

    def run_backfill(self, feed: DataFrame, start: datetime, end: datetime, trigger: str = MANUAL) -> dict:
        """Read (start, end] again; the watermark does not move."""
        if end < start:
            raise ValueError("backfill window end must not be before its start")
        mark = read_watermark(self.store.read_set("watermark"), self.spec.name)
        run = self._start(BACKFILL, trigger, mark) | {"backfill_from": start, "backfill_to": end}
        return self._execute(run, lambda: in_window(feed, start, end))

    def replay(self, ids: DataFrame) -> dict:
        """Send open quarantined records (quarantine_id) through the pipeline once more; others are refused."""
        open_rows = self.store.read_set("quarantine_open")
        everything = open_rows.unionByName(self.store.read_log("quarantine_closed"))
        refused = Q.not_replayable(everything, ids).first()
        if refused is not None:
            raise ValueError(f"quarantined record {refused[0]} is {refused[1]}, only OPEN records can be replayed")
        mark = read_watermark(self.store.read_set("watermark"), self.spec.name)
        run = self._start(REPLAY, MANUAL, mark)
        records = Q.quarantine_replay(open_rows, ids, run["started_at"]).drop("quarantine_id")
        return self._execute(run, lambda: records, replayed=ids)

    def _start(self, mode: str, trigger: str, mark: datetime | None) -> dict:
        last = self.store.last_commit()
        run_no = last["run_no"] + 1
        return dict.fromkeys(R.COLUMNS) | {
            "run_id": f"{self.spec.name}-{run_no}",
            "feed": self.spec.name,
            "mode": mode,
            "trigger_type": trigger,
            "status": R.RUNNING,
            "started_at": self.clock(),
            "watermark_before": mark,
            "watermark_after": mark,
            "drift_detected": False,
            **dict.fromkeys(R.COUNTERS, 0),
        }

    def _execute(
        self,
        run: dict,
        read: Callable[[], DataFrame],
        batch_id: int | None = None,
        replayed: DataFrame | None = None,
        last_page: int | None = None,
    ) -> dict:
        last = self.store.last_commit()
        run_no = last["run_no"] + 1
        sets, tables = {}, {}
        try:
            checked = keep_checked(check_records(read(), self.spec, repeats=replayed is None), self.store.work("checked"))
            outcome = self._process(run, checked, last)
            counters = outcome.counters.drop("run_id", "feed").first()
            if counters is not None:
                run |= counters.asDict()
            run["status"] = R.PARTIAL if run["quarantined"] else R.SUCCEEDED
            run["finished_at"] = self.clock()
            tables = merge_sink(self.store, outcome.changed, changes_of(checked), run_no, last)
            tables |= self._write_lifecycle(run, outcome, last, run_no, replayed)
            sets = {"drift_open": [run_no], "outbox_pending": [*(last["sets"].get("outbox_pending") or []), run_no]}
            if run["mode"] == INCREMENTAL and run["extracted"] > 0:
                self._move_watermark(run, checked, last, run_no)
                sets["watermark"] = [run_no]
        except Exception as failure:  # whatever it was, the run must be closed in the log
            run |= {"status": R.FAILED, "error_message": str(failure)[: R.ERROR_WIDTH], "finished_at": self.clock()}
            # Nothing of a failed run becomes visible, so it has loaded nothing either.
            run |= dict.fromkeys(R.COUNTERS, 0) | {"drift_detected": False, "max_lag_seconds": None}
            run["watermark_after"] = run["watermark_before"]
            sets, tables, batch_id, last_page = {}, {}, None, None
        self.store.write("runs", self.spark.createDataFrame([tuple(run[c] for c in R.COLUMNS)], R.SCHEMA), run_no)
        if run["status"] == R.FAILED:
            # The logs of a failed run may hold rows already; empty them, since the commit makes this number visible.
            for name in ("quarantine_closed", "drift_resolved"):
                self.store.write(name, self.spark.createDataFrame([], LOGS[name]), run_no)
        self.store.commit(last, run_no, run["run_id"], batch_id, sets, tables, last_page)
        return run

    def _process(self, run: dict, checked: DataFrame, last: dict):
        touched = self.store.touched(checked)
        return process_batch(
            checked,
            self.spec,
            self.store.read_state(touched, last),
            self.store.read_table(OPEN_QUARANTINE, touched, last),
            self.store.read_set("drift_open", last),
            run["run_id"],
            run["started_at"],
            keep=lambda df, name: stored(df, self.store.work(name)),
        )

    def _write_lifecycle(self, run: dict, outcome, last: dict, run_no: int, replayed: DataFrame | None) -> dict:
        """Write what the run did to quarantine, drift events and outbox; returns the layout of open quarantine."""
        now = run["started_at"]
        episodes = stored(outcome.quarantine, self.store.work("quarantine"))
        if replayed is not None:
            passed = outcome.results.select("business_key").distinct()
            done = episodes.join(replayed.select("quarantine_id"), "quarantine_id", "left_semi").join(
                passed, "business_key", "left_semi"
            )
            note = f"replayed in run {run['run_id']}"
            episodes = Q.quarantine_mark_replayed(episodes, done.select("quarantine_id"), note, now)
        self.store.write("quarantine_closed", episodes.where(F.col("status") != Q.OPEN), run_no)
        drift = E.clean_backfill_resolution(outcome.drift, run, now)
        self.store.write("drift_open", drift.where(F.col("status") == E.OPEN), run_no)
        self.store.write("drift_resolved", drift.where(F.col("status") != E.OPEN), run_no)
        # Added to what is pending; a publish pass drains all parts.
        self.store.write("outbox_pending", O.pending_rows(outcome.events), run_no)
        return self.store.write_table(OPEN_QUARANTINE, Q.changed_rows(episodes), run_no, last)

    def _move_watermark(self, run: dict, checked: DataFrame, last: dict, run_no: int) -> None:
        held = self.store.read_set("watermark", last)
        moved = W.advance_watermark(held, W.newest_watermark(checked), run["started_at"])
        self.store.write("watermark", moved, run_no)
        run["watermark_after"] = moved.select("watermark_ts").first()[0]

    def publish(self, transport: Callable[[DataFrame], DataFrame], batch: int = O.PUBLISH_BATCH) -> DataFrame:
        """One publish pass. `transport` gets the events that are due and answers (event_id, ok, error).

        Events are handed over in publish order, one batch at a time, and inside a batch one event of each key at a
        time: the next event of a key goes out once the one before has arrived. A key that fails gets nothing more,
        and after a batch with a failure no further batch starts. Answers are kept before anything is decided, so the
        transport is called once for what it gets. The global order makes this one job for each turn of each batch;
        `publish_all` is the way for a large outbox.
        """
        last = self.store.last_commit()
        pending = self.store.read_set("outbox_pending", last)
        answers = self._hand_over(pending, transport, batch)
        return self._published(last, O.outbox_publish_pass(pending, answers, self.clock(), batch))

    def publish_all(
        self, send: Callable[[pa.Table], Sequence[str | None]], limit: int | None = None
    ) -> DataFrame:
        """One publish pass over the whole outbox, delivered by tasks; the order that holds is each key's own.

        `send` runs inside tasks: it gets a table with at most one event of a key and returns for each event null, or
        why it did not arrive. Keys are dealt over tasks and their events sorted, so all keys go out at once, and a key
        whose event fails gets nothing more in this pass, while others go on. The events of a key with more than `limit`
        (rows_per_group) of them are handed over in as many rounds as it has stretches of that length, so no task has
        more of a key. Answers are kept before anything is decided. At least once: a task that is lost and run again
        sends its events again.
        """
        last = self.store.last_commit()
        pending = self.store.read_set("outbox_pending", last)
        return self._published(last, O.outbox_publish_by_key(pending, O.delivered(pending, send, limit), self.clock()))

    def _published(self, last: dict, decided: DataFrame) -> DataFrame:
        """Keep the outcome of a pass: what is left is pending, the rest is in the log."""
        run_no = last["run_no"] + 1
        passed = materialize(decided)
        self.store.write("outbox_pending", passed.where(F.col("published_at").isNull()), run_no)
        self.store.write("outbox_published", passed.where(F.col("published_at").isNotNull()), run_no)
        self.store.commit(last, run_no, last["run_id"], sets={"outbox_pending": [run_no]})
        return passed

    def _hand_over(self, pending: DataFrame, transport: Callable[[DataFrame], DataFrame], batch: int) -> DataFrame:
        keys = ["feed", "business_key"]
        queue = O.publish_queue(pending, batch)
        folder = f"{shared_folder(self.spark)}/publish-{uuid4().hex}"
        kept = self.spark.createDataFrame([], O.ANSWER)
        kept.write.parquet(folder)
        for number in range(queue.agg(F.max("_batch")).first()[0] or 0):
            due = queue.where(F.col("_batch") == number + 1)
            # Of one batch, so at most `batch` keys.
            stopped: list[tuple] = []
            for turn in range(due.agg(F.max("_turn")).first()[0]):
                now = due.where(F.col("_turn") == turn + 1)
                if stopped:
                    now = now.join(F.broadcast(self.spark.createDataFrame(stopped, "feed string, business_key string")), keys, "left_anti")
                now = materialize(now)
                answered = materialize(transport(now.drop("_position", "_batch", "_turn")).select("event_id", "ok", "error"))
                answered.write.mode("append").parquet(folder)
                arrived = answered.where("ok").select("event_id")
                stopped += [tuple(r) for r in now.join(arrived, "event_id", "left_anti").select(*keys).collect()]
            if stopped:
                break
        return self.spark.read.schema(O.ANSWER).parquet(folder)

    def discard(self, decisions: DataFrame) -> DataFrame:
        """Discard open quarantined records (quarantine_id, note); returns the decisions about unknown records."""
        last = self.store.last_commit()
        run_no = last["run_no"] + 1
        open_rows = self.store.read_set("quarantine_open", last)
        known = open_rows.unionByName(self.store.read_log("quarantine_closed", last))
        unknown = materialize(Q.unknown_ids(known, decisions))
        decided = Q.quarantine_discard(open_rows, decisions, self.clock())
        closed = materialize(decided.where(F.col("status") != Q.OPEN))
        self.store.write("quarantine_closed", closed, run_no)
        self.store.commit(last, run_no, last["run_id"], tables=self.store.write_table(OPEN_QUARANTINE, closed, run_no, last))
        return unknown

    def resolve_drift(self, decisions: DataFrame) -> None:
        """Resolve open drift events (event_id, note)."""
        last = self.store.last_commit()
        run_no = last["run_no"] + 1
        decided = E.drift_event_resolve(self.store.read_set("drift_open", last), decisions, self.clock())
        self.store.write("drift_open", decided.where(F.col("status") == E.OPEN), run_no)
        self.store.write("drift_resolved", decided.where(F.col("status") != E.OPEN), run_no)
        self.store.commit(last, run_no, last["run_id"], sets={"drift_open": [run_no]})

