"""Reading change feeds: windows, resumable positions, pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions.ordering import number_rows

CLOCK, KEY = "source_updated_at", "business_key"
# Page size bounds of the feed and the default overlap of an incremental read.
MIN_PAGE, MAX_PAGE = 1, 500
DEFAULT_OVERLAP = timedelta(seconds=5)


def instant(value: datetime | str) -> Column:
    return F.lit(value).cast("timestamp")


def in_window(records: DataFrame, since: datetime | str | None, until: datetime | str | None) -> DataFrame:
    """Records with since < clock <= until; an absent bound is open. Literal bounds reach the file scan."""
    if since is not None:
        records = records.where(F.col(CLOCK) > instant(since))
    if until is not None:
        records = records.where(F.col(CLOCK) <= instant(until))
    return records


def change_feed_scan(
    feed: DataFrame, since: datetime | str | None = None, until: datetime | str | None = None
) -> DataFrame:
    """The feed's window in feed order (clock, key); tombstones are part of it."""
    return in_window(feed, since, until).orderBy(CLOCK, KEY)


def page_limit(limit: int, clamp: bool = False) -> int:
    if clamp:
        return max(MIN_PAGE, min(MAX_PAGE, limit))
    if not MIN_PAGE <= limit <= MAX_PAGE:
        raise ValueError(f"page size must be between {MIN_PAGE} and {MAX_PAGE}")
    return limit


def resume_after(
    feed: DataFrame,
    since: datetime | str | None,
    until: datetime | str | None,
    after: tuple[datetime | str, str] | None,
    limit: int,
    clamp: bool = False,
) -> DataFrame:
    """One page strictly after a (clock, key) position, so that equal clocks are not lost at the page edge.

    Adds `has_more` and the next position, which is null on the last page. One row more than the page is read to
    learn whether there is another page; that is a top-k, so at most 501 rows meet in one task.
    """
    limit = page_limit(limit, clamp)
    rows = in_window(feed, since, until)
    if after is not None:
        clock, key = instant(after[0]), F.lit(after[1])
        rows = rows.where((F.col(CLOCK) >= clock) & ((F.col(CLOCK) > clock) | (F.col(KEY) > key)))
    ordered = Window.orderBy(CLOCK, KEY)
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    page = (
        rows.orderBy(CLOCK, KEY)
        .limit(limit + 1)
        .withColumn("_n", F.row_number().over(ordered))
        .withColumn("has_more", F.count(F.lit(1)).over(everything) > limit)
        .where(F.col("_n") <= limit)
    )
    final = F.last(F.struct(CLOCK, KEY)).over(everything)
    return (
        page.withColumn("_next", F.when(F.col("has_more"), final))
        .withColumn("next_clock", F.col(f"_next.{CLOCK}"))
        .withColumn("next_key", F.col(f"_next.{KEY}"))
        .drop("_n", "_next")
    )


def feed_pages(feed: DataFrame, page_size: int) -> DataFrame:
    """The whole feed cut into consecutive pages: every record with its `page_no` (from 1) and `position`."""
    page_limit(page_size)
    numbered = number_rows(feed, CLOCK, KEY)
    return numbered.withColumn("page_no", F.floor((F.col("position") - 1) / page_size) + 1)


def page_index(pages: DataFrame) -> DataFrame:
    """One row per page: its size, the cursor that follows it (null on the last page) and `has_more`."""
    last_page = pages.agg(F.max("page_no")).scalar()
    per_page = pages.groupBy("page_no").agg(
        F.count(F.lit(1)).alias("records"), F.max(F.struct(CLOCK, KEY)).alias("_end")
    )
    more = F.col("page_no") < last_page
    return per_page.select(
        "page_no",
        "records",
        F.when(more, F.col(f"_end.{CLOCK}")).alias("cursor_clock"),
        F.when(more, F.col(f"_end.{KEY}")).alias("cursor_key"),
        more.alias("has_more"),
    )


def read_watermark(watermarks: DataFrame, feed: str) -> datetime | None:
    """The feed's high-water clock; one row per feed."""
    row = watermarks.where(F.col("feed") == feed).select("watermark_ts").first()
    return None if row is None else row[0]


def incremental_window(
    records: DataFrame, watermark: datetime | None, overlap: timedelta = DEFAULT_OVERLAP
) -> DataFrame:
    """Records of the next incremental read of one feed: from watermark - overlap, open ended.

    Without a watermark everything is read. The key stored with the watermark is not part of the window.
    """
    return in_window(records, None if watermark is None else watermark - overlap, None)


def incremental_windows(
    records: DataFrame, watermarks: DataFrame, overlap: timedelta = DEFAULT_OVERLAP
) -> DataFrame:
    """The same for many feeds at once; the watermark table has one row per registered feed."""
    marks = watermarks.select("feed", F.col("watermark_ts").alias("_mark"))
    seconds = F.make_dt_interval(secs=F.lit(overlap.total_seconds()))
    return (
        records.join(F.broadcast(marks), "feed", "left")
        .where(F.col("_mark").isNull() | (F.col(CLOCK) > F.col("_mark") - seconds))
        .drop("_mark")
    )
