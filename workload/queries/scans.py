"""Scans, windows, pages."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.operators.watermarks import newest_watermark
from feedweave.session import materialize
from feedweave.sources import change_feed as S
from feedweave.sources import pages as P
from workload.derived import derived, derived_sql

SINCE, UNTIL = "2024-01-10 00:00:00", "2024-01-20 00:00:00"
AFTER = ("2024-01-12 07:30:00", "50")
MARK_UNTIL = "2024-01-15 12:00:00"
OVERLAP = timedelta(hours=1)
PAGE = 100


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "feed", "business_key", F.unix_micros("source_updated_at").alias("clock_us"), "deleted", "arrival_seq"
    )


SHOWN = "feed, business_key, epoch_us(source_updated_at) AS clock_us, deleted, arrival_seq"
EVENTS = f"WITH feed AS ({derived_sql('event_feed')})"


def change_feed_scan(spark, sf_dir):
    return _shown(S.change_feed_scan(derived(spark, sf_dir, "event_feed"), SINCE, UNTIL))


def resume_after(spark, sf_dir):
    page = S.resume_after(derived(spark, sf_dir, "event_feed"), SINCE, UNTIL, AFTER, PAGE)
    return page.select(
        "feed",
        "business_key",
        F.unix_micros("source_updated_at").alias("clock_us"),
        "deleted",
        "arrival_seq",
        "has_more",
        F.unix_micros("next_clock").alias("next_clock_us"),
        "next_key",
    )


def feed_pages(spark, sf_dir):
    index = S.page_index(S.feed_pages(derived(spark, sf_dir, "event_feed"), PAGE))
    return index.select(
        "page_no", "records", F.unix_micros("cursor_clock").alias("cursor_clock_us"), "cursor_key", "has_more"
    )


def landed_pages(feed: DataFrame, connection: bool = False, endless: bool = False) -> DataFrame:
    """The feed as landed page bodies of 100 records: a page is a group of a fixed size, whatever the keys are.

    Some pages say that the feed ends with them, unless it is endless.
    """
    numbered = feed.select(F.expr(f"arrival_seq div {PAGE} + 1").alias("page_no"), "arrival_seq", "payload")
    item = F.concat(F.lit('{"node":'), F.col("payload"), F.lit("}")) if connection else F.col("payload")
    grouped = numbered.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("arrival_seq", item.alias("p")))).alias("i"))
    listed = F.array_join(F.transform("i", lambda i: i["p"]), ",")
    cursor = F.when(F.col("page_no") % 97 == 60, F.lit("null")).otherwise(F.concat(F.lit('"c'), F.col("page_no"), F.lit('"')))
    if endless:
        cursor = F.concat(F.lit('"c'), F.col("page_no"), F.lit('"'))
    more = F.when((F.col("page_no") % 89 == 75) & F.lit(not endless), F.lit("false")).otherwise(F.lit("true"))
    if connection:
        body = F.concat(
            F.lit('{"data":{"orders":{"edges":['), listed, F.lit('],"pageInfo":{"endCursor":'), cursor,
            F.lit(',"hasNextPage":'), more, F.lit("}}}}"),
        )
    else:
        body = F.concat(F.lit('{"items":['), listed, F.lit('],"nextCursor":'), cursor, F.lit(',"hasMore":'), more, F.lit("}"))
    return grouped.select("page_no", body.alias("body"))


def read_envelope_pages(spark, sf_dir):
    records = P.read_envelope_pages(landed_pages(derived(spark, sf_dir, "customer_feed")))
    return records.select(
        "feed", "business_key", F.unix_micros("source_updated_at").alias("clock_us"), "deleted", "arrival_seq", "payload"
    )


def read_connection_pages(spark, sf_dir):
    records = P.read_connection_pages(landed_pages(derived(spark, sf_dir, "order_feed"), connection=True))
    return records.select(
        "feed",
        "business_key",
        F.unix_micros("source_updated_at").alias("clock_us"),
        "deleted",
        "arrival_seq",
        "payload",
    )


ARRIVAL = (
    f"(arrival_seq // {PAGE} + 1) * 1000000 + row_number() OVER (PARTITION BY arrival_seq // {PAGE} "
    "ORDER BY arrival_seq) - 1 AS arrival_seq"
)
# Four ways to make a record untrackable, spread over the feed by its flaw number.
UNTRACKABLE = """
SELECT feed, arrival_seq, CASE flaw WHEN 3 THEN replace(payload, '"id":', '"ident":')
    WHEN 5 THEN replace(payload, '"id":"', '"id":"  ","was":"') WHEN 7 THEN replace(payload, '"updatedAt":"', '"updatedAt":"at ')
    WHEN 9 THEN replace(payload, '"updatedAt":', '"changed":') ELSE payload END AS payload, flaw
FROM {feed}
"""


def untrackable_records(spark, sf_dir):
    feed = spark.sql(UNTRACKABLE, feed=derived(spark, sf_dir, "customer_feed"))
    records = P.page_records(P.envelope_pages(landed_pages(feed)), "customers")
    return P.untrackable_records(records).select("business_key", F.unix_micros("source_updated_at").alias("clock_us"), "payload")


def bounded_pages(spark, sf_dir):
    facts = P.envelope_pages(landed_pages(derived(spark, sf_dir, "customer_feed")))
    return P.bounded_pages(facts, 70).select("page_no", F.size("items").cast("bigint").alias("records"), "next_cursor", "has_more")


def _feeds(spark, sf_dir) -> DataFrame:
    columns = ["feed", "business_key", "source_updated_at", "deleted", "arrival_seq"]
    feeds = [derived(spark, sf_dir, f"{name}_feed").select(*columns) for name in ("customer", "order", "event")]
    return feeds[0].unionByName(feeds[1]).unionByName(feeds[2])


def _marks(spark, sf_dir) -> DataFrame:
    """Marks left by earlier reads of the event and the order feed; the customer feed was never read."""
    orders = S.in_window(derived(spark, sf_dir, "order_feed"), None, "1998-06-01 00:00:00")
    events = S.in_window(derived(spark, sf_dir, "event_feed"), None, MARK_UNTIL)
    columns = ["feed", "business_key", "source_updated_at"]
    return newest_watermark(orders.select(*columns).unionByName(events.select(*columns)))


def read_watermark(spark, sf_dir):
    marks = materialize(_marks(spark, sf_dir))
    read = [(feed, S.read_watermark(marks, feed)) for feed in ("customers", "events", "orders")]
    return spark.createDataFrame(read, "feed string, mark timestamp").select("feed", F.unix_micros("mark").alias("watermark_us"))


def incremental_window(spark, sf_dir):
    feed = derived(spark, sf_dir, "event_feed")
    mark = S.read_watermark(newest_watermark(S.in_window(feed, None, MARK_UNTIL)), "events")
    return _shown(S.incremental_window(feed, mark, OVERLAP))


def incremental_windows(spark, sf_dir):
    return _shown(S.incremental_windows(_feeds(spark, sf_dir), _marks(spark, sf_dir), OVERLAP))


MARKS_SQL = f"""
marks AS (
  SELECT feed, source_updated_at AS mark, business_key AS mark_key
  FROM (SELECT feed, business_key, source_updated_at FROM orders_feed WHERE source_updated_at <= TIMESTAMP '1998-06-01 00:00:00'
        UNION ALL
        SELECT feed, business_key, source_updated_at FROM events_feed WHERE source_updated_at <= TIMESTAMP '{MARK_UNTIL}') AS r
  QUALIFY row_number() OVER (PARTITION BY feed ORDER BY source_updated_at DESC, business_key DESC) = 1
)"""
ALL_FEEDS = f"""WITH customers_feed AS ({derived_sql('customer_feed')}), orders_feed AS ({derived_sql('order_feed')}),
events_feed AS ({derived_sql('event_feed')}), {MARKS_SQL}"""


QUERIES = {
    "change_feed_scan": change_feed_scan,
    "resume_after": resume_after,
    "feed_pages": feed_pages,
    "read_envelope_pages": read_envelope_pages,
    "read_connection_pages": read_connection_pages,
    "untrackable_records": untrackable_records,
    "bounded_pages": bounded_pages,
    "read_watermark": read_watermark,
    "incremental_window": incremental_window,
    "incremental_windows": incremental_windows,
}

ORACLES = {
    "change_feed_scan": f"""{EVENTS} SELECT {SHOWN} FROM feed
        WHERE source_updated_at > TIMESTAMP '{SINCE}' AND source_updated_at <= TIMESTAMP '{UNTIL}'""",
    "resume_after": f"""{EVENTS}, rest AS (
        SELECT *, row_number() OVER (ORDER BY source_updated_at, business_key) AS n, count(*) OVER () AS rows_left FROM feed
        WHERE source_updated_at > TIMESTAMP '{SINCE}' AND source_updated_at <= TIMESTAMP '{UNTIL}'
          AND (source_updated_at, business_key) > (TIMESTAMP '{AFTER[0]}', '{AFTER[1]}'))
        SELECT {SHOWN}, rows_left > {PAGE} AS has_more,
          CASE WHEN rows_left > {PAGE} THEN (SELECT epoch_us(source_updated_at) FROM rest WHERE n = {PAGE}) END AS next_clock_us,
          CASE WHEN rows_left > {PAGE} THEN (SELECT business_key FROM rest WHERE n = {PAGE}) END AS next_key
        FROM rest WHERE n <= {PAGE}""",
    "feed_pages": f"""{EVENTS}, numbered AS (
        SELECT *, row_number() OVER (ORDER BY source_updated_at, business_key) AS n, count(*) OVER () AS total FROM feed)
        SELECT (n - 1) // {PAGE} + 1 AS page_no, count(*) AS records, max(n) < max(total) AS has_more,
          CASE WHEN max(n) < max(total) THEN epoch_us(max(source_updated_at)) END AS cursor_clock_us,
          CASE WHEN max(n) < max(total) THEN arg_max(business_key, n) END AS cursor_key
        FROM numbered GROUP BY 1""",
    "read_envelope_pages": f"""WITH feed AS ({derived_sql('customer_feed')})
        SELECT feed, business_key, epoch_us(source_updated_at) AS clock_us, deleted, {ARRIVAL}, payload FROM feed""",
    "read_connection_pages": f"""WITH feed AS ({derived_sql('order_feed')})
        SELECT feed, business_key, epoch_us(source_updated_at) AS clock_us, deleted, {ARRIVAL},
          regexp_replace(payload, '("[a-zA-Z]+":[0-9]+[.][0-9]+?)0+([,}}])', '\\1\\2', 'g') AS payload FROM feed""",
    "untrackable_records": f"""WITH feed AS ({derived_sql('customer_feed')}), broken AS ({UNTRACKABLE.format(feed='feed')}),
        lifted AS (SELECT payload, json_extract_string(payload, '$.id') AS business_key,
          json_extract_string(payload, '$.updatedAt') AS stamp FROM broken)
        SELECT business_key, CASE WHEN stamp NOT LIKE 'at %' THEN epoch_us(CAST(replace(replace(stamp, 'T', ' '), 'Z', '') AS TIMESTAMP)) END AS clock_us,
          payload
        FROM lifted WHERE business_key IS NULL OR trim(business_key) = '' OR stamp IS NULL OR stamp LIKE 'at %'""",
    "bounded_pages": f"""WITH feed AS ({derived_sql('customer_feed')}), facts AS (
        SELECT arrival_seq // {PAGE} + 1 AS page_no, count(*) AS records FROM feed GROUP BY 1),
        shown AS (SELECT page_no, records, CASE WHEN page_no % 97 = 60 THEN NULL ELSE 'c' || page_no END AS next_cursor,
          page_no % 89 <> 75 AS has_more FROM facts),
        fetched AS (SELECT *, coalesce(bool_and(has_more AND next_cursor IS NOT NULL)
            OVER (ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS reached,
          row_number() OVER (ORDER BY page_no) AS n FROM shown)
        SELECT page_no, records, next_cursor, has_more FROM fetched WHERE reached AND n <= 70""",
    "read_watermark": f"""{ALL_FEEDS} SELECT feed, epoch_us(mark) AS watermark_us
        FROM (VALUES ('customers'), ('events'), ('orders')) AS f(feed) LEFT JOIN marks USING (feed)""",
    "incremental_window": f"""{EVENTS} SELECT {SHOWN} FROM feed WHERE source_updated_at >
        (SELECT max(source_updated_at) FROM feed WHERE source_updated_at <= TIMESTAMP '{MARK_UNTIL}') - INTERVAL 1 HOUR""",
    "incremental_windows": f"""{ALL_FEEDS}, everything AS (
        SELECT feed, business_key, source_updated_at, deleted, arrival_seq FROM customers_feed UNION ALL
        SELECT feed, business_key, source_updated_at, deleted, arrival_seq FROM orders_feed UNION ALL
        SELECT feed, business_key, source_updated_at, deleted, arrival_seq FROM events_feed)
        SELECT {SHOWN} FROM everything LEFT JOIN marks USING (feed)
        WHERE mark IS NULL OR source_updated_at > mark - INTERVAL 1 HOUR""",
}
