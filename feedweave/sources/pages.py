"""Landed page bodies to feed records.

A page is one JSON body as the source answered it, in one of two shapes: a list of items, or a connection with
edges. Pages arrive numbered; `page_no` and the position in the page give the arrival order of the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import json_values as J
from feedweave.functions.once import compute_once
from feedweave.functions.text import is_blank, parse_instant

# Arrival numbers leave room for this many records in one page.
PAGE_STRIDE = 1_000_000


def _flag(document: Column, path: str) -> Column:
    return J.as_flag(J.node(document, path))


_text = J.text_at


def _page_failure(message: str) -> Column:
    return F.raise_error(F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(f": {message}")))


def envelope_pages(pages: DataFrame) -> DataFrame:
    """Page facts of the item shape: items as text, next cursor, has_more. A page without items fails the read."""
    parsed = pages.withColumn("_doc", J.parse(F.col("body")))
    listed = J.json_type(J.node(F.col("_doc"), "items")) == "ARRAY"
    items = F.from_json("body", "items array<string>")["items"]
    return compute_once(
        parsed,
        items=F.when(listed, items).otherwise(_page_failure("no items array").cast("array<string>")),
        next_cursor=_text(F.col("_doc"), "nextCursor"),
        has_more=_flag(F.col("_doc"), "hasMore"),
    ).select("page_no", "items", "next_cursor", "has_more")


def connection_pages(pages: DataFrame) -> DataFrame:
    """Page facts of the connection shape. Reported errors or missing edges fail the read."""
    parsed = pages.withColumn("_doc", J.parse(F.col("body")))
    doc = F.col("_doc")
    errors = J.node(doc, "errors")
    failed = F.coalesce(F.size(F.try_variant_get(errors, "$", "array<variant>")) > 0, F.lit(False))
    listed = J.json_type(J.node(doc, "data.orders.edges")) == "ARRAY"
    shape = "data struct<orders: struct<edges: array<struct<node: string>>>>"
    nodes = F.transform(F.from_json("body", shape)["data"]["orders"]["edges"], lambda edge: edge["node"])
    return compute_once(
        parsed,
        items=F.when(failed, _page_failure("the source reported errors").cast("array<string>"))
        .when(listed, nodes)
        .otherwise(_page_failure("no edges").cast("array<string>")),
        next_cursor=_text(doc, "data.orders.pageInfo.endCursor"),
        has_more=_flag(doc, "data.orders.pageInfo.hasNextPage"),
    ).select("page_no", "items", "next_cursor", "has_more")


def bounded_pages(page_facts: DataFrame, max_pages: int) -> DataFrame:
    """Pages a bounded read would have fetched: up to the first page that ends the feed, at most `max_pages`.

    Page numbers of a read are consecutive. The two bounds are one global aggregate, not a window over all pages.
    """
    ends = ~(F.col("has_more") & F.col("next_cursor").isNotNull())
    bound = page_facts.agg(
        F.least(F.min(F.when(ends, F.col("page_no"))), F.min("page_no") + max_pages - 1)
    ).scalar()
    return page_facts.where(F.col("page_no") <= bound)


def _arrival(page_no: Column, pos: Column) -> Column:
    """Number of a record in arrival order; a page too wide for the numbering fails instead of mixing with the next."""
    too_wide = F.raise_error(F.concat(F.lit("too many items on page "), page_no)).cast("bigint")
    return F.when(pos < PAGE_STRIDE, page_no * PAGE_STRIDE + pos).otherwise(too_wide).cast("bigint")


def page_records(page_facts: DataFrame, feed: str) -> DataFrame:
    """One row per item with the lifted fields; `trackable` tells whether key and clock could be lifted."""
    # The outer form: for the inner one Spark adds a filter that would parse every page body a second time.
    items = page_facts.select("page_no", F.posexplode_outer("items").alias("_pos", "payload")).where(
        F.col("_pos").isNotNull()
    )
    doc = F.col("_doc")
    lifted = (
        items.withColumn("_doc", J.parse(F.col("payload")))
        .withColumn("_key", _text(doc, "id"))
        .withColumn("_stamp", _text(doc, "updatedAt"))
        .withColumn("_clock", parse_instant(F.col("_stamp")))
    )
    return compute_once(
        lifted,
        business_key=F.col("_key"),
        source_updated_at=F.col("_clock"),
        deleted=_flag(doc, "deleted"),
        trackable=~is_blank(F.col("_key")) & F.col("_clock").isNotNull(),
    ).select(
        F.lit(feed).alias("feed"),
        "business_key",
        "source_updated_at",
        "deleted",
        "payload",
        _arrival(F.col("page_no"), F.col("_pos")).alias("arrival_seq"),
        "trackable",
    )


def untrackable_records(records: DataFrame) -> DataFrame:
    """Records without a usable key or clock. A single one fails the whole read."""
    return records.where(~F.col("trackable")).drop("trackable")


def require_trackable(records: DataFrame) -> DataFrame:
    failure = F.raise_error(F.concat(F.lit("record cannot be tracked: "), F.col("payload"))).cast("string")
    checked = F.when(F.col("trackable"), F.col("business_key")).otherwise(failure)
    return records.withColumn("business_key", checked).drop("trackable")


def read_envelope_pages(pages: DataFrame, feed: str = "customers") -> DataFrame:
    """Landed pages of the item shape as feed records in arrival order."""
    return require_trackable(page_records(envelope_pages(pages), feed))


def read_connection_pages(pages: DataFrame, feed: str = "orders") -> DataFrame:
    """Landed pages of the connection shape as feed records in arrival order."""
    return require_trackable(page_records(connection_pages(pages), feed))
