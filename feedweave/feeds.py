"""What the pipeline has to know about a feed. Adding a feed is adding a `FeedSpec`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from feedweave.operators.contract import CUSTOMERS, ORDERS, Contract
from feedweave.operators.destination import project_customer_row, project_order_row
from feedweave.operators.mapping import map_customer, map_order
from feedweave.sources.pages import connection_pages, envelope_pages

RECORD = (
    "feed string, business_key string, source_updated_at timestamp, deleted boolean, payload string, "
    "arrival_seq bigint"
)


@dataclass(frozen=True)
class Destination:
    """Destination columns: name -> (Spark type, widest text, published name)."""

    key_name: str
    columns: dict[str, tuple[str, int | None, str]]

    @property
    def kinds(self) -> list[tuple[str, str]]:
        return [(name, kind) for name, (kind, _, _) in self.columns.items()]

    @property
    def wire_names(self) -> dict[str, str]:
        return {name: wire for name, (_, _, wire) in self.columns.items()}

    @property
    def widths(self) -> dict[str, int]:
        return {name: width for name, (_, width, _) in self.columns.items() if width}

    @property
    def content_ddl(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in self.kinds)

    @property
    def state_ddl(self) -> str:
        return (
            f"business_key string, {self.content_ddl}, source_updated_at timestamp, content_fingerprint string, "
            "version int, deleted_at timestamp, first_synced_at timestamp, last_synced_at timestamp"
        )


@dataclass(frozen=True)
class FeedSpec:
    name: str
    protocol: str
    contract: Contract
    read_pages: Callable[[DataFrame], DataFrame]
    map_records: Callable[..., DataFrame]
    project: Callable[[Column], Column]
    destination: Destination


# Destination columns, their widths and their published names. Keys are at most 128 wide.
KEY_WIDTH = 128
CUSTOMER_DESTINATION = Destination(
    "customerKey",
    {
        "email_address": ("string", 320, "emailAddress"),
        "full_name": ("string", 200, "fullName"),
        "given_name": ("string", 100, "givenName"),
        "family_name": ("string", 100, "familyName"),
        "lifecycle_code": ("string", 1, "lifecycleCode"),
        "tier_rank": ("int", None, "tierRank"),
        "address_line": ("string", 300, "addressLine"),
        "city": ("string", 100, "city"),
        "postal_code": ("string", 20, "postalCode"),
        "country_code": ("string", 2, "countryCode"),
        "tags_csv": ("string", 500, "tagsCsv"),
        "source_created_at": ("timestamp", None, "sourceCreatedAt"),
    },
)
ORDER_DESTINATION = Destination(
    "orderKey",
    {
        "customer_key": ("string", 128, "customerKey"),
        "state_code": ("string", 3, "stateCode"),
        "total_minor": ("bigint", None, "totalMinor"),
        "currency": ("string", 3, "currency"),
        "line_count": ("int", None, "lineCount"),
        "lines_json": ("string", None, "linesJson"),
        "placed_at": ("timestamp", None, "placedAt"),
    },
)

CUSTOMER_FEED = FeedSpec(
    "customers", "REST", CUSTOMERS, envelope_pages, map_customer, project_customer_row, CUSTOMER_DESTINATION
)
ORDER_FEED = FeedSpec(
    "orders", "GraphQL", ORDERS, connection_pages, map_order, project_order_row, ORDER_DESTINATION
)
FEEDS = {spec.name: spec for spec in (CUSTOMER_FEED, ORDER_FEED)}


def feed_spec(name: str) -> FeedSpec:
    if name not in FEEDS:
        raise KeyError(f"unknown feed '{name}'")
    return FEEDS[name]


def registered_feeds(spark: SparkSession) -> DataFrame:
    """The registered feeds as a relation (feed, protocol)."""
    return spark.createDataFrame([(s.name, s.protocol) for s in FEEDS.values()], "feed string, protocol string")
