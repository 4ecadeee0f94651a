"""Canonical records to flat destination rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions.text import format_instant
from feedweave.operators.mapping import TIERS

# The codes the destination stores.
LIFECYCLE_CODES = {"ACTIVE": "A", "INACTIVE": "I", "CHURNED": "C"}
STATE_CODES = {"PENDING": "PEN", "PAID": "PAI", "SHIPPED": "SHP", "DELIVERED": "DLV", "CANCELLED": "CAN"}


def _lookup(value: Column, codes: dict) -> Column:
    branches = [(F.lit(k), F.lit(v)) for k, v in codes.items()]
    (first, code), *rest = branches
    found = F.when(value == first, code)
    for key, code in rest:
        found = found.when(value == key, code)
    return found


def project_customer_row(canonical: Column) -> Column:
    """The business columns of a destination customer; key and version clock are kept beside it."""
    c, address = canonical, canonical["address"]
    return F.when(
        canonical.isNotNull(),
        F.struct(
            c["email"].alias("email_address"),
            F.concat_ws(" ", c["given_name"], c["family_name"]).alias("full_name"),
            c["given_name"].alias("given_name"),
            c["family_name"].alias("family_name"),
            _lookup(c["lifecycle"], LIFECYCLE_CODES).alias("lifecycle_code"),
            _lookup(c["tier"], {tier: rank for rank, tier in enumerate(TIERS, 1)}).alias("tier_rank"),
            address["street"].alias("address_line"),
            address["city"].alias("city"),
            address["postal_code"].alias("postal_code"),
            address["country_code"].alias("country_code"),
            F.array_join(F.array_sort(c["tags"]), ",").alias("tags_csv"),
            c["created_at"].alias("source_created_at"),
        ),
    )


def project_order_row(canonical: Column) -> Column:
    """The business columns of a destination order."""
    c = canonical
    lines = F.transform(
        c["lines"],
        lambda line: F.struct(
            line["sku"].alias("sku"), line["quantity"].alias("qty"), line["unit_price_minor"].alias("unitMinor")
        ),
    )
    return F.when(
        canonical.isNotNull(),
        F.struct(
            c["customer_key"].alias("customer_key"),
            _lookup(c["state"], STATE_CODES).alias("state_code"),
            c["total"]["amount_minor"].alias("total_minor"),
            c["total"]["currency"].alias("currency"),
            F.size(c["lines"]).alias("line_count"),
            F.to_json(lines).alias("lines_json"),
            c["placed_at"].alias("placed_at"),
        ),
    )


def content_fingerprint(row: Column, columns: list[tuple[str, str]]) -> Column:
    """SHA-256 of the business columns joined by a pipe, in column order; key and version clock do not count.

    `columns` gives name and Spark type of each business column; instants are hashed as ISO text.
    """
    parts = [
        format_instant(row[name]) if kind == "timestamp" else row[name].cast("string") for name, kind in columns
    ]
    return F.when(row.isNotNull(), F.sha2(F.concat_ws("|", *parts), 256))


def customer_tier_view(customers: DataFrame) -> DataFrame:
    """Destination customers with the tier name restored from its rank, clamped to the known ranks."""
    rank = F.greatest(F.lit(1), F.least(F.lit(len(TIERS)), F.col("tier_rank")))
    return customers.withColumn("tier", F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank))
