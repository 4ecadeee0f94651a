"""Declared payload contracts of the feeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    path: str
    type: str
    required: bool
    allowed: tuple[str, ...] | None = None

    @property
    def parent(self) -> str:
        return self.path.rpartition(".")[0]

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]


@dataclass(frozen=True)
class Contract:
    feed: str
    fields: tuple[Field, ...]

    def children(self, parent: str) -> list[Field]:
        """Fields declared directly below `parent`; the root is the empty path."""
        return [field for field in self.fields if field.parent == parent]


REQUIRED, OPTIONAL = True, False

# The payload fields of each feed, in the order they are checked.
CUSTOMERS = Contract(
    "customers",
    (
        Field("id", "STRING", REQUIRED),
        Field("email", "STRING", REQUIRED),
        Field("firstName", "STRING", REQUIRED),
        Field("lastName", "STRING", REQUIRED),
        Field("status", "STRING", REQUIRED, ("ACTIVE", "INACTIVE", "CHURNED")),
        Field("tier", "STRING", REQUIRED, ("BRONZE", "SILVER", "GOLD", "PLATINUM")),
        Field("address", "OBJECT", REQUIRED),
        Field("address.line1", "STRING", REQUIRED),
        Field("address.line2", "STRING", OPTIONAL),
        Field("address.city", "STRING", REQUIRED),
        Field("address.postalCode", "STRING", REQUIRED),
        Field("address.country", "STRING", REQUIRED),
        Field("tags", "ARRAY", OPTIONAL),
        Field("createdAt", "STRING", REQUIRED),
        Field("updatedAt", "STRING", REQUIRED),
        Field("deleted", "BOOLEAN", OPTIONAL),
    ),
)
ORDERS = Contract(
    "orders",
    (
        Field("id", "STRING", REQUIRED),
        Field("customerId", "STRING", REQUIRED),
        Field("status", "STRING", REQUIRED, ("PENDING", "PAID", "SHIPPED", "DELIVERED", "CANCELLED")),
        Field("total", "OBJECT", REQUIRED),
        Field("total.amount", "STRING", REQUIRED),
        Field("total.currency", "STRING", REQUIRED),
        Field("lines", "ARRAY", REQUIRED),
        Field("placedAt", "STRING", REQUIRED),
        Field("updatedAt", "STRING", REQUIRED),
        Field("deleted", "BOOLEAN", OPTIONAL),
    ),
)


def contract_fields(spark: SparkSession, *contracts: Contract) -> DataFrame:
    """The contracts as a relation: one row per declared field with its parent and position."""
    rows = [
        (c.feed, ord_, f.path, f.parent, f.name, f.type, f.required, list(f.allowed) if f.allowed else None)
        for c in contracts
        for ord_, f in enumerate(c.fields)
    ]
    return spark.createDataFrame(
        rows,
        "feed string, ord int, path string, parent string, name string, type string, required boolean, "
        "allowed array<string>",
    )
