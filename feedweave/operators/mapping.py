"""Source payload to canonical record, collecting every problem instead of stopping at the first.

Reading and rule checking interleave: a nested part (address, money, an order line) is checked as soon as it has
been read, and a part that breaks a rule ends the reading there. So the problems of a record are modelled as stages;
problems of later stages are only reported when the earlier stages are clean. Unreadable fields win over broken
rules, since the placeholder of an unreadable field would break rules itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import json_values as J
from feedweave.functions.money import is_decimal_text, to_minor_units
from feedweave.functions.once import compute_once
from feedweave.functions.text import is_blank, parse_instant, trim_text, wrap_to_int
from feedweave.operators import validation as V
from feedweave.operators.drift import DOCUMENT, with_document

# The closed value sets, in rank order.
LIFECYCLES = ("ACTIVE", "INACTIVE", "CHURNED")
TIERS = ("BRONZE", "SILVER", "GOLD", "PLATINUM")
ORDER_STATES = ("PENDING", "PAID", "SHIPPED", "DELIVERED", "CANCELLED")
UNMAPPABLE, INVALID = "UNMAPPABLE", "INVALID"


# How a field is read from the payload.
TEXT, INSTANT, INTEGER, AMOUNT, LIST = "text", "instant", "integer", "amount", "list"


def _alias(path: str) -> str:
    return path.replace(".", "_")


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def _raw(node: Column, kind: str) -> Column:
    """What stands in the payload, null where it is absent or of no use for this kind of read."""
    if kind in (TEXT, INSTANT):
        return F.when(F.schema_of_variant(node) == "STRING", J.as_text(node))
    if kind == INTEGER:
        return F.when(F.schema_of_variant(node) == "BIGINT", F.try_variant_get(node, "$", "bigint"))
    if kind == AMOUNT:
        text = F.when(J.json_type_or_null(node).isin("STRING", "NUMBER"), J.number_text(node))
        return F.when(is_decimal_text(text), text)
    return F.struct(
        J.json_type_or_null(node).alias("type"), F.try_variant_get(node, "$", "array<variant>").alias("items")
    )


class PayloadFields:
    """Typed reads below one JSON object: each returns (value or placeholder, error or null).

    Reading goes in two steps, so that the payload is looked at once per field although values and errors are used
    many times: `raw` makes the struct of raw fields, the typed reads work on a column that holds that struct.
    """

    def __init__(self, raw: Column, prefix: Column | None = None):
        self.fields = raw
        self.prefix = prefix

    @staticmethod
    def members(document: Column, **kinds: list[str]) -> Column:
        """The objects that hold these fields, each as one flat map. As a column of its own it is made once."""
        parents = sorted({_parent(path) for paths in kinds.values() for path in paths})
        return F.struct(*[J.members(document, parent).alias(f"in_{_alias(parent)}") for parent in parents])

    @staticmethod
    def raw(document: Column, members: Column | None = None, **kinds: list[str]) -> Column:
        """`members`: the column that holds the flat maps; without it the document is walked for each field."""

        def node(path: str) -> Column:
            if members is None:
                return J.node(document, path)
            return F.try_element_at(members[f"in_{_alias(_parent(path))}"], F.lit(path.rpartition(".")[2]))

        return F.struct(*[_raw(node(path), kind).alias(_alias(path)) for kind, paths in kinds.items() for path in paths])

    def _get(self, path: str) -> Column:
        return self.fields[_alias(path)]

    def _at(self, path: str) -> Column:
        return F.lit(path) if self.prefix is None else F.concat(self.prefix, F.lit(path))

    def _missing(self, path: str, expected: str) -> Column:
        return V.error(self._at(path), f"missing or not a {expected}")

    def optional_text(self, path: str) -> Column:
        return self._get(path)

    def text(self, path: str) -> tuple[Column, Column]:
        value = self._get(path)
        return F.coalesce(value, F.lit("")), F.when(value.isNull(), self._missing(path, "text"))

    def instant(self, path: str) -> tuple[Column, Column]:
        text = self._get(path)
        value = parse_instant(text)
        unreadable = V.error(self._at(path), F.concat(F.lit("is not an ISO-8601 timestamp: "), text))
        problem = F.when(text.isNull(), self._missing(path, "ISO-8601 timestamp")).when(value.isNull(), unreadable)
        return F.coalesce(value, F.timestamp_seconds(F.lit(0))), problem

    def integer(self, path: str) -> tuple[Column, Column]:
        value = self._get(path)
        return F.coalesce(wrap_to_int(value), F.lit(0)), F.when(value.isNull(), self._missing(path, "integer"))

    def minor_units(self, path: str) -> tuple[Column, Column]:
        """A decimal given as text or number, exactly in minor units."""
        text = self._get(path)
        units, problem = to_minor_units(text)
        inexact = V.error(
            self._at(path),
            F.concat(F.lit("must have at most two decimal places and fit in minor units ("), problem, F.lit(")")),
        )
        return (
            F.when(text.isNotNull(), units).otherwise(F.lit(0).cast("bigint")),
            F.when(text.isNull(), self._missing(path, "decimal")).when(problem.isNotNull(), inexact),
        )

    def text_list(self, path: str) -> tuple[Column, Column]:
        kind, items = self._get(path)["type"], self._get(path)["items"]
        absent = kind.isNull() | (kind == J.NULL)
        problem = F.when(~absent & (kind != "ARRAY"), V.error(self._at(path), "must be an array"))
        texts = F.when(kind == "ARRAY", F.transform(items, J.scalar_text))
        return F.coalesce(texts, F.array().cast("array<string>")), problem

    def objects(self, path: str) -> tuple[Column, Column]:
        kind, items = self._get(path)["type"], self._get(path)["items"]
        listed = F.coalesce(kind == "ARRAY", F.lit(False))
        return F.when(listed, items), F.when(~listed, self._missing(path, "array"))

    def choice(self, path: str, values: tuple[str, ...]) -> tuple[Column, Column]:
        """One of a closed set, whatever its case."""
        text = self._get(path)
        value = F.when(F.upper(text).isin(*values), F.upper(text))
        message = F.concat(
            F.lit(f"must be one of {', '.join(values)} (was '"), F.coalesce(text, F.lit("null")), F.lit("')")
        )
        return F.coalesce(value, F.lit(values[0])), F.when(value.isNull(), V.error(self._at(path), message))


def _verdict(records: DataFrame, skip: Column, unreadable: Column, violations: Column) -> DataFrame:
    """Decide between mapped, UNMAPPABLE and INVALID; skipped records have neither a record nor a failure."""
    problems = records.withColumn("_unreadable", unreadable).withColumn("_violations", violations)
    kind = (
        F.when(skip, F.lit(None).cast("string"))
        .when(F.size("_unreadable") > 0, F.lit(UNMAPPABLE))
        .when(F.size("_violations") > 0, F.lit(INVALID))
    )
    verdict = problems.withColumn("_kind", kind)
    errors = F.when(F.col("_kind") == UNMAPPABLE, F.col("_unreadable")).when(
        F.col("_kind") == INVALID, F.col("_violations")
    )
    return compute_once(
        verdict,
        failure_kind=F.col("_kind"),
        errors=F.coalesce(errors, V.no_errors()),
        canonical=F.when(~skip & F.col("_kind").isNull(), F.col("_read.record")),
    ).drop("_unreadable", "_violations", "_kind", "_broken", "_raw", "_read", "_lines", "_flat", DOCUMENT)


def _with_raw(records: DataFrame, skip: Column, fields: dict[str, list[str]]) -> DataFrame:
    """The raw fields of a payload, read from the flat maps of its objects."""
    flat = with_document(records).withColumn("_flat", F.when(~skip, PayloadFields.members(F.col(DOCUMENT), **fields)))
    return flat.withColumn("_raw", F.when(~skip, PayloadFields.raw(F.col(DOCUMENT), F.col("_flat"), **fields)))


def _then(first: Column, second: Column, clean: Column) -> Column:
    """Problems of the next stage follow only when the previous stages broke no rule."""
    return F.concat(first, F.when(clean, second).otherwise(V.no_errors()))


def map_customer(records: DataFrame, skip: Column | None = None) -> DataFrame:
    """Customer payloads to canonical customers: adds `canonical`, `failure_kind` and `errors`.

    Payloads of skipped records (tombstones unless told otherwise) are not read.
    """
    skip = F.col("deleted") if skip is None else skip
    fields = dict(
        text=[
            "address.line1",
            "address.line2",
            "email",
            "firstName",
            "lastName",
            "status",
            "tier",
            "address.city",
            "address.postalCode",
            "address.country",
        ],
        list=["tags"],
        instant=["createdAt", "updatedAt"],
    )
    read = PayloadFields(F.col("_raw"))
    line1, line1_error = read.text("address.line1")
    line2 = read.optional_text("address.line2")
    email, email_error = read.text("email")
    first, first_error = read.text("firstName")
    last, last_error = read.text("lastName")
    lifecycle, lifecycle_error = read.choice("status", LIFECYCLES)
    tier, tier_error = read.choice("tier", TIERS)
    city, city_error = read.text("address.city")
    postal, postal_error = read.text("address.postalCode")
    country, country_error = read.text("address.country")
    tags, tags_error = read.text_list("tags")
    created, created_error = read.instant("createdAt")
    updated, updated_error = read.instant("updatedAt")
    street_parts = F.filter(F.array_compact(F.array(line1, line2)), lambda part: ~is_blank(part))
    plain_tags = F.filter(F.transform(tags, lambda tag: F.lower(trim_text(tag))), lambda tag: tag != "")
    record = F.struct(
        F.col("business_key"),
        F.lower(trim_text(email)).alias("email"),
        trim_text(first).alias("given_name"),
        trim_text(last).alias("family_name"),
        lifecycle.alias("lifecycle"),
        tier.alias("tier"),
        F.struct(
            F.array_join(street_parts, ", ").alias("street"),
            trim_text(city).alias("city"),
            trim_text(postal).alias("postal_code"),
            F.upper(trim_text(country)).alias("country_code"),
        ).alias("address"),
        F.array_distinct(plain_tags).alias("tags"),
        created.alias("created_at"),
        updated.alias("updated_at"),
    )
    upto_address = V.collect(
        line1_error,
        email_error,
        first_error,
        last_error,
        lifecycle_error,
        tier_error,
        city_error,
        postal_error,
        country_error,
    )
    after_address = V.collect(tags_error, created_error, updated_error)
    parsed = _with_raw(records, skip, fields).withColumn(
        "_read",
        F.when(
            ~skip,
            F.struct(record.alias("record"), upto_address.alias("first"), after_address.alias("rest")),
        ),
    )
    parsed = parsed.withColumn("_broken", V.validate_address(F.col("_read.record.address")))
    address_broken = F.col("_broken")
    sound_address = F.size(address_broken) == 0
    unreadable = _then(F.col("_read.first"), F.col("_read.rest"), sound_address)
    violations = F.when(sound_address, V.validate_customer(F.col("_read.record"))).otherwise(address_broken)
    return _verdict(parsed, skip, unreadable, violations)


def _order_line(raw: Column, index: Column) -> Column:
    read = PayloadFields(raw, F.concat(F.lit("lines["), index.cast("string"), F.lit("].")))
    sku, sku_error = read.text("sku")
    quantity, quantity_error = read.integer("quantity")
    price, price_error = read.minor_units("unitPrice")
    return F.struct(
        F.struct(sku.alias("sku"), quantity.alias("quantity"), price.alias("unit_price_minor")).alias("line"),
        V.collect(sku_error, quantity_error, price_error).alias("unreadable"),
    )


def map_order(records: DataFrame, skip: Column | None = None) -> DataFrame:
    """Order payloads to canonical orders: adds `canonical`, `failure_kind` and `errors`."""
    skip = F.col("deleted") if skip is None else skip
    fields = dict(
        text=["customerId", "status", "total.currency"],
        amount=["total.amount"],
        list=["lines"],
        instant=["placedAt", "updatedAt"],
    )
    read = PayloadFields(F.col("_raw"))
    customer, customer_error = read.text("customerId")
    state, state_error = read.choice("status", ORDER_STATES)
    amount, amount_error = read.minor_units("total.amount")
    currency, currency_error = read.text("total.currency")
    elements, lines_error = read.objects("lines")
    placed, placed_error = read.instant("placedAt")
    updated, updated_error = read.instant("updatedAt")
    raw_lines = F.transform(
        elements, lambda e: PayloadFields.raw(e, text=["sku"], integer=["quantity"], amount=["unitPrice"])
    )
    parsed = _with_raw(records, skip, fields).withColumn(
        "_lines", F.when(~skip, F.coalesce(F.transform(raw_lines, _order_line), F.array()))
    )
    lines = F.transform("_lines", lambda item: item["line"])
    record = F.struct(
        F.col("business_key"),
        customer.alias("customer_key"),
        state.alias("state"),
        F.struct(amount.alias("amount_minor"), F.upper(currency).alias("currency")).alias("total"),
        lines.alias("lines"),
        placed.alias("placed_at"),
        updated.alias("updated_at"),
    )
    # Which line ends the reading: the first that breaks a rule; lines after it are not reported.
    broken_lines = F.transform(lines, lambda line: F.size(V.validate_order_line(line)) > 0)
    parsed = parsed.withColumn(
        "_read",
        F.when(
            ~skip,
            F.struct(
                record.alias("record"),
                V.collect(customer_error, state_error, amount_error, currency_error).alias("first"),
                V.collect(lines_error).alias("list"),
                V.collect(placed_error, updated_error).alias("rest"),
                F.coalesce(F.array_position(broken_lines, True), F.lit(0)).alias("failing_line"),
            ),
        ),
    )
    money = F.col("_read.record.total")
    parsed = parsed.withColumn("_broken", V.validate_money(money["amount_minor"], money["currency"]))
    money_broken = F.col("_broken")
    sound_money = F.size(money_broken) == 0
    failing = F.col("_read.failing_line")
    sound_lines = failing == 0
    reached = F.when(sound_lines, F.col("_lines")).otherwise(F.slice("_lines", F.lit(1), failing.cast("int")))
    of_lines = F.concat(F.col("_read.list"), F.flatten(F.transform(reached, lambda item: item["unreadable"])))
    unreadable = _then(
        _then(F.col("_read.first"), of_lines, sound_money), F.col("_read.rest"), sound_money & sound_lines
    )
    violations = (
        F.when(~sound_money, money_broken)
        .when(~sound_lines, V.validate_order_lines(F.col("_read.record.lines")))
        .otherwise(V.validate_order(F.col("_read.record")))
    )
    return _verdict(parsed, skip, unreadable, violations)


def map_tombstone(records: DataFrame) -> DataFrame:
    """Deletes as canonical changes without a record; their payload is never read."""
    return records.where("deleted").select(
        "feed", "business_key", "source_updated_at", "arrival_seq", F.lit(True).alias("is_delete")
    )


def failure_message(kind: Column, errors: Column) -> Column:
    listed = F.array_join(F.transform(errors, lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")
    return F.when(kind.isNotNull(), F.concat(F.lower(kind), F.lit(": "), listed))


def mapping_failures(mapped: DataFrame) -> DataFrame:
    """Records that could not become canonical, with the quarantine reason and the message listing everything."""
    return (
        mapped.where(F.col("failure_kind").isNotNull())
        .withColumn(
            "reason", F.when(F.col("failure_kind") == INVALID, F.lit("VALIDATION")).otherwise(F.lit("MAPPING"))
        )
        .withColumn("message", failure_message(F.col("failure_kind"), F.col("errors")))
    )
