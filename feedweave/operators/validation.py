"""Rules of the canonical records; every rule that a record breaks is reported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.text import is_blank, matches_fully

ERROR = "struct<field: string, message: string>"
ERRORS = f"array<{ERROR}>"
# Patterns and messages of the rules.
EMAIL = r"[^@\s]+@[^@\s]+\.[^@\s]+"
COUNTRY = "[A-Z]{2}"
CURRENCY = "[A-Z]{3}"
NOT_BLANK = "must not be blank"


def error(field: Column | str, message: Column | str) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(field.alias("field"), message.alias("message"))


def no_errors() -> Column:
    return F.array().cast(ERRORS)


def collect(*problems: Column) -> Column:
    """The problems that are not null, in order."""
    return F.array_compact(F.array(*problems)).cast(ERRORS)


def broken(condition: Column, field: str, message: Column | str) -> Column:
    """An error where the condition does not hold; an unknown condition does not hold either."""
    return F.when(~F.coalesce(condition, F.lit(False)), error(field, message))


def _filled(value: Column, field: str) -> Column:
    return broken(~is_blank(value), field, NOT_BLANK)


def validate_address(address: Column) -> Column:
    return collect(
        _filled(address["street"], "address.street"),
        _filled(address["city"], "address.city"),
        _filled(address["postal_code"], "address.postalCode"),
        broken(
            matches_fully(address["country_code"], COUNTRY),
            "address.countryCode",
            "must be an ISO 3166-1 alpha-2 code",
        ),
    )


def validate_customer(customer: Column) -> Column:
    """Customer-level rules; the address rules come before and hide these, see the mapping stages."""
    return collect(
        _filled(customer["business_key"], "businessKey"),
        broken(matches_fully(F.lower(customer["email"]), EMAIL), "email", "must be a valid email address"),
        _filled(customer["given_name"], "givenName"),
        _filled(customer["family_name"], "familyName"),
        broken(customer["updated_at"] >= customer["created_at"], "updatedAt", "must not be before createdAt"),
        broken(~F.exists(customer["tags"], is_blank), "tags", "must not contain blank tags"),
    )


def validate_money(amount_minor: Column, currency: Column) -> Column:
    return collect(
        broken(amount_minor >= 0, "amountMinor", "must not be negative"),
        broken(matches_fully(currency, CURRENCY), "currency", "must be an ISO 4217 code"),
    )


def validate_order_line(line: Column) -> Column:
    return collect(
        _filled(line["sku"], "lines.sku"),
        broken(line["quantity"] > 0, "lines.quantity", "must be positive"),
        broken(line["unit_price_minor"] >= 0, "lines.unitPriceMinor", "must not be negative"),
    )


def validate_order_lines(lines: Column) -> Column:
    """Violations of the first line that has any."""
    failing = F.filter(F.transform(lines, validate_order_line), lambda errors: F.size(errors) > 0)
    return F.coalesce(F.get(failing, F.lit(0)), no_errors())


def line_total(lines: Column) -> Column:
    return F.aggregate(
        lines,
        F.lit(0).cast("decimal(38,0)"),
        lambda sum_, line: (
            sum_ + line["quantity"].cast("decimal(10,0)") * line["unit_price_minor"].cast("decimal(19,0)")
        ).cast("decimal(38,0)"),
    )


def validate_order(order: Column) -> Column:
    """Order-level rules; money and line rules come before and hide these, see the mapping stages."""
    total = line_total(order["lines"])
    return collect(
        _filled(order["business_key"], "businessKey"),
        _filled(order["customer_key"], "customerKey"),
        broken(F.size(order["lines"]) > 0, "lines", "must contain at least one line"),
        broken(
            total == order["total"]["amount_minor"].cast("decimal(38,0)"),
            "total",
            F.concat(F.lit("must equal the sum of line totals ("), total.cast("string"), F.lit(")")),
        ),
        broken(order["updated_at"] >= order["placed_at"], "updatedAt", "must not be before placedAt"),
    )
