"""Reading values of a parsed JSON document (VARIANT) by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def node(document: Column, path: str = "") -> Column:
    """The sub-document at a dotted path; SQL null when absent, a JSON null stays a JSON null."""
    return F.try_variant_get(document, f"$.{path}" if path else "$", "variant")


def members(document: Column, path: str = "") -> Column:
    """The members of the object at a path as one flat map; null where there is no object.

    Looking names up in it is far cheaper than walking the document again for every name.
    """
    return F.try_variant_get(document, f"$.{path}" if path else "$", "map<string,variant>")


def is_absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


# The five JSON types a contract speaks of, by the type a parsed value reports.
TYPE_OF = {
    "STRING": "STRING",
    "BIGINT": "NUMBER",
    "DECIMAL": "NUMBER",
    "DOUBLE": "NUMBER",
    "BOOLEAN": "BOOLEAN",
    "ARRAY": "ARRAY",
    "OBJECT": "OBJECT",
}
NULL = "NULL"


def stored_type(value: Column) -> Column:
    """The type as stored, without its parameters; null when the value is absent."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def json_type_or_null(value: Column) -> Column:
    """STRING, NUMBER, BOOLEAN, ARRAY, OBJECT or NULL; SQL null when absent. Looks at the value once."""
    pairs = [F.lit(text) for pair in [*TYPE_OF.items(), ("VOID", NULL)] for text in pair]
    return F.try_element_at(F.create_map(*pairs), stored_type(value))


def json_type(value: Column) -> Column:
    """The same with a JSON null counting as OBJECT."""
    return F.replace(json_type_or_null(value), F.lit(NULL), F.lit("OBJECT"))


def text_at(document: Column, path: str) -> Column:
    """The text at a path; null when absent or not a text."""
    value = node(document, path)
    return F.when(F.schema_of_variant(value) == "STRING", as_text(value))


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def scalar_text(value: Column) -> Column:
    """Text form of any array element: containers give empty text, a JSON null gives the word null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(""))
        .when(F.is_variant_null(value), F.lit("null"))
        .otherwise(number_text(value))
    )


def number_text(value: Column) -> Column:
    """Decimal text of a number as a JSON reader holding doubles would print it; other scalars as they are."""
    kind = F.schema_of_variant(value)
    fractional = (kind == "DOUBLE") | (kind.startswith("DECIMAL") & ~kind.endswith(",0)"))
    return F.when(fractional, F.try_variant_get(value, "$", "double").cast("string")).otherwise(as_text(value))


def as_flag(value: Column) -> Column:
    """A lenient boolean: true, "true" or a number other than zero; anything else is false."""
    kind = stored_type(value)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.trim(as_text(value)) == "true")
        .when(kind.isNotNull(), F.try_variant_get(value, "$", "double") != 0),
        F.lit(False),
    )
