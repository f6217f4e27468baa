"""Display text of JSON values.

The gate reads members as text, which is quick but does not say whether ``30`` was a number or a
string. A string appears in the line between quotes, so a line that holds neither the quoted text
nor a ``\\u`` escape settles the question without another parse; only the rest is read as VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lograft.functions.classify import STRICT_JSON

# Text that may be a nested value, or a number printed in another form than it is shown.
_UNSETTLED = r"^(?:[{\[]|-?[0-9]+[.][0-9]+E-?[0-9]+$|-?[0-9]{19,}$)"
_EXPONENT = r"^(-?)([0-9]+)[.]([0-9]+)E(-?[0-9]+)$"
_NUMBER = r"^-?[0-9]+(?:[.][0-9]+)?(?:E-?[0-9]+)?$"


def may_differ(text: Column) -> Column:
    """Whether a text begins like a nested value or a number: others are shown as they are."""
    return F.ascii(text).isin([ord(c) for c in "-0123456789[{"])


# From this size on the quick parse refuses strings; a VARIANT itself holds 128 MiB at most.
_LONG = 16_000_000
_VARIANT_LIMIT = 128 * 1024 * 1024 - 1024


def variant_members(record: Column, members: Column) -> Column:
    """Members of the record's JSON with their types, ``members`` being their texts.

    Long records are read with the gate's own options. Where even then a member is too large for a
    VARIANT, types follow from the texts: all members stay, and only such a member's value is null.
    """
    as_read = F.from_json(record, "map<string,variant>", STRICT_JSON)
    by_text = F.transform_values(members, lambda k, text: _text_variant(text, record))
    return F.when(
        F.octet_length(record) < _LONG, F.try_parse_json(record).cast("map<string,variant>")
    ).otherwise(F.coalesce(as_read, by_text))


def _text_variant(text: Column, record: Column) -> Column:
    as_string = F.when(F.octet_length(text) < _VARIANT_LIMIT, text).cast("variant")
    bare = F.coalesce(text, F.lit("null"))
    return F.when(_settled(bare, record) & (F.octet_length(bare) < _LONG),
                  F.coalesce(F.try_parse_json(bare), as_string)).otherwise(as_string)


def number_text(text: Column) -> Column:
    """Shortest decimal text of a number, with an exponent from 1e16 up and below 1e-5."""
    whole = text.try_cast("decimal(38,0)")
    unsigned = whole.between(*(F.lit(n).cast("decimal(38,0)") for n in ("0", "18446744073709551615")))
    integral = ~text.rlike("[.E]")
    as_double = F.when(integral, text.cast("double").cast("string")).otherwise(text)
    # A cast that fails costs far more than a look at the text.
    found = F.when(F.contains(as_double, F.lit("E")), F.regexp_extract(as_double, _EXPONENT, 4))
    exponent = F.when(found != "", found).try_cast("int")
    plain = F.regexp_replace(as_double.try_cast("decimal(38,22)").cast("string"), "0+$", "")
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    scientific = F.translate(F.regexp_replace(as_double, r"[.]0E", "E"), "E", "e")
    in_range = text.try_cast("bigint").isNotNull() | F.coalesce(unsigned, F.lit(False))
    return (
        F.when(integral & in_range, text)
        .when(exponent.between(-5, 15), plain)
        .when(exponent.isNotNull(), scientific)
        .otherwise(as_double)
    )


# Strings, numbers, and what stands between them.
_TOKENS = r'"[^"\\]*(?:\\.[^"\\]*)*"|-?[0-9][-+.0-9eE]*|[^"0-9-]+|-'
# Numbers a typed value does not keep as they are shown.
_SHOWN_OTHERWISE = r"[0-9][.][0-9]|[0-9][eE]|-0|[0-9]{19}"


def shown_numbers(text: Column, wrap: bool) -> Column:
    """JSON text with its numbers as they are shown; ``wrap`` makes marked strings of them."""

    def token(t: Column) -> Column:
        number = number_text(t)
        shown = F.concat(F.lit('"\\u001f'), number, F.lit('"')) if wrap else number
        return F.when(F.ascii(t).isin([ord(c) for c in "-0123456789"]), shown).otherwise(t)

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    return F.array_join(F.transform(tokens, token), "")


def compact_json(text: Column) -> Column:
    """A nested value with the keys of its objects in order and its numbers as they are shown.

    A typed value orders keys, but prints numbers in its own way; where that may differ, they pass
    through it as strings that no text of a record can hold unescaped.
    """
    sorted_keys = F.to_json(F.try_parse_json(text))
    marked = F.to_json(F.try_parse_json(shown_numbers(text, True)))
    unmarked = F.regexp_replace(marked, r'"\\u001[fF]([-+.0-9e]+)"', "$1")
    is_object = F.contains(text, F.lit("{"))
    return (
        F.when(
            text.rlike(_SHOWN_OTHERWISE),
            F.when(is_object, unmarked).otherwise(shown_numbers(text, False)),
        )
        .when(is_object, sorted_keys)
        .otherwise(text)
    )


def _settled(text: Column, record: Column) -> Column:
    """Whether the value with this text is certainly no JSON string."""
    nested = F.ascii(text).isin(ord("{"), ord("["))
    quoted = F.concat(
        F.lit('"'),
        F.when(nested, F.substring(text, 1, 1)).otherwise(F.concat(text, F.lit('"'))),
    )
    return ~F.contains(record, F.lit("\\u")) & ~F.contains(record, quoted)


def is_number(text: Column, record: Column, members: Column, key: Column) -> Column:
    """Whether the member ``key`` of ``record``, read as ``text``, is a JSON number."""
    member = F.try_element_at(variant_members(record, members), key)
    return F.when(
        F.ascii(text).between(ord("-"), ord("9")) & text.rlike(_NUMBER),
        F.when(_settled(text, record), F.lit(True)).otherwise(
            F.schema_of_variant(member) != "STRING"
        ),
    ).otherwise(F.lit(False))


def _variant_type(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def variant_text(value: Column) -> Column:
    """Display text of a typed value; a JSON null is ``null``."""
    kind = _variant_type(value)
    text = F.try_variant_get(value, "$", "string")
    # A DECIMAL without a point was written with one, unless it is too long for a BIGINT.
    decimal = F.when(
        ~F.contains(text, F.lit(".")) & (F.length(F.ltrim(text, F.lit("-"))) < 19),
        F.concat(text, F.lit(".0")),
    ).otherwise(
        F.when(F.contains(text, F.lit(".")), text.cast("double").cast("string")).otherwise(text)
    )
    return (
        F.when(kind.isin("OBJECT", "ARRAY"), F.to_json(value))
        .when(kind == "DECIMAL", number_text(decimal))
        .when(kind.isin("DOUBLE", "FLOAT"), number_text(text))
        .otherwise(F.coalesce(text, F.when(value.isNotNull(), F.lit("null"))))
    )


def typed_text(text: Column, value: Column) -> Column:
    """Display text of a member from its gate text, its type known from ``value``."""
    kind = _variant_type(value)
    return (
        F.when(kind == "STRING", text)
        .when(kind.isin("OBJECT", "ARRAY"), compact_json(text))
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), number_text(text))
        .otherwise(F.coalesce(text, F.lit("null")))
    )


def value_text(text: Column, record: Column, members: Column, key: Column) -> Column:
    """Display text of the member ``key`` of ``record``, whose gate text is ``text``."""
    nested = F.ascii(text).isin(ord("{"), ord("["))
    settled_text = F.when(nested, compact_json(text)).otherwise(number_text(text))
    member = F.try_element_at(variant_members(record, members), key)
    return F.when(
        text.rlike(_UNSETTLED),
        F.when(_settled(text, record), settled_text).otherwise(typed_text(text, member)),
    ).otherwise(text)
