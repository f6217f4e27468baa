"""Which member of a record plays which role, and what is left over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lograft.functions.classify import END_KEY, FIELDS_TYPE, LONG_TEXT, between_quotes
from lograft.functions.values import (
    compact_json,
    may_differ,
    number_text,
    typed_text,
    variant_members,
)
from lograft.options import LogOptions
from lograft.tables import ROLES


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def present_names(members: Column, names: list[str]) -> Column:
    """Those of ``names`` that are keys, whatever their values, in the order of ``names``."""
    return F.array_intersect(_constant(names), F.map_keys(members))


def _constant(names: list[str]) -> Column:
    """An array of constant texts, folded when planned."""
    return F.array(*map(F.lit, names))


def matched_key(members: Column, names: tuple[str, ...]) -> Column:
    """Presence lookup only: which name matched, nothing is removed."""
    return F.get(present_names(members, list(names)), 0)


def role_keys(members: Column, options: LogOptions) -> dict[str, Column]:
    """Role -> the key it consumes: the first of its names that is a key of the record.

    Roles take their key in the fixed order of ``ROLES``; one that an earlier role may have
    taken (only custom keys overlap) is passed over where it was.
    """
    keys: dict[str, Column] = {}
    for role in ROLES:
        chain = F
        for name in options.keys_of(role):
            there = F.map_contains_key(members, F.lit(name))
            for rival, key in keys.items():
                if name in options.keys_of(rival):
                    there = there & ~key.eqNullSafe(F.lit(name))
            chain = chain.when(there, F.lit(name))
        keys[role] = chain
    return keys


def consumed_keys(keys: list[Column]) -> Column:
    """The consumed keys and the gate's end marker as one array without nulls."""
    marker = F.lit(END_KEY)
    return F.array(marker, *[F.coalesce(key, marker) for key in keys])


def _by_name(members: Column) -> Column:
    """Members as entries in name order. Sorting goes by name alone: a VARIANT has no order."""
    return F.transform(
        F.array_sort(F.map_keys(members)),
        lambda k: F.struct(k.alias("key"), F.element_at(members, k).alias("value")),
    )


def _opened(entries: Column, is_object, nested_entries, leaf) -> Column:
    """Entries with objects replaced by their members under dotted names.

    In name order a literal ``a.b`` comes after, and so wins over, ``{"a": {"b": …}}``.
    """

    def one(entry: Column) -> Column:
        members = F.transform(
            nested_entries(entry["value"]),
            lambda n: F.struct(
                F.concat(entry["key"], F.lit("."), n["key"]).alias("key"),
                leaf(n["value"]).alias("value"),
            ),
        )
        alone = F.array(F.struct(entry["key"].alias("key"), leaf(entry["value"]).alias("value")))
        return F.when(is_object(entry["value"]), members).otherwise(alone)

    return F.map_from_entries(F.flatten(F.transform(entries, one)))


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _as_members(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def extra_variants(record: Column, members: Column, consumed: Column) -> Column:
    """Leftover members with their types, objects opened one level under dotted names."""
    left = F.map_filter(variant_members(record, members), lambda k, v: ~F.array_contains(consumed, k))
    return let(
        left,
        lambda m: _opened(
            _by_name(m), _is_object, lambda v: F.map_entries(_as_members(v)), lambda v: v
        ),
    )


# Texts that may be nested or a number shown in another form, and such a text
# appearing as a string somewhere in a record.
_SUSPECT = r"^[{\[]|E-?[0-9]+$|^-?[0-9]{19,}$"
_QUOTED_SUSPECT = r'"(?:[{\[]|-?[0-9.]+E-?[0-9]+"|-?[0-9]{19,}")|\\u'
_SUSPECT_PART = r"^(?:-?[0-9.]+E-?[0-9]+|-?[0-9]{19,})\z"


def _mistakable(record: Column) -> Column:
    """Whether a string of the record may be mistaken for a nested value or a number."""
    opening = [ord(c) for c in "{["]
    signs = [ord(c) for c in "-.0123456789"]

    def mistaken(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.exists(
            F.transform(
                parts,
                lambda p, at: F.when(at == 0, F.lit(False))
                .when(F.ascii(p).isin(opening), F.lit(True))
                .when(F.ascii(p).isin(signs) & (at < last), p.rlike(_SUSPECT_PART))
                .otherwise(F.lit(False)),
            ),
            lambda found: found,
        )

    in_parts = F.contains(record, F.lit("\\u")) | let(between_quotes(record), mistaken)
    return F.when(F.octet_length(record) > LONG_TEXT, in_parts).otherwise(
        record.rlike(_QUOTED_SUSPECT)
    )


def _leaf_text(text: Column) -> Column:
    """Display text of a member known not to be a misread string."""
    first = F.ascii(text)
    return (
        F.when(first.isin(ord("{"), ord("[")), compact_json(text))
        .when(may_differ(text) & text.rlike(_SUSPECT), number_text(text))
        .otherwise(F.coalesce(text, F.lit("null")))
    )


def extra_texts(members: Column, record: Column, consumed: Column) -> Column:
    """Leftover members as display text, by the cheapest way each record allows.

    Flat members are their own text. If any may be nested or a number in exponent form, the
    text is worked out member by member, as long as no string of the record can be mistaken
    for such a value; otherwise the types of the members decide.
    """

    def unconsumed(m: Column) -> Column:
        return F.map_filter(m, lambda k, v: ~F.array_contains(consumed, k))

    def paired(texts: Column, values: Column) -> Column:
        return F.map_zip_with(
            texts, values, lambda k, t, v: F.struct(t.alias("text"), v.alias("typed"))
        )

    def nested_texts(text: Column) -> Column:
        return F.map_entries(F.from_json(text, FIELDS_TYPE))

    def shown(left: Column) -> Column:
        suspect = F.exists(
            F.map_values(left),
            lambda v: F.when(may_differ(v), v.rlike(_SUSPECT)).otherwise(F.lit(False)),
        )
        flat = F.transform_values(left, lambda k, v: F.coalesce(v, F.lit("null")))
        by_text = _opened(
            F.array_sort(F.map_entries(left)),
            lambda v: F.startswith(v, F.lit("{")),
            nested_texts,
            _leaf_text,
        )
        by_type = _opened(
            _by_name(paired(left, unconsumed(variant_members(record, members)))),
            lambda v: _is_object(v["typed"]),
            lambda v: F.map_entries(
                paired(F.map_from_entries(nested_texts(v["text"])), _as_members(v["typed"]))
            ),
            lambda v: typed_text(v["text"], v["typed"]),
        )
        return F.when(~suspect, flat).when(~_mistakable(record), by_text).otherwise(by_type)

    return let(unconsumed(members), shown)
