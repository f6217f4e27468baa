"""Where the JSON of a line begins, and whether it is one whole object.

Spark's JSON functions stop after the first complete value and ignore what follows it. To see the
end of the text, the gate appends one more member, whose value is a hash of the text, in front of
the final brace: it comes back as a top-level member only if everything before that brace was the
inside of one well-formed object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lograft.tables import WHITE_SPACE

END_KEY = "\x1fend"
_END_KEY_JSON = "\\u001fend"

# Strict RFC 8259 reading, at most 127 levels deep, strings of any length.
STRICT_JSON = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "maxNestingDepth": "127",
    "maxStringLen": "2147483647",
    "maxNumLen": "2147483647",
}

FIELDS_TYPE = "map<string,string>"

# A surrogate escape without its partner, once pairs and escaped backslashes are taken out.
_PAIRED = r"\\\\|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_SURROGATE = r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}"


# A number that may be beyond a double has a large exponent or very many digits; the strings and
# numbers of a record.
_LARGE_EXPONENT = r"[eE][+]?[0-9]{3}"
_MAYBE_VAST = r"[0-9][eE][+]?0*[0-9]{3}|[0-9]{309}"
_VAST_DIGITS = 309
# The same for a part of a record; without a large exponent a vast number has so many digits.
_VAST_PART = r"[eE][+]?0*[0-9]{3}|[0-9]{210}"
# Longer records are looked through in parts: a pattern takes far longer than a plain search.
LONG_TEXT = 4096
_VALUES = r'"[^"\\]*(?:\\.[^"\\]*)*"|-?[0-9][-+.0-9eE]*'


def trimmed(line: Column) -> Column:
    """The line without Unicode white space at its ends."""
    whole = F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}"))
    return F.when(whole, line).otherwise(F.btrim(line, F.lit(WHITE_SPACE)))


def json_part(text: Column) -> Column:
    """The trimmed text from its first brace on; null without a brace."""
    return (
        F.when(F.startswith(text, F.lit("{")), text)
        .when(F.contains(text, F.lit("{")), F.substr(text, F.instr(text, "{")))
    )


def text_before_json(text: Column) -> Column:
    """The trimmed text before its first brace; null if it begins with one or has none."""
    return F.when(
        F.contains(text, F.lit("{")) & ~F.startswith(text, F.lit("{")),
        F.substring_index(text, "{", 1),
    )


def might_start_json(part: Column) -> Column:
    """Whether a brace is followed, after optional white space, by a quote."""
    return F.coalesce(part.rlike(r'^\{(?U:\s)*"'), F.lit(False))


def _mark(part: Column) -> Column:
    """The value of the end marker. Its name holds a character that a record can only have as an
    escape, so only a record with such an escape could fake it and needs a value of its own."""
    faked = F.contains(part, F.lit("\\u001"))
    return F.when(faked, F.xxhash64(part).cast("string")).otherwise(F.lit("0"))


def read_fields(part: Column) -> Column:
    """Top-level members of ``part`` as text, with the end marker if the text is well formed."""
    inside = F.substring(part.cast("binary"), F.lit(1), F.octet_length(part) - 1).cast("string")
    marked = F.concat(inside, F.lit(f',"{_END_KEY_JSON}":'), _mark(part), F.lit("}"))
    return F.when(
        F.endswith(part, F.lit("}")), F.from_json(marked, FIELDS_TYPE, STRICT_JSON)
    )


def between_quotes(record: Column) -> Column:
    """The parts of a record before, between and behind its quotes, found by a plain search.

    What stands outside strings begins with a brace, a bracket, a comma, a colon or white space.
    """
    return F.split(record, '"', -1)


def _holds_vast(part: Column) -> Column:
    """Whether a number of the record is beyond a double; the whole look is rarely needed."""
    outside = [ord(c) for c in "{}[],: \t\n\r"]
    in_parts = F.exists(
        between_quotes(part),
        lambda p: F.when(F.ascii(p).isin(outside), p.rlike(_VAST_PART)).otherwise(F.lit(False)),
    )
    may = (
        F.when(F.octet_length(part) > LONG_TEXT, in_parts)
        .when(F.octet_length(part) > _VAST_DIGITS, F.lit(True))
        .otherwise(part.rlike(_LARGE_EXPONENT))
    )
    return F.when(
        may & part.rlike(_MAYBE_VAST),
        F.exists(
            F.regexp_extract_all(part, F.lit(_VALUES), F.lit(0)),
            # A cast that fails costs far more than a look at the text.
            lambda token: F.coalesce(
                F.when(F.ascii(token) != ord('"'), F.abs(token.try_cast("double")) == float("inf")),
                F.lit(False),
            ),
        ),
    ).otherwise(F.lit(False))


def checked_fields(part: Column, members: Column) -> Column:
    """The result of :func:`read_fields` if the end marker proves it, else null.

    Of equal keys the last is kept. The marker stays in the map and is removed with the roles.
    """
    proven = (F.try_element_at(F.map_keys(members), F.lit(-1)) == END_KEY) & (
        F.try_element_at(F.map_values(members), F.lit(-1)) == _mark(part)
    )
    last_wins = F.map_from_entries(F.map_entries(members))
    empty = part.rlike(r"^\{[ \t\n\r]*\}$")
    escapes = F.contains(part, F.lit("\\ud")) | F.contains(part, F.lit("\\uD"))
    lone = F.regexp_replace(part, _PAIRED, "").rlike(_SURROGATE)
    unpaired = F.when(escapes, lone).otherwise(F.lit(False))
    return F.when(proven & ~unpaired & ~_holds_vast(part), last_wins).when(
        empty, F.from_json(F.lit("{}"), FIELDS_TYPE)
    )


def parse_problem(kind: Column, part: Column) -> Column:
    """What kept a line with a brace from being read; null for records and plain text."""
    return F.when(
        (kind == "raw") & part.isNotNull(),
        F.struct(
            F.lit("invalid JSON").alias("message"),
            F.lit(None).cast("int").alias("line"),
            F.lit(None).cast("int").alias("column"),
        ),
    )
