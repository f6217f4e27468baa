"""Repair of over-escaped JSON and of raw line ends inside JSON strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An escape inside a string: two backslashes before an escape letter, or one before anything.
_DOUBLED = r'(?s)\\(\\["nrtbfu/\\]|.)'
# A string as the repair reads it, so that an over-escaped quote does not close it.
_STRINGS = r'(?s)"(?:[^"\\]|\\(?:\\["nrtbfu/\\]|.))*+"'


def un_double_escape(part: Column) -> Column:
    """Take one backslash off every escape inside strings (``\\\\n`` becomes ``\\n``).

    Null where a backslash stands outside every string: such text is no JSON either way.
    """
    stray = F.contains(F.regexp_replace(part, _STRINGS, ""), F.lit("\\"))
    return F.when(~stray, F.regexp_replace(part, _DOUBLED, "$1"))


def sanitize_newlines(text: Column) -> Column:
    """Escape raw line ends inside JSON strings; those between tokens stay.

    The text is cut at its quotes that are not escaped; every second piece is inside a string.
    """
    # Outside a string a backslash escapes nothing, so tokens are matched, not single quotes:
    # either a whole string (closed or cut off at the end) or a run without quotes.
    tokens = F.regexp_extract_all(
        text, F.lit(r'(?s)("(?:[^"\\]|\\.)*+(?:"|\\?\z))|([^"]+)'), F.lit(0)
    )
    # A line end right after a backslash is an escaped character and stays as it is.
    escaped = lambda t: F.regexp_replace(
        F.regexp_replace(t, r'(?s)\G((?:[^\\\n]|\\.)*+)\n', "$1\\\\n"),
        r'(?s)\G((?:[^\\\r]|\\.)*+)\r', "$1\\\\r",
    )
    rewritten = F.array_join(
        F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit('"')), escaped(t)).otherwise(t)),
        "",
    )
    return F.when(text.rlike(r"[\n\r]"), rewritten).otherwise(text)
