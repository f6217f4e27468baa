"""Instants from text and epoch numbers, and their display.

An instant is a microsecond TIMESTAMP plus the 0-999 nanoseconds that do not fit into it.
"""

from __future__ import annotations

import os
import re
from datetime import datetime
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lograft.options import OptionError
from lograft.tables import (
    MAX_EPOCH_SECOND,
    MILLIS_BELOW,
    MIN_EPOCH_SECOND,
    SECONDS_BELOW,
    STRFTIME_PATTERNS,
)

# The cast accepts far more (years alone, times alone, no zone), so the shape is tested first.
_DATE_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}%s[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]{1,9})?"
_WITH_OFFSET = "^" + _DATE_TIME % "[Tt ]" + r"(?:[Zz]|[+-][0-9]{2}(?::?[0-9]{2})?)$"
_WITHOUT_OFFSET = "^" + _DATE_TIME % " " + "$"


def _in_calendar(seconds: Column) -> Column:
    return seconds.between(MIN_EPOCH_SECOND, MAX_EPOCH_SECOND)


# Rarer shapes: no dashes and colons, no seconds, a comma before the fraction, a zone in brackets
# behind the offset.
_RARE = r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt ][0-9]{2}:?[0-9]{2}"
_BASIC = r"^([0-9]{4})([0-9]{2})([0-9]{2})[Tt ]([0-9]{2})([0-9]{2})"
_BASIC_SECONDS = r"^(.{16})([0-9]{2})"
_NO_SECONDS = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2})([Zz+-])"


def _usual_shape(text: Column) -> Column:
    """A text of a rarer shape with dashes, colons, seconds and a point."""
    bare = F.regexp_replace(text, r"([0-9Zz])\[[^\]]+\]$", "$1")
    pointed = F.regexp_replace(bare, ",([0-9]+)", ".$1")
    dashed = F.regexp_replace(pointed, _BASIC, "$1-$2-$3T$4:$5")
    return F.regexp_replace(F.regexp_replace(dashed, _BASIC_SECONDS, "$1:$2"), _NO_SECONDS, "$1:00$2")


def ts_from_string(text: Column) -> Column:
    usual = F.when(text.rlike(_WITH_OFFSET), text).when(
        text.rlike(_WITHOUT_OFFSET), F.concat(text, F.lit("Z"))
    )
    rare = F.when(usual.isNull() & text.rlike(_RARE), _usual_shape(text))
    zoned = F.coalesce(usual, F.when(rare.rlike(_WITH_OFFSET), rare))
    return F.translate(zoned, "tz", "TZ").try_cast("timestamp")


def nanos_from_string(text: Column) -> Column:
    rest = F.regexp_extract(text, r"[.,][0-9]{6}([0-9]{1,3})", 1)
    # Only a text longer than a basic one with microseconds can have them.
    return F.when(F.octet_length(text) > 22, F.rpad(rest, 3, "0").try_cast("smallint"))


def ts_from_epoch(number: Column) -> Column:
    """Instant of a whole epoch number, the unit judged by its size."""
    millis_second = F.floor(number / 1000)
    return (
        F.when(
            number < SECONDS_BELOW, F.when(_in_calendar(number), F.timestamp_seconds(number))
        )
        .when(
            number < MILLIS_BELOW,
            F.when(_in_calendar(millis_second), F.timestamp_millis(number)),
        )
        .otherwise(F.timestamp_micros(F.call_function("div", number, F.lit(1000))))
    )


def nanos_from_epoch(number: Column) -> Column:
    return F.when(number >= MILLIS_BELOW, number % 1000).otherwise(0).cast("smallint")


def _float_nanos(number: Column) -> Column:
    """Nanoseconds since the epoch second the number is cut to, as the double has them."""
    return ((number - _cut(number)) * 1e9).cast("bigint")


def _cut(number: Column) -> Column:
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint")


def ts_from_float(number: Column) -> Column:
    """Instant of an epoch number with a fraction: seconds below 1e12, else milliseconds."""
    seconds, nanos = _cut(number), _float_nanos(number)
    micros = seconds * 1_000_000 + F.floor(nanos / 1000).cast("bigint")
    millis = _cut(number)
    return F.when(
        number < SECONDS_BELOW,
        F.when(number.between(MIN_EPOCH_SECOND, MAX_EPOCH_SECOND), F.timestamp_micros(micros)),
    ).when(
        number < MAX_EPOCH_SECOND * 1000, F.timestamp_millis(millis)
    )


def nanos_from_float(number: Column) -> Column:
    in_seconds = (number < SECONDS_BELOW) & number.between(MIN_EPOCH_SECOND, MAX_EPOCH_SECOND)
    return F.when(in_seconds, F.pmod(_float_nanos(number), F.lit(1000))).otherwise(0).cast(
        "smallint"
    )


def display_zone(timezone: str) -> str:
    """The zone to display in; ``local`` is the zone of the machine that plans the query."""
    if timezone.lower() == "utc":
        return "UTC"
    if timezone.lower() != "local":
        return timezone
    named = os.environ.get("TZ", "").lstrip(":")
    if named and named in available_timezones():
        return named
    session = SparkSession.getActiveSession()
    return session._jvm.java.util.TimeZone.getDefault().getID() if session else "UTC"


# Directives that stand for others.
_SHORT_FOR = {
    "%c": "%a %b %e %T %Y", "%x": "%D", "%X": "%T", "%r": "%I:%M:%S %p", "%v": "%e-%b-%Y",
    "%+": "%FT%T%.f%:z", "%n": "\n", "%t": "\t",
}

# Directives that no datetime pattern has; their text is made from the instant itself.
_OWN = {"%z", "%:z", "%::z", "%Z", "%N", "%f", "%9f", "%.9f", "%.f", "%s", "%P"}

# Numbers: width and what fills it. A flag after the % sign fills otherwise: - not, _ with spaces,
# 0 with zeros.
_NUMBERS = {
    "Y": (4, "0"), "C": (2, "0"), "y": (2, "0"), "G": (4, "0"), "g": (2, "0"), "m": (2, "0"),
    "d": (2, "0"), "e": (2, " "), "j": (3, "0"), "H": (2, "0"), "k": (2, " "), "I": (2, "0"),
    "l": (2, " "), "M": (2, "0"), "S": (2, "0"), "U": (2, "0"), "W": (2, "0"), "V": (2, "0"),
    "u": (1, "0"), "w": (1, "0"), "q": (1, "0"),
}
_FILL = {"-": "", "_": " ", "0": "0"}
_PARTS = r"(%(?::{1,2}z|[.]?[369]f|[.]f|[-_0][A-Za-z]|.))"


def _is_number(part: str) -> bool:
    """Whether a directive is a number with a flag, or one that no datetime pattern has."""
    flagged = len(part) == 3 and part[1] in _FILL and part[2] in _NUMBERS
    return flagged or len(part) == 2 and part[1] in _NUMBERS and part not in STRFTIME_PATTERNS


def _number_text(part: str, local: Column) -> Column:
    name = part[-1]
    year, day = F.year(local), F.dayofyear(local) - 1
    from_sunday, from_monday = F.dayofweek(local) - 1, F.weekday(local)
    hour12 = (F.hour(local) + 11) % 12 + 1
    # A week belongs to the year its Thursday is in.
    iso_year = F.year(F.date_add(F.to_date(local), 3 - from_monday))
    value = {
        "Y": lambda: year, "C": lambda: F.floor(year / 100), "y": lambda: F.pmod(year, F.lit(100)),
        "G": lambda: iso_year, "g": lambda: F.pmod(iso_year, F.lit(100)),
        "m": lambda: F.month(local), "d": lambda: F.dayofmonth(local),
        "e": lambda: F.dayofmonth(local), "j": lambda: day + 1, "H": lambda: F.hour(local),
        "k": lambda: F.hour(local), "I": lambda: hour12, "l": lambda: hour12,
        "M": lambda: F.minute(local), "S": lambda: F.second(local),
        "U": lambda: F.floor((day + 7 - from_sunday) / 7),
        "W": lambda: F.floor((day + 7 - from_monday) / 7), "V": lambda: F.weekofyear(local),
        "u": lambda: from_monday + 1, "w": lambda: from_sunday, "q": lambda: F.quarter(local),
    }[name]().cast("string")
    width, fill = _NUMBERS[name]
    fill = _FILL[part[1]] if len(part) == 3 else fill
    # Never cut: a year may have more digits.
    return F.when(F.length(value) < width, F.lpad(value, width, fill)).otherwise(value) if fill else value


def _written_out(strftime: str) -> list[str]:
    """The format's directives and the text between them; what stands for others written out."""
    parts: list[str] = []
    for part in re.split(_PARTS, strftime, flags=re.S):
        parts += _written_out(_SHORT_FOR[part]) if part in _SHORT_FOR else [part]
    return parts


def _pieces(strftime: str) -> list[tuple[bool, str]]:
    """The format as (own directive?, Spark datetime pattern or directive), in order."""
    pieces: list[tuple[bool, str]] = []
    pattern, literal = [], ""

    def flush() -> None:
        nonlocal literal
        if literal:
            # Neighbouring literals share one pair of quotes: a doubled quote would mean itself.
            pattern.append("'" + literal.replace("'", "''") + "'")
        if pattern:
            pieces.append((False, "".join(pattern)))
            pattern.clear()
        literal = ""

    for part in _written_out(strftime):
        if part in _OWN or _is_number(part):
            flush()
            pieces.append((True, part))
        elif part.startswith("%") and part not in STRFTIME_PATTERNS:
            raise OptionError(f"unsupported directive {part!r} in {strftime!r}")
        elif not part.startswith("%") or part == "%%":
            literal += "%" if part == "%%" else part
        else:
            if literal:
                pattern.append("'" + literal.replace("'", "''") + "'")
                literal = ""
            pattern.append(STRFTIME_PATTERNS[part])
    flush()
    return pieces


def spark_pattern(strftime: str) -> str:
    """The Spark datetime pattern of a strftime format without directives of its own."""
    pieces = _pieces(strftime)
    if any(own for own, _ in pieces):
        raise OptionError(f"{strftime!r} has no single pattern")
    return "".join(text for _, text in pieces)


def _offset_text(seconds: Column, colon: str) -> Column:
    minutes = F.abs(seconds) / 60
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit("+"))
    hour = F.lpad(F.floor(minutes / 60).cast("string"), 2, "0")
    minute = F.lpad((F.floor(minutes) % 60).cast("string"), 2, "0")
    return F.concat(sign, hour, F.lit(colon), minute)


def _zone_name(seconds: Column, zone: str) -> Column:
    """The zone's abbreviation at an offset; of several in its history the latest."""
    if zone == "UTC":
        return F.lit("UTC")
    try:
        rules = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return _offset_text(seconds, ":")
    names: dict[int, str] = {}
    for year in range(1900, 2038):
        for month in range(1, 13):
            at = datetime(year, month, 1, tzinfo=rules)
            names[int(at.utcoffset().total_seconds())] = at.tzname()
    chain = F
    for offset, name in names.items():
        chain = chain.when(seconds == offset, F.lit(name))
    return chain.otherwise(_offset_text(seconds, ":"))


def format_timestamp(
    ts: Column, strftime: str, timezone: str = "UTC", nanos: Column | None = None
) -> Column:
    """Text of the instant in a zone. Needs the session zone UTC, as ``prepare_session`` sets.

    ``nanos`` are the 0-999 nanoseconds behind the instant's microseconds.
    """
    zone = display_zone(timezone)
    local = ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)
    offset = (F.unix_micros(local) - F.unix_micros(ts)) / 1_000_000
    behind = F.lpad(F.coalesce(nanos, F.lit(0)).cast("string"), 3, "0") if nanos is not None else (
        F.lit("000")
    )
    digits = F.concat(F.date_format(local, "SSSSSS"), behind)
    # As many digits as there are, three at a time; none for a whole second.
    shown = (
        F.when(digits == "000000000", F.lit(""))
        .when(F.endswith(digits, F.lit("000000")), F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .when(F.endswith(digits, F.lit("000")), F.concat(F.lit("."), F.substring(digits, 1, 6)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    seconds = F.lpad((F.abs(offset).cast("bigint") % 60).cast("string"), 2, "0")
    own = {
        "%z": lambda: _offset_text(offset, ""),
        "%:z": lambda: _offset_text(offset, ":"),
        "%Z": lambda: _zone_name(offset, zone),
        "%::z": lambda: F.concat(_offset_text(offset, ":"), F.lit(":"), seconds),
        "%N": lambda: digits,
        "%f": lambda: digits,
        "%9f": lambda: digits,
        "%.9f": lambda: F.concat(F.lit("."), digits),
        "%.f": lambda: shown,
        "%s": lambda: F.floor(F.unix_micros(ts) / 1_000_000).cast("bigint").cast("string"),
        "%P": lambda: F.lower(F.date_format(local, "a")),
    }

    def text(mine: bool, part: str) -> Column:
        if not mine:
            return F.date_format(local, part)
        return own[part]() if part in own else _number_text(part, local)

    parts = [text(mine, part) for mine, part in _pieces(strftime)]
    return parts[0] if len(parts) == 1 else F.concat(*parts) if parts else F.lit("")
