"""A record as readable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lograft.functions.timestamps import format_timestamp
from lograft.options import LogOptions
from lograft.tables import COLOR_CODES, LEVEL_COLORS, LEVEL_NUMBERS

# Escape sequences of the styled parts.
BOLD = "\x1b[1m"
DIM = "\x1b[2m"
BOLD_CYAN = "\x1b[36;1m"
RED = "\x1b[31m"
BOLD_RED = "\x1b[31;1m"
BOLD_GRAY = "\x1b[38;2;150;150;150;1m"
RESET = "\x1b[0m"


def styled(text: Column, start: str | Column, ansi: bool) -> Column:
    if not ansi:
        return text
    start = F.lit(start) if isinstance(start, str) else start
    return F.concat(start, text, F.lit(RESET))


def right_justified(text: Column, width: int) -> Column:
    """Padded on the left to ``width``, never cut."""
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def level_badge(level_num: Column, options: LogOptions) -> Column:
    """Five characters wide, right-justified; blank for an unknown level."""
    chain = F
    for level, number in LEVEL_NUMBERS.items():
        color = options.level_colors.get(level, LEVEL_COLORS[level])
        badge = styled(F.lit(level.upper().rjust(5)), f"\x1b[{COLOR_CODES[color]};1m", options.ansi)
        chain = chain.when(level_num == number, badge)
    return chain.otherwise(F.lit(" " * 5))


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, a longer text marked by an ellipsis; 0 is no limit."""
    if limit == 0:
        return text
    # A text has no more characters than bytes: only long ones are counted out.
    long = (F.octet_length(text) > limit) & (F.length(text) > limit)
    return F.when(long, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def chosen_fields(extras: Column, options: LogOptions) -> Column:
    """The leftover fields that are shown, by their flattened names."""
    if options.no_extra:
        return F.map_filter(extras, lambda k, v: F.lit(False))
    if options.include_fields is not None:
        return F.map_filter(extras, lambda k, v: k.isin(list(options.include_fields)))
    if options.exclude_fields is not None:
        return F.map_filter(extras, lambda k, v: ~k.isin(list(options.exclude_fields)))
    return extras


def shown_fields(extras: Column, options: LogOptions) -> Column:
    """The leftover fields as an array of (key, shortened value) in key order."""
    return F.transform(
        F.array_sort(F.map_entries(chosen_fields(extras, options))),
        lambda e: F.struct(
            e["key"].alias("key"), truncated(e["value"], options.max_field_length).alias("value")
        ),
    )


def extras_text(extras: Column, options: LogOptions) -> Column:
    if options.no_extra:
        return F.lit("")
    ansi = options.ansi

    def one(key: Column, value: Column) -> Column:
        value = truncated(value, options.max_field_length)
        if options.single_line:
            return F.concat(F.lit(" "), styled(key, BOLD_GRAY, ansi), F.lit("="), value)
        label = styled(right_justified(key, options.key_min_width), BOLD_GRAY, ansi)
        return F.concat(F.lit("\n"), label, F.lit(": "), value)

    entries = F.array_sort(F.map_entries(chosen_fields(extras, options)))
    return F.array_join(F.transform(entries, lambda e: one(e["key"], e["value"])), "")


def error_text(error: Column, options: LogOptions) -> Column:
    """The error: its first line inline, or a block whose further lines are indented."""
    ansi, width = options.ansi, options.key_min_width
    # Line ends are \n or \r\n, and a final one adds no line.
    lines = F.regexp_replace(F.regexp_replace(error, r"\r\n", "\n"), r"\n\z", "")
    if options.single_line:
        first = F.substring_index(lines, "\n", 1)
        text = F.concat(
            F.lit(" "), styled(F.lit("error"), BOLD_RED, ansi), F.lit("="), styled(first, RED, ansi)
        )
    else:
        label = styled(F.lit("error".rjust(width)), BOLD_RED, ansi)
        gap = "\n" + " " * (width + 2)
        gap = f"{RESET}{gap}{RED}" if ansi else gap
        block = F.when(
            F.contains(error, F.lit("\n")), F.replace(lines, F.lit("\n"), F.lit(gap))
        ).otherwise(error)
        text = F.concat(F.lit("\n"), label, F.lit(": "), styled(block, RED, ansi))
    return F.coalesce(text, F.lit(""))


def record_text(options: LogOptions) -> Column:
    """Text of one record, over the columns of the log table."""
    ansi = options.ansi
    stamp = format_timestamp(
        F.col("ts"), options.timestamp_format, options.timezone, F.col("ts_nanos")
    )

    def part(before: str, text: Column, style: str | None, after: str = "") -> Column:
        text = styled(text, style, ansi and style is not None)
        return F.coalesce(F.concat(F.lit(before), text, F.lit(after)), F.lit(""))

    return F.concat(
        part("", stamp, BOLD, "  "),
        level_badge(F.col("level_num"), options),
        F.lit(":"),
        part(" ", F.col("logger"), DIM),
        part(" ", F.col("prefix"), BOLD_CYAN),
        part(" ", F.col("message"), None),
        part(" (", F.col("caller"), DIM, ")"),
        F.coalesce(extras_text(F.col("extra_text"), options), F.lit("")),
        error_text(F.col("error"), options),
    )


def raw_text(options: LogOptions) -> Column:
    """A raw line unchanged, with what was wrong with it underneath when asked for."""
    line = F.col("raw_text")
    if not options.verbose:
        return line
    problem = F.col("parse_error")
    # What offends beyond the bytes, such as a number too large, has no position.
    place = F.concat(
        F.lit("["), problem["line"].cast("string"), F.lit(":"), problem["column"].cast("string"),
        F.lit("] "),
    )
    note = F.concat(
        F.lit("\n  "), styled(F.lit("parse error:"), BOLD_RED, options.ansi), F.lit(" "),
        F.coalesce(place, F.lit("")), styled(problem["message"], DIM, options.ansi),
    )
    return F.concat(line, F.coalesce(note, F.lit("")))
