"""Which entries pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.functions.patterns import has_multi_line_flag, required_texts
from lograft.operators.parse import PARSED
from lograft.options import LogOptions, OptionError
from lograft.session import prepare_session
from lograft.tables import LEVEL_NUMBERS


def at_least(level_num: Column, minimum: int) -> Column:
    """Severity at or above ``minimum``; what has no level (raw lines have none) passes."""
    return F.coalesce(level_num, F.lit(LEVEL_NUMBERS["fatal"])) >= minimum


def jvm_pattern(pattern: str) -> str:
    """The pattern with Unicode classes and ``\\n`` as the only line end.

    ``$`` is the very end, not also the place before a final line end, unless it is multi-line.
    """
    if not has_multi_line_flag(pattern):
        pattern = re.sub(_DOLLAR, lambda m: m[1] or r"\z", pattern)
    return f"(?dU){pattern}"


# An escaped character, a class, or a bare dollar.
_DOLLAR = r"(\\.|\[\^?\]?(?:\\.|\[:\^?[a-z]+:\]|[^\]\\])*\])|\$"


def check_pattern(spark: SparkSession, pattern: str) -> None:
    """Raise for a pattern that does not compile. A constant row: no job is run."""
    try:
        spark.sql(
            "SELECT regexp_count('', :p) AS n", args={"p": jvm_pattern(pattern)}
        ).collect()
    except Exception as problem:
        raise OptionError(f"invalid grep pattern: {pattern!r}") from problem


def matches(pattern: str) -> Column:
    """Any of message, logger, caller, error or a leftover value; a raw line as a whole.

    The pattern finds nothing in null, so absent parts do not match.
    """
    jvm = jvm_pattern(pattern)
    parts = [F.col(name).rlike(jvm) for name in ("message", "logger", "caller", "error")]
    hit = F.coalesce(parts[0], F.lit(False))
    for part in parts[1:]:
        hit = hit | F.coalesce(part, F.lit(False))
    extras = F.exists(F.map_values(F.col("extra_text")), lambda v: v.rlike(jvm))
    hit = hit | F.coalesce(extras, F.lit(False))
    return F.when(F.col("kind") == "raw", F.col("raw_text").rlike(jvm)).otherwise(hit)


_SEARCHED = ("message", "logger", "caller", "error", "extra_text")


def _computed(logs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``logs`` with these columns handed on through a one-element generator.

    A filter on them would otherwise go below the projection that makes them, with a copy of what
    makes each wherever the filter names it.
    """
    rest = [F.col(f"`{c}`") for c in logs.columns if c not in names]
    handed = F.inline(F.array(F.struct(*[F.col(n) for n in names])))
    return logs.select(*rest, handed).select(*[F.col(f"`{c}`") for c in logs.columns])


def may_match(line: Column, pattern: str) -> Column | None:
    """Whether a line as it was read may match, told without reading its record; None where the
    pattern requires no text.

    What is searched is the line itself, or values out of it. A run of letters in a value stands in
    the line as it is, unless the line has escapes.
    """
    wanted = required_texts(pattern)
    if not wanted:
        return None
    may = F.contains(line, F.lit("\\"))
    for text in sorted(wanted):
        may = may | F.contains(line, F.lit(text))
    return may


def _parsed_column(logs: DataFrame) -> str | None:
    """The column the log table was read from, if it is still there."""
    return next((f.name for f in logs.schema.fields if f.metadata.get(PARSED)), None)


def filter_logs(logs: DataFrame, options: LogOptions) -> DataFrame:
    """Minimum level, then pattern, then records only if the output is JSON.

    Lines that cannot match the pattern go before their records are read. The level has no such
    test: a line that is no record passes it, which only reading tells.
    """
    prepare_session(logs.sparkSession)
    column = _parsed_column(logs) if options.grep is not None else None
    if column:
        may = may_match(F.col(f"`{column}`"), options.grep)
        logs = logs if may is None else logs.filter(may)
    if options.min_level_number is not None:
        logs = logs.filter(at_least(F.col("level_num"), options.min_level_number))
    if options.grep is not None:
        check_pattern(logs.sparkSession, options.grep)
        logs = _computed(logs, _SEARCHED).filter(matches(options.grep))
    if options.json_output:
        logs = records_only(logs)
    return logs


def records_only(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("kind") != "raw")


def drop_empty(logs: DataFrame) -> DataFrame:
    """Drop entries whose text is empty. A record has at least its badge, so it is empty lines
    that go; saying so spares the filter from rendering every entry."""
    return logs.filter((F.col("kind") != "raw") | (F.octet_length(F.col("raw_text")) > 0))
