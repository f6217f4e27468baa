"""The log table: one typed row per line of text."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.functions import classify, fields, levels, repair, timestamps, values
from lograft.functions.offence import offence
from lograft.options import LogOptions
from lograft.session import prepare_session
from lograft.tables import ROLES

_TEXT_ROLES = ROLES[2:]

# Columns of the log table behind those the caller brings along.
LOG_COLUMNS = (
    "kind", "prefix", "ts", "ts_nanos", "level", "level_num", "message", "logger", "caller",
    "error", "extra", "extra_text", "raw_json", "parse_error", "ts_text", "raw_text",
)

# Metadata of the column the log table was read from.
PARSED = "lograft.parsed"

# Working columns, all dropped at the end.
_PART, _BEFORE, _FIRST, _FIRST_OK, _FIXED, _SECOND = (
    "_part", "_before", "_first", "_first_ok", "_fixed", "_second",
)
_MEMBERS, _RECORD, _KEYS, _CONSUMED, _LEVEL_TEXT, _TS_TEXT = (
    "_members", "_record", "_keys", "_consumed", "_level_text", "_ts_text",
)


def _own(lines: DataFrame) -> list[Column]:
    return [F.col(f"`{name}`") for name in lines.columns]


def _level_number(key: Column, options: LogOptions) -> Column:
    record, text = F.col(_RECORD), F.col(_LEVEL_TEXT)
    number = values.is_number(text, record, F.col(_MEMBERS), key)
    return F.when(number, levels.level_from_number(text.cast("double"))).otherwise(
        levels.level_from_name(text, options.level_aliases)
    )


_BUILT: dict[tuple, SimpleNamespace] = {}
_MOST_BUILT = 32


def _columns(column: str, options: LogOptions) -> SimpleNamespace:
    """The expressions of the parse. They name columns only, and building them takes longer than
    planning with them, so they are kept for further tables read with the same keys."""
    wanted = (
        SparkContext._active_spark_context.applicationId, column,
        tuple(options.keys_of(role) for role in ROLES), tuple(options.level_aliases.items()),
    )
    if wanted not in _BUILT:
        if len(_BUILT) >= _MOST_BUILT or any(w[0] != wanted[0] for w in _BUILT):
            _BUILT.clear()
        _BUILT[wanted] = _build(column, options)
    return _BUILT[wanted]


def _build(column: str, options: LogOptions) -> SimpleNamespace:
    text = classify.trimmed(F.col(f"`{column}`"))
    part, before, members, record = (F.col(c) for c in (_PART, _BEFORE, _MEMBERS, _RECORD))
    doubled = F.col(_FIRST_OK).isNull() & F.contains(part, F.lit("\\\\"))
    repaired = F.when(
        F.col(_FIXED).isNotNull(), classify.checked_fields(F.col(_FIXED), F.col(_SECOND))
    )
    chosen = F.when(F.col(_FIRST_OK).isNotNull(), part).otherwise(F.col(_FIXED))
    keys = fields.role_keys(members, options)
    # One column per key: a struct would be taken apart again, its parts repeated where used.
    found_key = {role: F.col(f"_{role}_key") for role in keys}
    key_of = {role: F.col(_KEYS)[role] for role in keys}
    passed_on = [F.col(c) for c in (_MEMBERS, _RECORD, _CONSUMED, _TS_TEXT, "_level")]
    passed_on.append(F.struct(*[k.alias(role) for role, k in found_key.items()]).alias(_KEYS))
    is_record = members.isNotNull()
    kind = (
        F.when(is_record & before.isNull(), F.lit("json"))
        .when(is_record, F.lit("embedded"))
        .otherwise(F.lit("raw"))
    )
    raw_json, consumed, instant = F.col("raw_json"), F.col(_CONSUMED), F.col("_instant")
    as_read = [F.col("_read")[place] for place in range(len(_TEXT_ROLES))]
    differing = F.lit(False)
    for text_read in as_read:
        differing = differing | F.coalesce(values.may_differ(text_read), F.lit(False))
    texts = F.when(
        differing,
        F.transform(
            F.array(*[key_of[role] for role in _TEXT_ROLES]),
            lambda key, at: values.value_text(F.col("_read")[at], raw_json, members, key),
        ),
    ).otherwise(F.col("_read"))
    has_json = raw_json.isNotNull()
    return SimpleNamespace(
        cut=[classify.json_part(text).alias(_PART), classify.text_before_json(text).alias(_BEFORE)],
        first=classify.read_fields(part).alias(_FIRST),
        first_ok=classify.checked_fields(part, F.col(_FIRST)).alias(_FIRST_OK),
        fixed=F.when(doubled, repair.un_double_escape(part)).alias(_FIXED),
        second=classify.read_fields(F.col(_FIXED)).alias(_SECOND),
        members=F.coalesce(F.col(_FIRST_OK), repaired).alias(_MEMBERS),
        record=chosen.alias(_RECORD),
        keys=[key.alias(f"_{role}_key") for role, key in keys.items()],
        consumed=fields.consumed_keys(list(found_key.values())).alias(_CONSUMED),
        typed_texts=[
            F.try_element_at(members, found_key["timestamp"]).alias(_TS_TEXT),
            F.try_element_at(members, found_key["level"]).alias(_LEVEL_TEXT),
        ],
        level=_level_number(found_key["level"], options).alias("_level"),
        settled=F.inline(F.array(F.struct(*passed_on))),
        line=[
            kind.alias("kind"),
            F.when(is_record, before).alias("prefix"),
            F.when(is_record, record).alias("raw_json"),
            classify.parse_problem(kind, part).alias("parse_error"),
        ],
        read=F.array(
            *[F.try_element_at(members, key_of[role]) for role in _TEXT_ROLES]
        ).alias("_read"),
        found=[
            _instant(key_of["timestamp"]).alias("_instant"),
            _instant_text(key_of["timestamp"]).alias("ts_text"),
            texts.alias("_texts"),
        ],
        table=[
            F.col("kind"),
            F.col("prefix"),
            instant["ts"].alias("ts"),
            F.when(instant["ts"].isNotNull(), instant["nanos"]).alias("ts_nanos"),
            levels.level_name(F.col("level_num")).alias("level"),
            F.col("level_num"),
            *[F.col("_texts")[place].alias(role) for place, role in enumerate(_TEXT_ROLES)],
            F.when(has_json, fields.extra_variants(raw_json, members, consumed)).alias("extra"),
            F.when(has_json, fields.extra_texts(members, raw_json, consumed)).alias("extra_text"),
            raw_json,
            F.col("parse_error"),
            F.col("ts_text"),
            F.when(~has_json, F.col(f"`{column}`")).alias("raw_text"),
        ],
    )


def _gated(lines: DataFrame, made: SimpleNamespace) -> DataFrame:
    """The lines with the text their record may be in and what the gate made of it."""
    own = _own(lines)
    return (
        lines.select(*own, *made.cut)
        .select("*", made.first)
        .select(*own, _PART, _BEFORE, made.first_ok)
        .select("*", made.fixed)
        .select("*", made.second)
        .select(*own, _PART, _BEFORE, made.members, made.record)
    )


def sorted_lines(lines: DataFrame, column: str) -> DataFrame:
    """The lines with ``kind``, ``prefix``, ``raw_json``, ``parse_error`` and the possible record,
    without looking at its members."""
    prepare_session(lines.sparkSession)
    made = _columns(column, LogOptions())
    return _gated(lines, made).select(*_own(lines), *made.line, _PART)


def classified(lines: DataFrame, column: str, options: LogOptions) -> DataFrame:
    """The lines with the members of their record, the keys of its roles and what they use up.

    Each select keeps the column it adds from being computed again by the next. The last step
    hands the columns on through a one-element generator: a filter on anything computed from
    them would otherwise be pushed below the projections, with a second copy of the parse.
    """
    prepare_session(lines.sparkSession)
    made = _columns(column, options)
    own = _own(lines)
    return (
        _gated(lines, made)
        .select("*", *made.keys)
        .select("*", *made.typed_texts)
        .select("*", made.consumed, made.level)
        .select(*own, _PART, _BEFORE, made.settled)
        .select(
            *own, *made.line, _PART, _MEMBERS, _KEYS, _CONSUMED, _TS_TEXT,
            F.col("_level").alias("level_num"),
        )
    )


def _instant(key: Column) -> Column:
    record, text = F.col("raw_json"), F.col(_TS_TEXT)
    whole = F.when(~text.rlike("[.E]"), text.try_cast("bigint"))
    fraction = text.try_cast("double")
    from_number = F.when(
        whole.isNotNull(),
        F.struct(
            timestamps.ts_from_epoch(whole).alias("ts"),
            timestamps.nanos_from_epoch(whole).alias("nanos"),
        ),
    ).otherwise(
        F.struct(
            timestamps.ts_from_float(fraction).alias("ts"),
            timestamps.nanos_from_float(fraction).alias("nanos"),
        )
    )
    from_text = F.struct(
        timestamps.ts_from_string(text).alias("ts"),
        F.coalesce(timestamps.nanos_from_string(text), F.lit(0).cast("smallint")).alias("nanos"),
    )
    return F.when(values.is_number(text, record, F.col(_MEMBERS), key), from_number).otherwise(from_text)


def _instant_text(key: Column) -> Column:
    """The instant as it was written; a number in its shortest decimal text."""
    text = F.col(_TS_TEXT)
    fraction = text.rlike("[.E]|[0-9]{19}")
    number = values.is_number(text, F.col("raw_json"), F.col(_MEMBERS), key)
    return F.when(fraction & number, values.number_text(text)).otherwise(text)


def parse_logs(
    lines: DataFrame, column: str = "line", options: LogOptions | None = None
) -> DataFrame:
    """Turn the string column ``column`` into the log table; other columns are kept.

    Row by row, so it works on batches and streams alike. ``extra`` (typed) and ``extra_text``
    (as shown) each cost work only where they are used.
    """
    options = options or LogOptions()
    clash = sorted(set(lines.columns) & set(LOG_COLUMNS))
    if clash:
        raise ValueError(f"columns named like those of the log table: {', '.join(clash)}")
    made = _columns(column, options)
    return (
        classified(lines, column, options)
        .select("*", made.read)
        .select("*", *made.found)
        .select(*_marked(lines, column), *made.table)
    )


def _marked(lines: DataFrame, column: str) -> list[Column]:
    """The caller's columns; the one that was parsed is marked in its metadata."""
    return [
        F.col(f"`{name}`").alias(name, metadata={PARSED: True}) if name == column else F.col(f"`{name}`")
        for name in lines.columns
    ]


def classify_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """``kind``, ``prefix``, ``raw_json`` and ``parse_error`` only."""
    return sorted_lines(lines, column).drop(_PART)


def with_error_positions(logs: DataFrame) -> DataFrame:
    """``parse_error`` with line and column of the first offence, and what kind it is.

    Works on the log table and on classified lines that kept ``raw_text`` (or ``line``). Raw lines with
    a brace go through a scan in Python, in Arrow batches; others are not touched.
    """
    text = "raw_text" if "raw_text" in logs.columns else "line"
    failing = F.when(F.col("parse_error").isNotNull(), F.col(text))
    found = logs.withColumn("_offence", offence(failing))
    return found.withColumn("parse_error", F.col("_offence")).drop("_offence")


def with_matched_alias(
    lines: DataFrame, role: str, column: str = "line", options: LogOptions | None = None
) -> DataFrame:
    """Add ``matched_alias``: the name under which a record carries ``role``, if any."""
    options = options or LogOptions()
    read = classified(lines, column, options)
    matched = fields.matched_key(F.col(_MEMBERS), options.keys_of(role))
    return read.select(*_own(lines), "kind", "prefix", "raw_json", matched.alias("matched_alias"))
