"""One query per operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.functions import repair
from lograft.functions.render import level_badge
from lograft.functions.timestamps import format_timestamp
from lograft.functions.values import variant_text
from lograft.operators.chain import format_files
from lograft.operators.filters import drop_empty, filter_logs, records_only
from lograft.operators.multiline import number_lines, reassemble_lines
from lograft.operators.parse import (
    classify_lines,
    parse_logs,
    with_error_positions,
    with_matched_alias,
)
from lograft.operators.project import project_fields, select_fields, with_shown_fields
from lograft.operators.render import format_lines
from lograft.options import LogOptions
from lograft.plans import recipes
from lograft.sinks.writers import text_entries, write_in_order, write_log_table, write_logs
from lograft.sources.files import decoded_line, drop_invalid, read_log_files, stream_log_files
from lograft.session import prepare_session
from lograft.sources.order import totals_before
from lograft.sources.shared import kept, new_path
from lograft.streaming.live import (
    follow_files,
    live_entries,
    reassemble_stream,
    write_live,
)

Query = Callable[[SparkSession, str], DataFrame]


def micros(column: str = "ts") -> Column:
    return F.unix_micros(F.col(column)).alias("ts_us")


def joined(fields: Column) -> Column:
    """Leftover fields as sorted ``k=v`` text."""
    entries = F.array_sort(F.map_entries(fields))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    ).alias("fields")


def number_of(value: Column, name: str) -> Column:
    return value.cast("bigint").alias(name)


def number(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


def _new_folder(spark: SparkSession, name: str) -> str:
    return new_path(spark, name)


# Sources


def _written(lines: DataFrame, folder: str, *order: str, by: str | None = None) -> str:
    """``lines`` as text files that hold them in ``order``, file after file by name; lines of equal
    ``by`` are in one file."""
    lines.repartitionByRange(by or order[0]).sortWithinPartitions(*order).select(
        "line"
    ).write.text(folder)
    return folder


def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no`` counts from 0 in each file: it falls behind ``position`` by a constant."""
    folder = _written(recipes.pino_lines(spark, sf_dir), _new_folder(spark, "lines"), "event_id")
    lines, missing, n_lines = read_log_files(spark, [folder, folder + "-missing"], numbered=True)
    logs = parse_logs(drop_invalid(lines))
    firsts = lines.groupBy("source").agg(F.min("position").alias("first"))
    return select_fields(
        logs.join(F.broadcast(firsts), "source")
        .withColumn("n_missing", F.lit(len(missing)).cast("bigint"))
        .withColumn("n_lines", F.lit(n_lines).cast("bigint"))
        .withColumn("numbered", F.col("line_no") + F.col("first") == F.col("position")),
        ["id"],
        ["level", "message", "n_missing", "n_lines", "position", "numbered"],
    )


def read_files_unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default read: one scan, no numbers."""
    folder = _written(recipes.pino_lines(spark, sf_dir), _new_folder(spark, "lines"), "event_id")
    logs = parse_logs(drop_invalid(read_log_files(spark, folder).lines))
    return select_fields(logs, ["id"], ["level", "message"])


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, out = _new_folder(spark, "lines"), _new_folder(spark, "entries")
    options = LogOptions(single_line=True, line_gap=0)
    recipes.pino_lines(spark, sf_dir).select("line").write.text(folder)
    entries = live_entries(stream_log_files(spark, folder), options)
    write_live(entries, out, out + "-checkpoint", options, interval=None).awaitTermination()
    return spark.read.text(out).withColumnRenamed("value", "rendered")


def parse_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.document_lines(spark, sf_dir).select("doc_id", "line"))
    return logs.select("doc_id", "kind", "message", "caller")


def invalid_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.col("line").cast("binary"), F.lit(b"\xff")).cast("string")
    lines = recipes.pino_lines(spark, sf_dir).withColumn(
        "value", F.when(F.col("event_type") == "view", broken).otherwise(F.col("line"))
    )
    decoded = lines.select("event_id", decoded_line(F.col("value")).alias("line"))
    return drop_invalid(decoded).select("event_id")


# Classification and repair


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_lines(
        recipes.mixed_lines(spark, sf_dir).select("event_id", "line")
    ).select("event_id", "kind", "raw_json")


def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = recipes.pino_lines(spark, sf_dir)
    tail = F.col("event_id") % 4
    lines = lines.select(
        "event_id",
        F.when(tail == 0, F.concat("line", F.lit(" junk")))
        .when(tail == 1, F.concat("line", "line"))
        .when(tail == 2, F.concat(F.lit("["), "line", F.lit("]")))
        .otherwise(F.col("line"))
        .alias("line"),
    )
    return classify_lines(lines).select("event_id", "kind")


def pages_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = recipes.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("line"))
    return classify_lines(pages).select("page_id", "kind")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.embedded_lines(spark, sf_dir).select("event_id", "line"))
    return logs.select("event_id", "kind", "prefix", "level", "message", micros())


def double_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = recipes.logrus_lines(spark, sf_dir, error=r'"error":"a\\n\\"b\\"",')
    logs = parse_logs(lines.select("event_id", "line"))
    return logs.select("event_id", "kind", "message", "error", "raw_json")


def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = recipes.conversation_records(spark, sf_dir)
    return lines.select(
        "conv_id", "turn", repair.sanitize_newlines(F.col("line")).alias("sanitized")
    )


def reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = number_lines(recipes.conversation_lines(spark, sf_dir), "source", "position")
    logs = parse_logs(reassemble_lines(lines))
    return select_fields(logs, ["conv", "turn"], ["message"])


def stream_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records split over the micro-batches, and restarts, of a stream: each source's lines come in
    three runs, and its open buffer waits in the state between them."""
    prepare_session(spark)
    folder, out = _new_folder(spark, "arriving"), _new_folder(spark, "log")
    numbered = number_lines(recipes.conversation_lines(spark, sf_dir), "source", "position")
    lines = kept(numbered.select("source", "line_no", "line"))
    for run in range(3):
        mine = F.col("line_no") == run if run < 2 else F.col("line_no") >= run
        lines.where(mine).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(lines.schema).parquet(folder)
        logs = parse_logs(drop_invalid(reassemble_stream(arriving)))
        query = (
            select_fields(logs, ["conv", "turn"], ["message"])
            .writeStream.format("parquet")
            .option("checkpointLocation", out + "-checkpoint")
            .option("path", out)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.parquet(out)


def reassembled_as_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as one source in short blocks, with records of up to 60 lines."""
    lines = recipes.conversation_lines(spark, sf_dir)
    place = F.col("source").cast("decimal(38,0)") * F.lit(1 << 52).cast("decimal(20,0)")
    lines = lines.select(
        F.lit("all").alias("source"), (place + F.col("position")).alias("place"), "line"
    )
    counted = totals_before(
        lines.withColumn("_n", F.lit(1)), recipes.partitions(spark), "place"
    )
    numbered = counted.select("source", F.col("_before").alias("line_no"), "line")
    options = LogOptions(max_continuation_lines=60)
    logs = parse_logs(reassemble_lines(kept(numbered), options, block_lines=64))
    return select_fields(logs, ["conv", "turn"], ["message"])


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut off, with something stray, with something behind the record, and sound ones."""
    mixed, last = F.col("line"), F.pmod("event_id", F.lit(10))
    lines = recipes.mixed_lines(spark, sf_dir).select(
        "event_id",
        F.when(last == 4, F.regexp_replace(mixed, r"\}$", ""))
        .when(last == 5, F.concat(F.lit("at 7 "), mixed, F.lit(" junk}")))
        .when(last == 6, F.replace(mixed, F.lit('"msg":'), F.lit('"msg":\n}')))
        .when(last == 7, F.replace(mixed, F.lit('"msg":"'), F.lit('"msg":"\\x')))
        .otherwise(mixed)
        .alias("line"),
    )
    read = with_error_positions(classify_lines(lines))
    error = F.col("parse_error")
    return read.select(
        "event_id", error["message"].alias("problem"), number_of(error["line"], "at_line"),
        number_of(error["column"], "at_column"),
    )


# Extraction


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.zap_lines(spark, sf_dir).select("event_id", "line"))
    return logs.select("event_id", "message", "logger", "caller", "error", "ts_text")


def custom_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = LogOptions(message_key="caller", logger_key="cents")
    logs = parse_logs(recipes.zap_lines(spark, sf_dir).select("event_id", "line"), options=options)
    return logs.select("event_id", "message", "logger", "caller", joined(F.col("extra_text")))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = recipes.embedded_lines(spark, sf_dir).select("event_id", "line")
    return with_matched_alias(lines, "message").select("event_id", "matched_alias")


def instants(recipe, spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipe(spark, sf_dir).select("event_id", "line"))
    return logs.select("event_id", micros(), number("ts_nanos"))


def level_of(recipe, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    lines = recipe(spark, sf_dir).select("event_id", "line")
    logs = parse_logs(lines, options=LogOptions(**options))
    return logs.select("event_id", "level", number("level_num"))


def role_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message that is an object, and one that is a number."""
    lines = recipes.pino_lines(spark, sf_dir).select("event_id", "line")
    options = LogOptions(message_key="props", logger_key="pid")
    return parse_logs(lines, options=options).select("event_id", "message", "logger")


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.pino_lines(spark, sf_dir).select("event_id", "line"))
    texts = F.transform_values(F.col("extra"), lambda k, v: variant_text(v))
    return logs.select("event_id", joined(texts))


def extra_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.document_lines(spark, sf_dir).select("doc_id", "line"))
    return logs.select("doc_id", joined(F.col("extra_text")))


def nested_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers inside objects and arrays that are shown as JSON."""
    lines = recipes.spread(recipes.nested_number_lines(spark, sf_dir).select("event_id", "line"))
    return parse_logs(lines).select("event_id", "message", joined(F.col("extra_text")))


# Filters


def line_end_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``$`` is the end of the text, not the place before a last line end."""
    documents = recipes.table(spark, sf_dir, "documents")
    text = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    lines = documents.select("doc_id", F.to_json(F.struct(text.alias("msg"))).alias("line"))
    return filter_logs(parse_logs(lines), LogOptions(grep=r"[.]$")).select("doc_id")


def escaped_group_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An escaped parenthesis before an ``m`` switches no flag on."""
    documents = recipes.table(spark, sf_dir, "documents")
    even = F.pmod("doc_id", F.lit(2)) == 0
    text = F.when(even, F.lit("main")).otherwise(F.lit("main\n"))
    lines = documents.select("doc_id", F.to_json(F.struct(text.alias("msg"))).alias("line"))
    return filter_logs(parse_logs(lines), LogOptions(grep=r"\(?main$")).select("doc_id")


def other_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in another column than ``line``, next to one of that name."""
    documents = recipes.table(spark, sf_dir, "documents")
    lines = documents.select("doc_id", F.lit("unrelated").alias("line"), "text")
    entries = format_lines(lines, "text", LogOptions(grep="[a-z]"))
    return entries.select("doc_id", "line", "rendered")


def filtered(recipe, options: LogOptions, columns, spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = recipe(spark, sf_dir)
    own = [name for name in ("event_id", "doc_id") if name in lines.columns]
    logs = parse_logs(lines.select(*own, "line"), options=options)
    return filter_logs(logs, options).select(*own, *columns)


def raw_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = recipes.table(spark, sf_dir, "documents")
    logs = parse_logs(documents.select("doc_id", F.col("text").alias("line")))
    return filter_logs(logs, LogOptions(grep="(ing|tion)s? [a-m]")).select("doc_id", "kind")


def without_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.mixed_lines(spark, sf_dir).select("event_id", "line"))
    return drop_empty(logs).select("event_id", "kind")


def only_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.mixed_lines(spark, sf_dir).select("event_id", "line"))
    return records_only(logs).select("event_id", "kind", "message")


# Projections


def projected(options: LogOptions, spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.pino_lines(spark, sf_dir).select("event_id", "line"))
    return project_fields(logs, options).select("event_id", joined(F.col("extra_text")))


def shown(options: LogOptions, spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.document_lines(spark, sf_dir).select("doc_id", "line"))
    text = F.transform(F.col("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return with_shown_fields(logs, options).select("doc_id", F.array_join(text, ";").alias("fields"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.pino_lines(spark, sf_dir).select("line"))
    view = select_fields(logs, ["id", "pid", "props.k", "absent"], ["level"])
    return view.select("id", "pid", F.col("`props.k`").alias("k"), "absent", "level")


# Rendering


def rendered(recipe, options: LogOptions, spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = recipe(spark, sf_dir).select("event_id", "line")
    return format_lines(lines, options=options).select("event_id", "rendered")


def badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.mixed_lines(spark, sf_dir).select("event_id", "line"))
    return logs.select("event_id", level_badge(F.col("level_num"), LogOptions()).alias("badge"))


def stamps(strftime: str, timezone: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(recipes.logrus_lines(spark, sf_dir).select("event_id", "line"))
    shown = format_timestamp(F.col("ts"), strftime, timezone, F.col("ts_nanos"))
    return logs.select("event_id", shown.alias("shown"))


def zoned_stamps(strftime: str, timezone: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants spread over a year, so that both halves of a zone's year occur."""
    events = recipes.table(spark, sf_dir, "events")
    day = F.pmod("event_id", F.lit(365)) * 86_400_000_000
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + day)
    return events.select("event_id", format_timestamp(at, strftime, timezone).alias("shown"))


def local_stamps(strftime: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone ``local`` is that of the machine that plans the query; it is named here."""
    named = os.environ.get("TZ")
    os.environ["TZ"] = "America/New_York"
    try:
        return zoned_stamps(strftime, "local", spark, sf_dir)
    finally:
        os.environ.pop("TZ") if named is None else os.environ.update(TZ=named)


def fraction_stamps(strftime: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants with and without thousandths, millionths and billionths, spread over the years."""
    events = recipes.table(spark, sf_dir, "events")
    last = F.pmod("event_id", F.lit(4))
    day = F.pmod("event_id", F.lit(3000)) * 86_400_000_000
    micros_ = F.unix_micros(F.col("ts").cast("timestamp")) + day
    second = F.call_function("div", micros_, F.lit(1_000_000)) * 1_000_000
    at = F.timestamp_micros(
        F.when(last == 0, second).when(last == 1, second + 7000).otherwise(second + 120034)
    )
    nanos = F.when(last == 3, F.lit(5)).otherwise(0)
    shown = format_timestamp(at, strftime, "UTC", nanos)
    return events.select("event_id", shown.alias("shown"))


def long_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records so long that the quick parse of typed values refuses them."""
    long = F.pmod("event_id", F.lit(2000)) == 0
    filler = F.repeat(F.lit("a"), F.when(long, 17_000_000).otherwise(10).cast("int"))
    lines = recipes.spread(recipes.pino_lines(spark, sf_dir)).select(
        "event_id",
        F.regexp_replace("line", r"\}$", "") .alias("head"), filler.alias("filler"),
    ).select(
        "event_id", F.concat("head", F.lit(',"x":"'), "filler", F.lit('"}')).alias("line")
    )
    logs = parse_logs(lines)
    shown = F.transform_values(
        F.col("extra_text"), lambda k, v: F.when(F.length(v) > 99, F.length(v).cast("string")).otherwise(v)
    )
    kinds = F.transform_values(F.col("extra"), lambda k, v: F.schema_of_variant(v))
    return logs.select(
        "event_id", "level", "message", joined(shown), F.element_at(kinds, "pid").alias("pid_type")
    )


def files_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken records in files, through the whole chain in one call; entries in input order."""
    prepare_session(spark)
    conv = F.col("source").cast("bigint")
    lines = recipes.conversation_lines(spark, sf_dir).withColumn("conv", conv)
    folder = _written(lines, _new_folder(spark, "broken"), "conv", "position", by="conv")
    options = LogOptions(single_line=True, include_fields=("conv", "turn"), line_gap=0)
    found = format_files(spark, folder, options)
    out = _new_folder(spark, "entries")
    write_in_order(found.entries, out, found.n_lines, options)
    # A message of several lines is shown with its line ends, so an entry takes as many lines.
    return read_log_files(spark, out, numbered=True).lines.select(
        "position", F.col("line").alias("rendered")
    )


def followed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over files that appear in a folder, by one run of a stream."""
    prepare_session(spark)
    folder, out = _new_folder(spark, "appearing"), _new_folder(spark, "followed")
    options = LogOptions(single_line=True, include_fields=("conv", "turn"), line_gap=0)
    conv = F.col("source").cast("bigint")
    lines = recipes.conversation_lines(spark, sf_dir).withColumn("conv", conv)
    _written(lines, folder, "conv", "position", by="conv")
    follow_files(
        spark, folder, out, out + "-checkpoint", options, interval=None
    ).awaitTermination()
    return spark.read.text(out).select(F.col("value").alias("rendered"))


_with_error = partial(recipes.logrus_lines, error=r'"error":"first\r\nsecond\nthird\n",')


# Sinks


def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in input order, with a blank line behind each."""
    options = LogOptions(single_line=True, line_gap=1)
    folder = _written(recipes.pino_lines(spark, sf_dir), _new_folder(spark, "lines"), "event_id")
    found = format_files(spark, folder, options)
    out = _new_folder(spark, "entries")
    write_in_order(found.entries, out, found.n_lines, options)
    return read_log_files(spark, out, numbered=True).lines.select(
        "position", F.col("line").alias("rendered")
    )


def text_sink_by_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the order of a column of the caller's."""
    options = LogOptions(single_line=True, line_gap=0)
    folder = _new_folder(spark, "entries")
    lines = recipes.pino_lines(spark, sf_dir).select("event_id", "line")
    write_logs(format_lines(lines, options=options), folder, options, order=("event_id",))
    return read_log_files(spark, folder, numbered=True).lines.select(
        "position", F.col("line").alias("rendered")
    )


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = LogOptions(json_output=True, min_level="warn", line_gap=0)
    lines = recipes.mixed_lines(spark, sf_dir).select("event_id", "line")
    entries = format_lines(lines, options=options)
    return text_entries(entries, options)


def table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "table")
    logs = parse_logs(recipes.pino_lines(spark, sf_dir).select("event_id", "line"))
    write_log_table(logs.drop("extra_text"), folder)
    back = spark.read.parquet(folder)
    files = back.groupBy("day").agg(F.countDistinct("_metadata.file_name").alias("n_files"))
    texts = F.transform_values(F.col("extra"), lambda k, v: variant_text(v))
    severe = back.filter("level_num >= 40").join(F.broadcast(files), "day")
    return severe.select("event_id", "level", "message", micros(), joined(texts), "n_files")


QUERIES: dict[str, Query] = {
    "read_log_files": read_files,
    "read_unnumbered": read_files_unnumbered,
    "stream_log_lines": stream_lines,
    "parse_column": parse_column,
    "drop_invalid_utf8": invalid_utf8,
    "classify_lines": classified,
    "strict_json": strict_json,
    "classify_pages": pages_as_lines,
    "embedded_json": embedded,
    "double_escape_repair": double_escaped,
    "sanitize_newlines": sanitized,
    "multiline_reassembly": reassembled,
    "multiline_one_source": reassembled_as_one,
    "stream_multiline": stream_reassembled,
    "parse_diagnostics": diagnostics,
    "resolve_fields": resolved,
    "custom_keys": custom_keys,
    "matched_alias": matched,
    "ts_from_string": partial(instants, recipes.logrus_lines),
    "ts_from_epoch": partial(instants, recipes.pino_lines),
    "ts_from_nanos": partial(instants, recipes.embedded_lines),
    "ts_from_float": partial(instants, recipes.zap_lines),
    "ts_rare_shapes": partial(instants, recipes.rare_stamp_lines),
    "epoch_shapes": partial(instants, recipes.epoch_lines),
    "level_from_name": partial(level_of, recipes.logrus_lines),
    "level_from_number": partial(level_of, recipes.pino_lines),
    "level_shapes": partial(level_of, recipes.level_lines),
    "custom_levels": partial(level_of, recipes.zap_lines, level_aliases={"Verbose": "debug"}),
    "role_text": role_text,
    "flatten_extra": flattened,
    "extra_text": extra_text,
    "nested_numbers": nested_numbers,
    "filter_min_level": partial(
        filtered, recipes.pino_lines, LogOptions(min_level="warn"), ("level", "message")
    ),
    "filter_min_level_mixed": partial(
        filtered, recipes.mixed_lines, LogOptions(min_level="error"), ("kind", "level")
    ),
    "grep_fields": partial(
        filtered, recipes.document_lines, LogOptions(grep=r"\bsrc[0-4]\b|^fr$"), ("caller",)
    ),
    "grep_raw": raw_grep,
    "grep_line_end": line_end_grep,
    "grep_escaped_group": escaped_group_grep,
    "parse_other_column": other_column,
    "json_records_only": only_records,
    "drop_empty": without_empty,
    "filter_combined": partial(
        filtered,
        recipes.mixed_lines,
        LogOptions(min_level="info", grep="^(error|7)$|plain e", json_output=False),
        ("kind", "level"),
    ),
    "include_fields": partial(projected, LogOptions(include_fields=("props.k", "nope"))),
    "exclude_fields": partial(projected, LogOptions(exclude_fields=("props.k", "nope"))),
    "no_extra": partial(projected, LogOptions(no_extra=True)),
    "truncate_values": partial(shown, LogOptions(max_field_length=40)),
    "sorted_extras": partial(shown, LogOptions(max_field_length=0)),
    "select_fields": wide,
    "render_text": partial(rendered, recipes.pino_lines, LogOptions()),
    "render_embedded": partial(rendered, recipes.embedded_lines, LogOptions()),
    "render_mixed": partial(rendered, recipes.mixed_lines, LogOptions(single_line=True, verbose=True)),
    "level_badge": badges,
    "render_single_line": partial(rendered, recipes.zap_lines, LogOptions(single_line=True)),
    "render_slog": partial(rendered, recipes.slog_lines, LogOptions(single_line=True)),
    "render_bunyan": partial(rendered, recipes.bunyan_lines, LogOptions(single_line=True)),
    "render_structlog": partial(rendered, recipes.structlog_lines, LogOptions(single_line=True)),
    "render_error_block": partial(rendered, _with_error, LogOptions(key_min_width=8)),
    "format_timestamp": partial(stamps, "%d.%m.%Y %H:%M:%S%.6f %% %j", "UTC"),
    "timezone_convert": partial(stamps, "%Y-%m-%d %H:%M", "America/New_York"),
    "format_timestamp_zone": partial(
        zoned_stamps, "%FT%T%:z %Z %z %k|%l|%P %e", "America/New_York"
    ),
    "format_timestamp_fraction": partial(
        fraction_stamps, "%S%.f|%f|%-d.%_m.%0e|%c|%x|%X|%u%w|%V %G|%U-%W|%C%g|%+"
    ),
    "timezone_local": partial(local_stamps, "%Y-%m-%d %H:%M %z"),
    "long_records": long_records,
    "files_to_text": files_to_text,
    "follow_files": followed_files,
    "render_ansi": partial(
        rendered,
        recipes.logrus_lines,
        LogOptions(ansi=True, single_line=True, level_colors={"error": "bright_magenta"}),
    ),
    "write_text": text_sink,
    "write_text_by_columns": text_sink_by_columns,
    "json_passthrough": json_sink,
    "log_table": table_sink,
}
