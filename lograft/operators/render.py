"""The entries as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.functions.render import raw_text, record_text
from lograft.operators.filters import drop_empty, filter_logs, records_only
from lograft.operators.parse import parse_logs, with_error_positions
from lograft.options import LogOptions
from lograft.session import prepare_session


def render_logs(logs: DataFrame, options: LogOptions | None = None) -> DataFrame:
    """Add ``rendered``; entries whose text is empty are dropped.

    In JSON mode the text is the record as it was read, and raw lines are dropped.
    """
    options = options or LogOptions()
    prepare_session(logs.sparkSession)
    if options.json_output:
        return records_only(logs).withColumn("rendered", F.col("raw_json"))
    if options.verbose:
        logs = with_error_positions(logs)
    rendered = F.when(F.col("kind") == "raw", raw_text(options)).otherwise(record_text(options))
    return drop_empty(logs).withColumn("rendered", rendered)


def format_lines(
    lines: DataFrame, column: str = "line", options: LogOptions | None = None
) -> DataFrame:
    """Parse, filter and render a string column in one go (lines are not reassembled)."""
    options = options or LogOptions()
    return render_logs(filter_logs(parse_logs(lines, column, options), options), options)
