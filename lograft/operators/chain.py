"""The whole chain over files in one call."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from lograft.operators.filters import filter_logs
from lograft.operators.multiline import reassemble_lines
from lograft.operators.parse import parse_logs
from lograft.operators.render import render_logs
from lograft.options import LogOptions
from lograft.sources.files import read_log_files


class FormattedFiles(NamedTuple):
    entries: DataFrame
    missing: list[str]
    n_lines: int


def format_files(
    spark: SparkSession, paths: str | Sequence[str], options: LogOptions | None = None
) -> FormattedFiles:
    """Read, reassemble, parse, filter and render log files.

    ``entries`` has ``source``, ``line_no`` and ``position`` (among the ``n_lines`` lines of all
    files in input order) of each entry's first line next to the log table and ``rendered``;
    ``missing`` are the paths that do not exist. The rows come in no order;
    :func:`~lograft.sinks.writers.write_in_order` writes them in that of ``position``.
    """
    options = options or LogOptions()
    lines, missing, n_lines = read_log_files(spark, paths, numbered=True)
    logs = parse_logs(reassemble_lines(lines, options), "line", options)
    return FormattedFiles(
        render_logs(filter_logs(logs, options), options), missing, n_lines or 0
    )
