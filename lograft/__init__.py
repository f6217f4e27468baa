"""Structured log lines as a typed table, on Spark."""

from lograft.operators.chain import format_files
from lograft.operators.filters import drop_empty, filter_logs, records_only
from lograft.operators.multiline import number_lines, reassemble_lines
from lograft.operators.parse import classify_lines, parse_logs, with_matched_alias
from lograft.operators.project import project_fields, select_fields, with_shown_fields
from lograft.operators.render import format_lines, render_logs
from lograft.options import LogOptions, OptionError
from lograft.session import prepare_session
from lograft.sinks.writers import text_entries, write_in_order, write_log_table, write_logs
from lograft.sources.files import drop_invalid, read_log_files, stream_log_files

__all__ = [
    "LogOptions",
    "OptionError",
    "classify_lines",
    "drop_empty",
    "drop_invalid",
    "filter_logs",
    "format_files",
    "format_lines",
    "number_lines",
    "parse_logs",
    "prepare_session",
    "project_fields",
    "read_log_files",
    "reassemble_lines",
    "records_only",
    "render_logs",
    "select_fields",
    "stream_log_files",
    "text_entries",
    "with_matched_alias",
    "with_shown_fields",
    "write_in_order",
    "write_log_table",
    "write_logs",
]
