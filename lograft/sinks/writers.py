"""Where log tables and rendered entries go."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.options import LogOptions


def text_entries(
    rendered: DataFrame, options: LogOptions | None = None, *more: str
) -> DataFrame:
    """One string column: the entry and the blank lines after it; ``more`` columns are kept.

    The writer ends each row with a line end of its own.
    """
    gap = "\n" * (options or LogOptions()).line_gap
    return rendered.select(F.concat(F.col("rendered"), F.lit(gap)).alias("value"), *more)


def write_logs(
    rendered: DataFrame,
    path: str,
    options: LogOptions | None = None,
    order: tuple[str, ...] = (),
    mode: str = "errorifexists",
) -> None:
    """Rendered entries (or JSON, as rendered in JSON mode) as text files.

    They are written as they come, without a shuffle and in no order. Columns in ``order``, such as
    ``("source", "line_no")``, range-partition the rows first, which makes them twice; where lines
    are numbered throughout, :func:`write_in_order` makes them once.
    """
    if order:
        rendered = rendered.orderBy(*order)
    text_entries(rendered, options).write.mode(mode).text(path)


#: Input lines whose entries make one file, and the least worth a task of their own.
LINES_PER_FILE, LEAST_LINES = 500_000, 10_000


def write_in_order(
    rendered: DataFrame,
    path: str,
    n_lines: int,
    options: LogOptions | None = None,
    mode: str = "errorifexists",
) -> None:
    """Rendered entries as text files that hold them in input order, file after file by name.

    ``position`` numbers the input lines from 0 to ``n_lines - 1``, as
    :func:`~lograft.operators.chain.format_files` gives both. The borders between files follow from
    ``n_lines``, so the entries are dealt out as they are made, nothing is sampled, and whatever made
    them runs once; each file's entries are put in order in its own task. Entries with a null
    position, or one beyond ``n_lines``, come last.
    """
    spark = rendered.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_lines // LEAST_LINES))
    files = max(1, least, -(-n_lines // LINES_PER_FILE))
    each = max(1, -(-n_lines // files))
    place = F.coalesce(F.expr(f"position div {each}"), F.lit(files - 1))
    file = F.greatest(F.lit(0), F.least(place, F.lit(files - 1))).cast("int")
    entries = text_entries(rendered, options, "position")
    dealt = entries.repartitionById(files, file).sortWithinPartitions(
        F.asc_nulls_last("position")
    )
    dealt.select("value").write.mode(mode).text(path)


#: Bytes of a row group: small enough that a level's rows are groups of their own in a busy day.
ROW_GROUP_BYTES = 32 << 20


def write_log_table(
    logs: DataFrame,
    path: str,
    mode: str = "errorifexists",
    days: tuple[date, date] | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """The log table as Parquet, by day and within a file by level, so that readers skip both.

    The rows of a day meet in one task, or where they are many in as many as their size asks for:
    Spark rebalances by the sizes it sees, so a busy day is no single task and a quiet one no
    handful of files. Entries without an instant, and with ``days`` those outside its first and
    last day, share one partition, so that stray instants make no folders.
    """
    day = F.to_date("ts")
    if days is not None:
        day = F.when(day.between(*map(F.lit, days)), day)
    table = logs.withColumn("day", day).hint("rebalance", "day")
    (
        table.sortWithinPartitions("day", "level_num")
        .write.mode(mode)
        .option("parquet.block.size", row_group_bytes)
        .partitionBy("day")
        .parquet(path)
    )
