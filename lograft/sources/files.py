"""Log lines from text files and from a live folder of them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.session import prepare_session
from lograft.sources.order import counts_before, totals_before
from lograft.sources.shared import kept


class LogFiles(NamedTuple):
    """``n_lines`` is known where the lines were numbered."""

    lines: DataFrame
    missing: list[str]
    n_lines: int | None = None


def decoded_line(value: Column) -> Column:
    """The line without the ``\\r`` of a ``\\r\\n``; null if it is no valid UTF-8."""
    stripped = F.substring(
        value.cast("binary"), F.lit(1), F.octet_length(value) - 1
    ).cast("string")
    valid = F.when(F.is_valid_utf8(value), value)
    return F.when(F.endswith(valid, F.lit("\r")), stripped).otherwise(valid)


def _plain(uri: Column) -> Column:
    """A path with its scheme, but without an empty authority."""
    return F.regexp_replace(uri, "^([A-Za-z0-9+.-]+):///", "$1:/")


def _existing(
    spark: SparkSession, paths: Sequence[str]
) -> tuple[list[str], list[str], list[tuple[int, str]]]:
    """The paths that are there, those that are not, and what the former stand for, with their
    place in the order given."""
    hadoop = spark._jsc.hadoopConfiguration()
    there, missing, roots = [], [], []
    for place, path in enumerate(dict.fromkeys(paths)):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(hadoop).globStatus(where)
        (there if found else missing).append(path)
        roots += [(place, status.getPath().toUri().toString()) for status in found or ()]
    return there, missing, roots


def _fix_splits(spark: SparkSession) -> None:
    """Files are cut by the number of cores Spark sees; a number that changes between two passes
    would cut them differently, so it is held."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def _in_given_order(splits: DataFrame, roots: list[tuple[int, str]]) -> DataFrame:
    """``splits`` with ``_place``: the first of the given paths a file belongs to."""
    spark = splits.sparkSession
    if len({place for place, _ in roots}) < 2:
        return splits.withColumn("_place", F.lit(0))
    named = spark.createDataFrame(roots, "_place int, _root string").withColumn(
        "_root", _plain(F.col("_root"))
    )
    parts = F.split(_plain(F.col("source")), "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    files = splits.select("source").distinct().select("source", F.explode(above).alias("_root"))
    places = files.join(named, "_root").groupBy("source").agg(F.min("_place").alias("_place"))
    return splits.join(places, "source")


def read_log_files(
    spark: SparkSession, paths: str | Sequence[str], numbered: bool = False
) -> LogFiles:
    """Lines of the files, and the paths that do not exist. A path given twice is read once.

    ``(source, split, row, line)``: in one scan; ``split``, then ``row``, have the order of a source.
    With ``numbered``, ``(source, line_no, position, line)``: numbers from 0 in each source and over
    all files in the order given (those of a folder or pattern by name). That costs one more pass
    to count the lines of each split, and a join with a table of one row per split.

    A line that is no valid UTF-8 has a null ``line``: it keeps its number (a broken record
    counts it) until :func:`drop_invalid`.
    """
    prepare_session(spark)
    _fix_splits(spark)
    there, missing, roots = _existing(spark, [paths] if isinstance(paths, str) else paths)
    own = "line_no bigint, position bigint" if numbered else "split bigint, row bigint"
    if not there:
        empty = spark.createDataFrame([], f"source string, {own}, line string")
        return LogFiles(empty, missing, 0)
    scan = (
        spark.read.option("lineSep", "\n")
        .text(there)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
            "value",
        )
    )
    line = decoded_line(F.col("value")).alias("line")
    if not numbered:
        return LogFiles(scan.select("source", "split", "row", line), missing)
    # Within a split the rows are consecutive: its first row and the lines before it are enough.
    splits = scan.groupBy("source", "split").agg(
        F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    splits = _in_given_order(splits, roots)
    order = ["_place", "source", "split"]
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = totals_before(splits, ranges, *order)
    ordered = ordered.withColumnRenamed("_before", "_all_before")
    bases = kept(
        counts_before(ordered, "source", "split", width=1 << 40).select(
            "source", "split", "_n", (F.col("_before") - F.col("_first")).alias("_base"),
            (F.col("_all_before") - F.col("_before")).alias("_start"),
        )
    )
    n = bases.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    lost = F.raise_error(F.lit("files were cut differently in two passes")).cast("bigint")
    number = F.col("row") + F.coalesce("_base", lost)
    met = scan.join(bases, ["source", "split"], "left")
    return LogFiles(
        met.select(
            "source", number.alias("line_no"), (number + F.col("_start")).alias("position"), line
        ),
        missing,
        n,
    )


def drop_invalid(lines: DataFrame) -> DataFrame:
    """Without the lines that are no valid UTF-8."""
    return lines.filter(F.col("line").isNotNull())


def stream_log_files(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A stream of ``(source, line)`` over the files that appear in a folder."""
    prepare_session(spark)
    reader = spark.readStream.option("lineSep", "\n")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.text(folder).select(
        F.col("_metadata.file_path").alias("source"),
        decoded_line(F.col("value")).alias("line"),
    )
