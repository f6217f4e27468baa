"""What is shown of the leftover fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.functions.render import chosen_fields, shown_fields
from lograft.options import LogOptions
from lograft.session import prepare_session


def project_fields(logs: DataFrame, options: LogOptions) -> DataFrame:
    """Keep the chosen leftover fields in ``extra`` and ``extra_text``; the error stays."""
    prepare_session(logs.sparkSession)
    for name in ("extra", "extra_text"):
        if name in logs.columns:
            logs = logs.withColumn(name, chosen_fields(F.col(name), options))
    return logs


def with_shown_fields(logs: DataFrame, options: LogOptions) -> DataFrame:
    """Add ``fields``: the chosen leftover fields in key order, values shortened."""
    return logs.withColumn("fields", shown_fields(F.col("extra_text"), options))


def select_fields(logs: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Leftover fields as columns of their own, null where a record lacks them."""
    return logs.select(
        *[F.col(name) for name in keep],
        *[F.try_element_at(F.col("extra_text"), F.lit(name)).alias(name) for name in names],
    )
