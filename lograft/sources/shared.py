"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lograft-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session uses a temporary folder; a cluster has no folder that all
    its executors see, so there this is an error.
    """
    name = "spark.checkpoint.dir"
    folder = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"set {name} to a folder that all executors share")
    return _own_folder()


_collected: ContextVar[list[str] | None] = ContextVar("collected", default=None)


def new_path(spark: SparkSession, purpose: str = "kept") -> str:
    """A path nobody uses yet, in the shared folder; its files go when the application ends, or
    with the :func:`passing` it is made in."""
    path = f"{shared_folder(spark)}/lograft-{purpose}-{uuid.uuid4().hex}"
    held = _collected.get()
    if held is not None:
        held.append(path)
    else:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside are removed at its end, as an application that runs on needs."""
    held: list[str] = []
    token = _collected.set(held)
    try:
        yield
    finally:
        _collected.reset(token)
        for path in held:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def kept(table: DataFrame) -> DataFrame:
    """``table`` written to the shared folder and read back, with its size known to Spark."""
    spark = table.sparkSession
    path = new_path(spark)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
