"""Token counts of texts, from a cache of counts by content and tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.llm.common import id_and_text, ship
from lograft.llm.tokens import TokenizerFile, encoder
from lograft.sources.shared import new_path

CACHE_SCHEMA = "digest binary, n_tokens bigint"


def normal_content(text: Column, tokenizer: TokenizerFile) -> Column:
    """What of a text the count depends on: where white space only separates, its words."""
    body = F.coalesce(text, F.lit(""))
    if not tokenizer.white_free:
        return body
    return F.trim(F.regexp_replace(body, r"[\x20\x09-\x0D]+", " "))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def count_tokens(
    docs: DataFrame,
    tokenizer: TokenizerFile,
    cache_path: str | None = None,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    Content and tokenizer version are digested together and joined to the counts stored in
    ``cache_path`` (a Parquet folder; without one, a cache for this call). Contents the cache lacks
    are encoded once each, however many rows hold them, and appended to it; an entry appended twice
    by two runs counts once. Known contents are not encoded, and only texts of misses are shuffled.
    A null text counts as the empty one: 0 tokens. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    read = id_and_text(docs, id_col, text_col)
    content = normal_content(F.col("text"), tokenizer)
    digest = F.unhex(F.sha2(F.concat(F.lit(tokenizer.version() + "/"), content), 256))
    keyed = read.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        digest.alias("digest"),
    )
    contents = read.select(digest.alias("digest"), content.alias("content"))
    path = cache_path or new_path(spark, "token-counts")
    if cache_path and _exists(spark, path):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path).select("digest")
        missing = keyed.select("digest").distinct().join(stored, "digest", "left_anti")
        contents = contents.join(missing, "digest", "left_semi")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            counts = [encode.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    once = contents.groupBy("digest").agg(F.first("content").alias("content"))
    once.mapInArrow(encoded, CACHE_SCHEMA).write.mode("append").parquet(path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(path).dropDuplicates(["digest"])
    return keyed.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
