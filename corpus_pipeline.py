"""A corpus pipeline: toxic and poor documents go, one of each group of near copies stays, repeated
passages go, and what is left is packed into sequences of tokens."""

from __future__ import annotations

import os
import sys

_ROOT = os.path.dirname(os.path.abspath(__file__))
if _ROOT not in sys.path:
    sys.path.insert(0, _ROOT)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lograft.llm.common import free_name, table  # noqa: E402
from lograft.llm.jaccard import similar_classes  # noqa: E402
from lograft.llm.packing import pack_documents  # noqa: E402
from lograft.llm.quality import with_quality  # noqa: E402
from lograft.llm.queries import word_bpe  # noqa: E402
from lograft.llm.suffix import repeated_bytes  # noqa: E402
from lograft.llm.toxicity import learn, with_toxicity  # noqa: E402
from lograft.sources.shared import kept  # noqa: E402

#: From this score on a document is toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC``; learned from the labelled ones that are not held out."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_toxicity")
    return with_toxicity(docs, model, "text", score).where(F.col(score) < TOXIC).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    quality = free_name(docs, "_quality")
    return with_quality(docs, out=quality).where(F.col(quality)["kept"]).drop(quality)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar shingle sets the row with the smallest identifier.

    A null identifier comes last, and of rows with one identifier any one may stay. Texts without
    words are in no group and stay.
    """
    key = free_name(docs, "_row")
    rows = kept(docs.withColumn(key, F.monotonically_increasing_id()))
    classes = similar_classes(rows, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    number = F.col("doc_id").cast("long")
    order = F.struct(number.isNull().alias("last"), number.alias("number"), F.col(key))
    first = classes.join(rows.select(key, "doc_id"), key).groupBy("component_id")
    stay = first.agg(F.min(order).alias("first")).select(F.col(f"first.{key}"))
    return rows.join(stay, key, "left_semi").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 50 bytes of an earlier document; ``n_chars`` follows."""
    rest = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    cut = repeated_bytes(
        docs.withColumnsRenamed(rest), length=50, with_text=True, carry=tuple(rest.values())
    )
    columns = []
    for field in docs.schema.fields:
        name = field.name
        if name == "doc_id":
            columns.append(F.col("doc_id").cast(field.dataType).alias(name))
        elif name == "text":
            columns.append(F.col("kept_text").alias(name))
        elif name == "n_chars":
            size = F.char_length("kept_text").cast(field.dataType)
            columns.append(size.alias(name))
        else:
            columns.append(F.col(rest[name]).alias(name))
    return cut.select(columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return pack_documents(docs, word_bpe(), capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: No SQL says what a learned score, a byte-wise cut and a tokenizer do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
