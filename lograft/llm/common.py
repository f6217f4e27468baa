"""What the operators of this subpackage share: tables, shipping, groups of documents, numpy hashes."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\x0c\r"

#: Takes the place of a null identifier where an order is needed: it comes last.
LAST = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also where it is not installed on them."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: how finely a user splits data of this size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of text in a group, and of text whose repeats meet in a bucket. A task's numpy arrays take
#: about forty times as much.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20


def dealing(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, int]:
    """Groups of documents, and buckets of what groups tell each other, for ``texts(text)``.

    Their number follows from the bytes there are, so that a group fits a task whatever the session's
    settings; two groups per shuffle partition at least even out their sizes. What a group tells is a
    fraction of its text, so fewer buckets will do.
    """
    n = partitions(texts.sparkSession)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(2 * n, -(-size // GROUP_BYTES)), max(n, -(-size // bucket_bytes))


def free_name(frame: DataFrame, base: str) -> str:
    """A column name that ``frame`` does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in frame.columns}
    while base.lower() in taken:
        base += "_"
    return base


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that count, as doc_id and text."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")
    )


def doc_groups(docs: DataFrame, groups: int, carry: Sequence[str] = ()) -> DataFrame:
    """(grp, ord, rid, doc_id, text, *carry): documents dealt evenly over ``groups`` groups.

    Equal texts have different identifiers and so fall into different groups. ``ord`` orders
    documents (a null identifier comes last), ``rid`` settles ties.
    """
    rid = F.xxhash64("doc_id", "text")
    return docs.select(
        F.pmod(rid, F.lit(groups)).cast("int").alias("grp"),
        F.coalesce("doc_id", F.lit(LAST)).alias("ord"),
        rid.alias("rid"),
        "doc_id",
        "text",
        *carry,
    )


# --- Arrow and numpy -------------------------------------------------------------------------


def raw_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of unsigned 64-bit numbers mixed, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    return h


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 4096), 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, in order, and the n + 1 offsets of the texts' words.

    ``lower`` folds A-Z first. Equal words have equal hashes in every process.
    """
    n = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    white = _IS_WHITE[data]
    first = ~white
    first[1:] &= white[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = ~white[heads]
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), counts
    last = ~white
    last[:-1] &= white[1:] | first[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = ~white[tails]
    ends = np.flatnonzero(last) + 1
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    step = 1 << 18  # words at a time bound the memory, whatever the number of texts
    for a in range(0, len(starts), step):
        s, size = starts[a : a + step], lengths[a : a + step]
        at = np.zeros(len(s), np.int64)
        np.cumsum(size[:-1], out=at[1:])
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        byte = data[place + np.repeat(s, size)]
        if lower:
            byte = _LOWER[byte]
        power = _powers(int(size.max()))
        h = np.add.reduceat(_BYTE[byte] * power[place], at)
        out[a : a + step] = mixed(h + size.astype(np.uint64))
    return out, counts


def gram_hashes(h: np.ndarray, k: int, factor: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """A hash of each ``k`` consecutive hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    factor = np.uint64(factor)
    for j in range(k):
        out *= factor
        out += h[j : j + n]
    return mixed(out)
