"""Weighted rendezvous hashing: records to shards by a stable key, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograft.llm.common import free_name
from lograft.sources.shared import kept

#: Slots are numbered per shard and block; blocks are leading bits of the key's digest. A shard of
#: n rows is sorted in pieces of about n / BLOCKS rows.
BLOCK_HEX = 3
BLOCKS = 16**BLOCK_HEX
#: A block this much above four times the average is looked at for keys with very many rows.
CROWDED = 100_000


def _unit(key: Column, shard: int) -> Column:
    """A number above 0 and below 1 that key and shard decide: 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def rendezvous(key: Column, weights: Sequence[float], ids: Sequence[int] | None = None) -> Column:
    """The shard with the highest score ``-weight / ln(u)``; the smaller shard id at a tie.

    ``key`` is a string column. A shard's score depends on the key, its id and its weight alone,
    so a further shard takes records only into itself, and a heavier one only draws them to itself.
    """
    ids = list(range(len(weights))) if ids is None else list(ids)
    if not weights or len(ids) != len(weights) or min(weights) <= 0:
        raise ValueError("every shard needs an id and a weight above 0")
    scored = [
        F.struct(
            (F.lit(float(w)) / -F.log(_unit(key, s))).alias("score"), F.lit(-s).alias("minus")
        )
        for s, w in zip(ids, weights, strict=True)
    ]
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["minus"]).cast("int")


def shard_key(column: Column) -> Column:
    """The key as text; null is a key of its own."""
    return F.coalesce(F.concat(F.lit("k"), column.cast("string")), F.lit("null"))


def with_shard(
    frame: DataFrame, key_col: str, weights: Sequence[float], shard_col: str = "shard"
) -> DataFrame:
    """``frame`` with its shard; all rows and columns stay. No shuffle."""
    return frame.withColumn(shard_col, rendezvous(shard_key(frame[key_col]), weights))


def number_slots(
    frame: DataFrame, shard_col: str, key_col: str, slot_col: str, then: Sequence[str] = ()
) -> DataFrame:
    """Gapless slots from 0 within each shard, in the order of the keys' digests.

    A shard, however large, is not sorted in one task: rows are numbered within (shard, leading
    digits of the digest), and the blocks' counts, at most shards x 4096 rows, give each block its
    first slot. Rows of one key follow each other by a digest of the columns ``then``. Keys that
    make a block crowded and have a thousandth of all rows, at most a thousand, are parted by that
    digest, so that rows without a key of their own are no single task either.
    """
    names = ("_digest", "_block", "_at", "_start", "_part", "_segment", "_hot")
    digest, block, at, start, part, segment, hot = (free_name(frame, n) for n in names)
    told = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in then])
    keyed = frame.withColumn(digest, F.md5(shard_key(frame[key_col]))).withColumn(
        part, F.substring(F.md5(told), 1, 2) if then else F.lit("")
    )
    keyed = keyed.withColumn(block, F.substring(digest, 1, BLOCK_HEX))
    counts = kept(keyed.groupBy(shard_col, block).agg(F.count(F.lit(1)).alias(at)))
    own = [shard_col, block]
    total, most, mean = counts.agg(F.sum(at), F.max(at), F.avg(at)).first()
    if then and total and most > CROWDED + 4 * mean:
        crowded = counts.where(F.col(at) > CROWDED + 4 * mean).select(shard_col, block)
        often = keyed.join(crowded, own, "left_semi").groupBy(block, digest).count()
        often = often.where(F.col("count") * 1000 >= total).groupBy(block)
        hot_keys = often.agg(F.sort_array(F.collect_set(digest)).alias(hot))
        keyed = keyed.join(F.broadcast(hot_keys), block, "left")
        known = F.coalesce(F.array_contains(hot, F.col(digest)), F.lit(False))
        lower = F.coalesce(F.size(F.filter(hot, lambda h: h < F.col(digest))), F.lit(0))
        # Only a hot key's rows are in parts of their own.
        parted = F.when(known, F.col(part)).otherwise("")
        keyed = keyed.withColumns({segment: 2 * lower + known.cast("int"), start: parted})
        keyed = keyed.drop(hot).withColumnRenamed(start, hot)
        own += [segment, hot]
        counts = kept(keyed.groupBy(own).agg(F.count(F.lit(1)).alias(at)))
    before = Window.partitionBy(shard_col).orderBy(own[1:]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(*own, F.coalesce(F.sum(at).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(own).orderBy(digest, part, *then)
    return (
        keyed.withColumn(at, F.row_number().over(inside))
        .join(starts, own)
        .withColumn(slot_col, (F.col(at) + F.col(start) - 1).cast("long"))
        .drop(digest, block, at, start, part, segment, hot)
    )


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """Where every document goes, and where it would go with one shard more.

    ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; the text itself is read but never
    shuffled. A null text has size 1 and CRC 0; a null identifier is a key; repeated identifiers
    share a shard and have a slot each; an empty table gives no rows.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    key = shard_key(F.col("doc_id"))
    read = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    placed = read.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, 1.0]).alias("grown_shard"),
    )
    slots = number_slots(placed, "shard", "doc_id", "slot", ("text_crc32", "size"))
    return slots.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
