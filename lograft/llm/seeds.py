"""Which hashes occur in more than one group of documents: the first step of finding repeats."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SEED_SCHEMA = "grp int, bucket int, seeds binary"


def ordered(group: pa.Table) -> pa.Table:
    """The documents of a group by identifier; ties in an order that the texts decide."""
    keys = [("ord", "ascending"), ("rid", "ascending")]
    return group.take(pc.sort_indices(group, sort_keys=keys)) if len(group) > 1 else group


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterable[tuple[int, np.ndarray]]:
    """Each bucket that has hashes, and where they stand."""
    bucket = bucket_of(hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    if len(order):
        for part in np.split(order, cuts):
            yield int(bucket[part[0]]), part


def seed_table(group: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    """The distinct hashes of a group, as one row per bucket; 32 bits and the bucket tell them."""
    rows = [
        (group, bucket, np.unique(hashes[part].astype(np.uint32)).tobytes())
        for bucket, part in by_bucket(hashes, buckets)
    ]
    return columns(rows, [pa.int32(), pa.int32(), pa.binary()], ["grp", "bucket", "seeds"])


def columns(rows: list[tuple], types: list, names: list[str]) -> pa.Table:
    lists = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(lists, types, strict=True)], names=names)


def numbers(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype) for b in column.to_pylist()]


def shared_seeds(seeds: DataFrame) -> DataFrame:
    """Of the groups' seeds those that another group has too. A bucket holds each seed once per
    group, so a seed that all documents have adds one number per group and no more."""

    def shared(bucket: pa.Table) -> pa.Table:
        parts = numbers(bucket.column("seeds"), np.uint32)
        every = np.concatenate(parts)
        ranked = np.sort(every)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        rows = []
        for group, number, part in zip(
            bucket.column("grp").to_pylist(), bucket.column("bucket").to_pylist(), parts,
            strict=True,
        ):
            found = part[held(part, twice)]
            if len(found):
                rows.append((group, number, found.tobytes()))
        return columns(rows, [pa.int32(), pa.int32(), pa.binary()], ["grp", "bucket", "seeds"])

    return seeds.groupBy("bucket").applyInArrow(shared, SEED_SCHEMA)


def held(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``among``."""
    if len(among) == 0:
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def seed_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits as one number: all that the exchange knows of a hash."""
    low = hashes & np.uint64(0xFFFFFFFF)
    return (bucket_of(hashes, buckets).astype(np.uint64) << np.uint64(32)) | low


def received_keys(replies: pa.Table) -> np.ndarray:
    """The sorted keys of the seeds a group was told."""
    parts = [
        np.frombuffer(seeds, np.uint32).astype(np.uint64) | np.uint64(bucket << 32)
        for bucket, seeds in zip(
            replies.column("bucket").to_pylist(), replies.column("seeds").to_pylist(), strict=True
        )
    ]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def in_several(values: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The sorted values that stand in at least two documents of this group."""
    order = np.lexsort((docs, values))
    values, docs = values[order], docs[order]
    same = values[1:] == values[:-1]
    return np.unique(values[1:][same & (docs[1:] != docs[:-1])])
