"""Byte strings that an earlier document has too, by prefix doubling over candidate positions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lograft.llm.common import dealing, doc_groups, mixed, raw_texts, ship, sliding_min
from lograft.llm.seeds import (
    SEED_SCHEMA,
    by_bucket,
    columns,
    held,
    in_several,
    numbers,
    ordered,
    received_keys,
    seed_keys,
    seed_table,
    shared_seeds,
)

#: Bytes of a seed. A string's seed is the one with the smallest hash that lies in it.
SEED_BYTES = 16
STEP = 1 << 20
#: Bytes of text whose stretches meet in a bucket: ranking takes about sixty times as much.
RANKED_BYTES = 2 << 20

STRETCH_SCHEMA = (
    "grp int, bucket int, seeds binary, ords binary, places binary, lengths binary, bytes binary"
)
FOUND_SCHEMA = "grp int, places binary, lengths binary, masks binary"


def words_of(data: bytes, at: int, n: int) -> np.ndarray:
    """The 8-byte number that starts at each of ``n`` bytes; ``data`` has 7 bytes more."""
    return np.ndarray((n,), "<u8", data, at, (1,))


class Stretches:
    """The documents of a group as stretches: neighbouring strings of ``length`` bytes with one seed.

    ``first`` is where a stretch's first string starts, ``strings`` how many start in a row,
    ``seeds`` their common seed, ``docs`` their document.
    """

    def __init__(self, group: pa.Table, length: int):
        self.group, self.length = ordered(group), length
        data, self.offsets = raw_texts(self.group.column("text"))
        self.ords = self.group.column("ord").to_numpy()
        self.size = n = len(data)
        if n >= 1 << 32:
            raise ValueError("a text of 4 GiB or more")
        self.data = data.tobytes() + bytes(length + 16)
        ends, starts = self.offsets[1:], self.offsets[:-1]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.maximum(starts, ends - length + 1), 1)
        np.subtract.at(edge, ends, 1)
        inside = np.cumsum(edge)[:n] == 0
        firsts, strings, seeds = [], [], []
        for a in range(0, n, STEP):
            b = min(n, a + STEP)
            good = inside[a:b]
            smallest = self._smallest(a, b)
            new = good.copy()
            new[1:] &= ~good[:-1] | (smallest[1:] != smallest[:-1])
            at = np.flatnonzero(new)
            if len(at):
                firsts.append(at + a)
                seeds.append(smallest[at])
                strings.append(np.add.reduceat(good, at, dtype=np.int64))
        empty = np.zeros(0, np.int64)
        self.first = np.concatenate(firsts) if firsts else empty
        self.strings = np.concatenate(strings) if strings else empty
        self.seeds = np.concatenate(seeds) if seeds else empty.astype(np.uint64)
        self.docs = np.searchsorted(self.offsets, self.first, "right") - 1

    def _smallest(self, a: int, b: int) -> np.ndarray:
        width = self.length - SEED_BYTES + 1
        n = b - a + width - 1
        h = words_of(self.data, a, n) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h += words_of(self.data, a + 8, n)
        return sliding_min(mixed(h), width)[: b - a]

    def local(self) -> np.ndarray:
        return in_several(self.seeds, self.docs)

    def bytes_at(self, k: int) -> bytes:
        a = self.first[k]
        return self.data[a : a + self.strings[k] + self.length - 1]


def doubled_ranks(text: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """A rank for the ``length``-byte string at each start: equal strings have equal ranks.

    Prefix doubling: the rank of 2h bytes at i is that of the pair (rank of h bytes at i, rank of
    h bytes at i + h), found by sorting the pairs; the last offset is cut so that the two halves
    overlap and end at the threshold. A start whose rank is already its own is not ranked again.
    """
    n = len(text)
    rank = np.unique(words_of(text + bytes(8), 0, n), return_inverse=True)[1].astype(np.uint64)
    have = 8
    while have * 2 <= length:
        pairs = rank[: len(rank) - have] << np.uint64(32) | rank[have:]
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
        have *= 2
    counts = np.bincount(rank.astype(np.int64))
    alone = counts[rank[starts].astype(np.int64)] == 1
    out = np.empty(len(starts), np.int64)
    out[alone] = -1 - np.arange(int(alone.sum()))
    rest = starts[~alone]
    pairs = rank[rest] << np.uint64(32) | rank[rest + length - have]
    out[~alone] = np.unique(pairs, return_inverse=True)[1] if len(rest) else 0
    return out


def repeated_bytes(
    docs: DataFrame,
    length: int = 50,
    with_text: bool = False,
    carry: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte of a text's UTF-8 goes if a string of ``length`` bytes that covers it also starts in a
    document with a smaller identifier; strings are judged on the input and never cross documents.
    ``with_text`` adds ``kept_text`` (what is left, without the halves of characters a removal has
    cut through); columns named in ``carry`` come along as they are.

    The first rank of a position is the seed of the string that starts there: its 16-byte piece
    with the smallest hash, so equal strings have equal first ranks. Positions whose rank no other
    document has are done; neighbours of one rank travel as one stretch of bytes. Spark deals
    stretches by rank; in each bucket equal stretches are merged, and where a rank still has
    several, prefix doubling ranks their positions at 8, 16, 32 and at last ``length`` bytes. Ranks
    there come from the bytes themselves, so no hash decides what is equal.

    Documents are dealt over groups of a few megabytes; a group sends each stretch once, so a text that
    a third of all rows have costs one copy per group. Texts are shuffled once. A text is never cut:
    one of 4 GiB or more is an error, and a task needs about forty times the longest.

    Null and empty texts have no bytes; texts shorter than ``length`` keep all. A null identifier
    counts as larger than all others; rows with one identifier do not remove from each other. An
    empty table gives no rows.
    """
    if length < 2 * SEED_BYTES:
        raise ValueError(f"length must be at least {2 * SEED_BYTES}")
    spark = docs.sparkSession
    ship(spark)
    renamed = {name: f"c{i}" for i, name in enumerate(carry)}
    read = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        *(docs[name].alias(to) for name, to in renamed.items()),
    )
    groups, buckets = dealing(read, RANKED_BYTES)
    grouped = doc_groups(read, groups, list(renamed.values()))
    mine = grouped.groupBy("grp")

    def seeds(group: pa.Table) -> pa.Table:
        stretches = Stretches(group, length)
        return seed_table(group.column("grp")[0].as_py(), stretches.seeds, buckets)

    def candidates(group: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if len(group):
            s = Stretches(group, length)
            chosen = held(seed_keys(s.seeds, buckets), received_keys(told))
            chosen |= held(s.seeds, s.local())
            seen: set[bytes] = set()
            first = []
            for k in np.flatnonzero(chosen).tolist():
                body = s.bytes_at(k)
                if body not in seen:
                    seen.add(body)
                    first.append(k)
            first = np.array(first, np.int64)
            number = group.column("grp")[0].as_py()
            for bucket, part in by_bucket(s.seeds[first], buckets):
                here = first[part]
                rows.append(
                    (
                        number,
                        bucket,
                        s.seeds[here].tobytes(),
                        s.ords[s.docs[here]].tobytes(),
                        s.first[here].astype(np.uint32).tobytes(),
                        s.strings[here].astype(np.uint32).tobytes(),
                        b"".join(s.bytes_at(k) for k in here.tolist()),
                    )
                )
        return columns(
            rows,
            [pa.int32(), pa.int32(), *[pa.binary()] * 5],
            ["grp", "bucket", "seeds", "ords", "places", "lengths", "bytes"],
        )

    def earlier(bucket: pa.Table) -> pa.Table:
        rows = list(_earlier(bucket, length))
        return columns(
            rows,
            [pa.int32(), pa.binary(), pa.binary(), pa.binary()],
            ["grp", "places", "lengths", "masks"],
        )

    extra = [f for f in grouped.schema.fields if f.name in renamed.values()]

    def result(group: pa.Table, found: pa.Table) -> pa.Table:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            types, names = [*types, pa.string()], [*names, "kept_text"]
        if len(group) == 0:
            out, s = columns([], types, names), None
        else:
            s = Stretches(group, length)
            out = columns(list(_kept(s, _gone(s, found), with_text)), types, names)
        for field in extra:
            column = (s.group if s else group).column(field.name)
            out = out.append_column(field.name, column)
        return out

    told = shared_seeds(mine.applyInArrow(seeds, SEED_SCHEMA))
    met = mine.cogroup(told.groupBy("grp")).applyInArrow(candidates, STRETCH_SCHEMA)
    found = met.groupBy("bucket").applyInArrow(earlier, FOUND_SCHEMA)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if with_text:
        schema += ", kept_text string"
    for field in extra:
        schema += f", {field.name} {field.dataType.simpleString()}"
    return (
        mine.cogroup(found.groupBy("grp"))
        .applyInArrow(result, schema)
        .withColumnsRenamed({to: name for name, to in renamed.items()})
    )


def _earlier(bucket: pa.Table, length: int):
    """Which stretches, or which strings of them, start in an earlier document.

    A reply without a mask means the whole stretch.
    """
    groups = bucket.column("grp").to_pylist()
    places = numbers(bucket.column("places"), np.uint32)
    strings = numbers(bucket.column("lengths"), np.uint32)
    seeds = np.concatenate(numbers(bucket.column("seeds"), np.uint64))
    ords = np.concatenate(numbers(bucket.column("ords"), np.int64))
    number: dict[bytes, int] = {}
    kind, holder = [], []  # the distinct stretch of each entry; an entry of each distinct stretch
    for count, body in zip(strings, bucket.column("bytes").to_pylist(), strict=True):
        at = 0
        for n in count.tolist():
            end = at + n + length - 1
            k = number.setdefault(body[at:end], len(number))
            if k == len(holder):
                holder.append(len(kind))
            kind.append(k)
            at = end
    if not kind:
        return
    kind, holder = np.array(kind), np.array(holder)
    least = np.full(len(holder), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ords)
    # Seeds with several distinct stretches: their strings are compared one by one.
    _, back, many = np.unique(seeds[holder], return_inverse=True, return_counts=True)
    compared = np.flatnonzero(many[back] > 1)
    masks: dict[int, np.ndarray] = {}
    if len(compared):
        bodies = list(number)
        text = b"".join(bodies[k] for k in compared.tolist())
        size = np.array([len(bodies[k]) for k in compared.tolist()])
        starts_at = np.concatenate([[0], np.cumsum(size)[:-1]])
        count = size - length + 1
        owner = np.repeat(np.arange(len(compared)), count)
        shift = np.concatenate([[0], np.cumsum(count)[:-1]])
        starts = np.arange(int(count.sum())) - np.repeat(shift, count) + starts_at[owner]
        rank = doubled_ranks(text, starts, length)
        mine = least[compared][owner]
        dense = np.unique(rank, return_inverse=True)[1]
        best = np.full(int(dense.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, dense, mine)
        before = best[dense] < mine
        for k in np.unique(owner[before]).tolist():
            masks[int(compared[k])] = before[shift[k] : shift[k] + count[k]]
    at = 0
    for group, place, count in zip(groups, places, strings, strict=True):
        chosen, lengths, bits = [], [], []
        for i in range(len(place)):
            k = int(kind[at + i])
            if ords[at + i] > least[k]:
                chosen.append(place[i])
                lengths.append(0)
            elif k in masks:
                chosen.append(place[i])
                lengths.append(count[i])
                bits.append(masks[k])
        at += len(place)
        if chosen:
            mask = np.packbits(np.concatenate(bits)).tobytes() if bits else b""
            yield (
                group,
                np.array(chosen, np.uint32).tobytes(),
                np.array(lengths, np.uint32).tobytes(),
                mask,
            )


def _gone(s: Stretches, found: pa.Table) -> np.ndarray:
    """Which bytes of the group go."""
    replies: dict[int, np.ndarray | None] = {}
    for place, count, mask in zip(
        numbers(found.column("places"), np.uint32),
        numbers(found.column("lengths"), np.uint32),
        found.column("masks").to_pylist(),
        strict=True,
    ):
        bits = np.unpackbits(np.frombuffer(mask, np.uint8)).astype(bool)
        at = 0
        for p, n in zip(place.tolist(), count.tolist(), strict=True):
            replies[p] = bits[at : at + n] if n else None
            at += n
    edge = np.zeros(s.size + 1, np.int32)
    if replies or len(s.first):
        told = np.searchsorted(s.first, np.sort(np.fromiter(replies, np.int64, len(replies))))
        wanted = np.union1d(s.seeds[told], s.local())
        known: dict[bytes, tuple[int, int]] = {}
        whole, single = [], []
        for k in np.flatnonzero(held(s.seeds, wanted)).tolist():
            body = s.bytes_at(k)
            ord_ = int(s.ords[s.docs[k]])
            place = int(s.first[k])
            least, leader = known.setdefault(body, (ord_, place))
            if ord_ > least:
                whole.append(k)
            elif leader in replies:
                mask = replies[leader]
                if mask is None:
                    whole.append(k)
                else:
                    single.append(place + np.flatnonzero(mask))
        whole = np.array(whole, np.int64)
        np.add.at(edge, s.first[whole], 1)
        np.subtract.at(edge, s.first[whole] + s.strings[whole] + s.length - 1, 1)
        if single:
            starts = np.concatenate(single)
            np.add.at(edge, starts, 1)
            np.subtract.at(edge, starts + s.length, 1)
    return np.cumsum(edge)[: s.size] > 0


def _kept(s: Stretches, gone: np.ndarray, with_text: bool):
    data = np.frombuffer(s.data, np.uint8, s.size)
    for k, doc in enumerate(s.group.column("doc_id").to_pylist()):
        a, b = s.offsets[k], s.offsets[k + 1]
        mine = gone[a:b]
        removed = int(mine.sum())
        body = data[a:b][~mine].tobytes() if removed else data[a:b].tobytes()
        runs = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()) if removed else 0
        row = (doc, int(b - a), removed, runs, hashlib.sha256(body).hexdigest())
        yield (*row, body.decode("utf-8", "ignore")) if with_text else row
