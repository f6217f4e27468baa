"""Exact Jaccard join of word n-gram sets, and the classes its links make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import (
    LAST,
    dealing,
    doc_groups,
    gram_hashes,
    id_and_text,
    mixed,
    raw_texts,
    ship,
    word_hashes,
)
from lograft.llm.graph import components
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
from lograft.sources.shared import kept

#: Similarity of 0.8 as whole numbers: overlap * (NUM + DEN) >= NUM * (sum of the sizes).
NUM, DEN = 4, 5
#: Lists of a token up to this length give pairs; the sets of longer lists are compared in blocks.
SHORT = 64
BLOCK = 1024
#: Sets that every block of a group holds, so that what resembles them meets in one component.
LEADERS = 32

I64, I32, BIN = pa.int64(), pa.int32(), pa.binary()
SET_SCHEMA = "doc_id bigint, ord bigint, rid bigint, grp int, n int, d1 bigint, d2 bigint"


class Sets:
    """The shingle sets of a group's documents: sorted distinct hashes, one after the other."""

    def __init__(self, group: pa.Table, k: int):
        self.group = group = ordered(group)
        words, counts = word_hashes(*raw_texts(group.column("text")), lower=True)
        lengths = np.diff(counts)
        doc = np.repeat(np.arange(len(group)), lengths)
        # Shorter texts are one shingle: all their words, told from longer ones by their number.
        short = np.flatnonzero((lengths > 0) & (lengths < k))
        grams = gram_hashes(words, k)
        inside = (
            np.flatnonzero(doc[: len(grams)] == doc[k - 1 :]) if len(grams) else np.zeros(0, int)
        )
        hashes, owner = grams[inside], doc[: len(grams)][inside]
        if len(short):
            whole = [gram_hashes(words[counts[i] : counts[i + 1]], int(lengths[i])) for i in short]
            salt = lengths[short].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            hashes = np.concatenate([hashes, mixed(np.concatenate(whole) + salt)])
            owner = np.concatenate([owner, short])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = hashes[new], owner[new]
        self.at = np.searchsorted(self.owner, np.arange(len(group) + 1))
        self.sizes = np.diff(self.at)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that tell sets apart, as two sums over their members."""
        out = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            each = mixed(self.hashes ^ np.uint64(salt))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
            out.append((total[self.at[1:]] - total[self.at[:-1]]).view(np.int64))
        return out[0], out[1]

    def prefixes(self) -> np.ndarray:
        """Which members are emitted at first: the smallest by hash."""
        place = np.arange(len(self.hashes)) - self.at[self.owner]
        return place < first_prefix(self.sizes)[self.owner]


def least_overlap(n: np.ndarray) -> np.ndarray:
    """What a set of n members shares at least with any similar one: 0.8 n, rounded up."""
    return -(-NUM * n // DEN)


def margin(n: np.ndarray) -> np.ndarray:
    return n // 20


def first_prefix(n: np.ndarray) -> np.ndarray:
    """Two similar sets share more than ``margin`` of the smaller one in prefixes this long."""
    return n - least_overlap(n) + 1 + margin(n)


def _sets(group: pa.Table, k: int) -> pa.Table:
    s = Sets(group, k)
    d1, d2 = s.digests()
    g = s.group
    return pa.table(
        [
            g.column("doc_id"), g.column("ord"), g.column("rid"), g.column("grp"),
            pa.array(s.sizes, I32), pa.array(d1), pa.array(d2),
        ],
        names=["doc_id", "ord", "rid", "grp", "n", "d1", "d2"],
    )


def _representatives(group: pa.Table, chosen: pa.Table) -> pa.Table:
    """The rows of ``group`` that stand for their set."""
    keys = set(
        zip(chosen.column("ord").to_pylist(), chosen.column("rid").to_pylist(), strict=True)
    )
    mask = []
    for key in zip(group.column("ord").to_pylist(), group.column("rid").to_pylist(), strict=True):
        mask.append(key in keys)
        keys.discard(key)  # a row that is there twice stands once
    return group.filter(pa.array(mask, pa.bool_()))


def similar_sets(docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, nodes, links) of ``docs(doc_id, text)``.

    ``sets``: one row per row, with the size and digest of its set. ``nodes``: one row per distinct
    set that is not empty, with the document that stands for it. ``links``: enough links between
    nodes of similarity 0.8 or more for every pair of linked sets to be connected; each of them is
    checked on whole sets.
    """
    spark = docs.sparkSession
    ship(spark)
    groups, buckets = dealing(docs)
    mine = doc_groups(docs, groups).groupBy("grp")
    sets = kept(mine.applyInArrow(lambda g: _sets(g, k), SET_SCHEMA))
    nodes = kept(
        sets.where("n > 0")
        .groupBy("n", "d1", "d2")
        .agg(F.min(F.struct("ord", "rid", "grp")).alias("rep"))
        .select("n", "d1", "d2", "rep.*", F.xxhash64("n", "d1", "d2").alias("sid"))
    )
    nothing = F.lit(None)
    chosen = nodes.select(
        "grp", "ord", "rid", nothing.cast("int").alias("bucket"),
        nothing.cast("binary").alias("seeds"),
    )

    def seeds(group: pa.Table, chosen: pa.Table) -> pa.Table:
        if len(group) == 0 or len(chosen) == 0:
            return columns([], [I32, I32, BIN], ["grp", "bucket", "seeds"])
        s = Sets(_representatives(group, chosen), k)
        return seed_table(group.column("grp")[0].as_py(), s.hashes[s.prefixes()], buckets)

    def survivors(group: pa.Table, told: pa.Table) -> pa.Table:
        types = [I64, I64, I32, BIN]
        names = ["ord", "rid", "n", "members"]
        if len(group) == 0 or len(told) == 0:
            return columns([], types, names)
        is_seed = told.column("seeds").is_valid()
        s = Sets(_representatives(group, told.filter(pa.compute.invert(is_seed))), k)
        prefix = s.prefixes()
        hashes, owner = s.hashes[prefix], s.owner[prefix]
        known = held(seed_keys(hashes, buckets), received_keys(told.filter(is_seed)))
        known |= held(hashes, in_several(hashes, owner))
        shared = np.bincount(owner[known], minlength=len(s.group))
        keep = np.flatnonzero(shared >= margin(least_overlap(s.sizes)) + 1)
        ords, rids = s.group.column("ord").to_numpy(), s.group.column("rid").to_numpy()
        return columns(
            [
                (int(ords[i]), int(rids[i]), int(s.sizes[i]),
                 s.hashes[s.at[i] : s.at[i + 1]].tobytes())
                for i in keep.tolist()
            ],
            types,
            names,
        )

    told = shared_seeds(
        mine.cogroup(chosen.groupBy("grp")).applyInArrow(seeds, SEED_SCHEMA)
    )
    told = chosen.unionByName(
        told.select(
            "grp", nothing.cast("bigint").alias("ord"), nothing.cast("bigint").alias("rid"),
            "bucket", "seeds",
        )
    )
    left = mine.cogroup(told.groupBy("grp")).applyInArrow(
        survivors, "ord bigint, rid bigint, n int, members binary"
    )
    left = kept(
        left.join(nodes.select("ord", "rid", "sid"), ["ord", "rid"]).select("sid", "n", "members")
    )
    return sets, nodes, _links(left, buckets)


def _links(sets: DataFrame, buckets: int) -> DataFrame:
    """Links between ``sets(sid, n, members)``."""
    pairs_and_stars = kept(_candidates(sets, buckets))
    stars = pairs_and_stars.where("star").select("u", "v")
    pairs = pairs_and_stars.where("not star").select("u", "v").distinct()
    if stars.isEmpty():
        return _checked(pairs, sets)
    hot = kept(components(stars))
    first = kept(_block_links(sets, hot))
    second = _rest_links(sets, hot, first)
    root = hot.withColumnsRenamed({"node": "u", "root": "gu"})
    pairs = pairs.join(root, "u", "left").join(
        root.withColumnsRenamed({"u": "v", "gu": "gv"}), "v", "left"
    )
    pairs = pairs.where("gu is null or gv is null or gu <> gv").select("u", "v")
    return first.unionByName(second).unionByName(_checked(pairs, sets))


def _candidates(sets: DataFrame, buckets: int) -> DataFrame:
    """(u, v, star): pairs that share a rare member; stars for members that many sets share.

    Members are counted over all these sets. In each set those no other set has come first, then
    rarer before more frequent ones; similar sets share one of the first 0.2 n + 1. Lists are
    ordered by size and cut where sizes are too far apart to be similar; from the places of the
    shared member in both sets follows how much they can share at most.
    """
    grouped = sets.withColumn("grp", F.pmod("sid", F.lit(buckets)).cast("int")).groupBy("grp")

    def counted(group: pa.Table) -> pa.Table:
        members = np.concatenate(numbers(group.column("members"), np.uint64))
        distinct, count = np.unique(members, return_counts=True)
        number = group.column("grp")[0].as_py()
        rows = [
            (number, bucket, distinct[part].astype(np.uint32).tobytes(),
             count[part].astype(np.uint32).tobytes())
            for bucket, part in by_bucket(distinct, buckets)
        ]
        return columns(rows, [I32, I32, BIN, BIN], ["grp", "bucket", "seeds", "counts"])

    def summed(bucket: pa.Table) -> pa.Table:
        parts = numbers(bucket.column("seeds"), np.uint32)
        counts = numbers(bucket.column("counts"), np.uint32)
        distinct, back = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        rows, at = [], 0
        groups, number = bucket.column("grp").to_pylist(), bucket.column("bucket")[0].as_py()
        for group, part in zip(groups, parts, strict=True):
            mine = total[back[at : at + len(part)]]
            at += len(part)
            many = mine > 1
            if many.any():
                much = np.minimum(mine[many], 0xFFFFFFFF).astype(np.uint32)
                rows.append((group, number, part[many].tobytes(), much.tobytes()))
        return columns(rows, [I32, I32, BIN, BIN], ["grp", "bucket", "seeds", "counts"])

    def postings(group: pa.Table, told: pa.Table) -> pa.Table:
        names = ["bucket", "members", "sids", "sizes", "places"]
        types = [I32, BIN, BIN, BIN, BIN]
        if len(group) == 0 or len(told) == 0:
            return columns([], types, names)
        parts = numbers(group.column("members"), np.uint64)
        sizes = np.array([len(p) for p in parts])
        members = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), sizes)
        keys = np.concatenate(
            [
                np.frombuffer(s, np.uint32).astype(np.uint64) | np.uint64(b << 32)
                for b, s in zip(
                    told.column("bucket").to_pylist(), told.column("seeds").to_pylist(),
                    strict=True,
                )
            ]
        )
        counts = np.concatenate(numbers(told.column("counts"), np.uint32))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        mine = seed_keys(members, buckets)
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        often = np.where(keys[at] == mine, counts[at], 1)
        order = np.lexsort((members, often, owner))
        place = np.arange(len(members)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        owner, often, members = owner[order], often[order], members[order]
        first = (place < (sizes - least_overlap(sizes) + 1)[owner]) & (often > 1)
        members, owner, place = members[first], owner[first], place[first]
        sids = group.column("sid").to_numpy()
        rows = [
            (
                bucket,
                members[part].tobytes(),
                sids[owner[part]].tobytes(),
                sizes[owner[part]].astype(np.uint32).tobytes(),
                place[part].astype(np.uint32).tobytes(),
            )
            for bucket, part in by_bucket(members, buckets)
        ]
        return columns(rows, types, names)

    counts = grouped.applyInArrow(
        counted, "grp int, bucket int, seeds binary, counts binary"
    )
    totals = counts.groupBy("bucket").applyInArrow(
        summed, "grp int, bucket int, seeds binary, counts binary"
    )
    lists = grouped.cogroup(totals.groupBy("grp")).applyInArrow(
        postings, "bucket int, members binary, sids binary, sizes binary, places binary"
    )
    return lists.groupBy("bucket").applyInArrow(
        _listed, "u bigint, v bigint, star boolean"
    )


def _listed(bucket: pa.Table) -> pa.Table:
    members = np.concatenate(numbers(bucket.column("members"), np.uint64))
    sids = np.concatenate(numbers(bucket.column("sids"), np.int64))
    sizes = np.concatenate(numbers(bucket.column("sizes"), np.uint32)).astype(np.int64)
    left = sizes - np.concatenate(numbers(bucket.column("places"), np.uint32))
    order = np.lexsort((sids, sizes, members))
    members, sids, sizes, left = members[order], sids[order], sizes[order], left[order]
    if len(members) == 0:
        return columns([], [I64, I64, pa.bool_()], ["u", "v", "star"])
    lists, lengths = _cut_lists(members, sizes)
    # What a partner may have at most: beyond, too much lies before the shared member. In a long
    # list, an entry that could not even meet its own size pairs with smaller ones only, and with
    # none of its kind.
    cap = (NUM + DEN) * left // NUM - sizes
    weak = (lengths > SHORT)[lists] & (cap < sizes)
    strong = np.flatnonzero(~weak)
    us, vs = [], []
    heads = _weak_entries(np.flatnonzero(weak), strong, lists, sids, sizes, cap, us, vs)
    sids, sizes, left, lists = sids[strong], sizes[strong], left[strong], lists[strong]
    runs, lengths = _cut_lists(lists, sizes)
    starts = np.cumsum(lengths) - lengths
    for gap in range(1, SHORT):
        # Pairs ``gap`` apart in lists that are short: one block of comparisons at a time.
        short = np.flatnonzero((lengths > gap) & (lengths <= SHORT))
        if len(short) == 0:
            break
        n = lengths[short] - gap
        i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[short], n)
        j = i + gap
        both = sizes[i] + sizes[j]
        most = np.minimum(left[i], left[j])
        fits = (DEN * sizes[i] >= NUM * sizes[j]) & ((NUM + DEN) * most >= NUM * both)
        us.append(np.minimum(sids[i], sids[j])[fits])
        vs.append(np.maximum(sids[i], sids[j])[fits])
    pairs = np.zeros((0, 2), np.int64)
    if us:
        pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
    long = (lengths > SHORT)[runs]
    own = np.concatenate([sids[long], heads[0]])
    # An entry that can meet many belongs to the star of their run, short or long.
    joined = np.unique(runs[heads[1]])
    also = np.isin(runs, joined) & ~long
    own = np.concatenate([own, sids[also]])
    center = sids[starts[np.concatenate([runs[long], runs[heads[1]], runs[also]])]]
    stars = np.unique(np.stack([own, center], 1), axis=0)
    both = np.concatenate([pairs, stars])
    star = np.arange(len(both)) >= len(pairs)
    return pa.table(
        [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(star)], names=["u", "v", "star"]
    )


def _cut_lists(key: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each entry's list, and the lists' lengths: a list ends with its key, or where
    all later sets are too large for all earlier ones."""
    if len(key) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = (key[1:] != key[:-1]) | (DEN * sizes[:-1] < NUM * sizes[1:])
    lists = np.concatenate([[0], np.cumsum(cut)])
    return lists, np.bincount(lists)


def _weak_entries(
    weak: np.ndarray, strong: np.ndarray, lists: np.ndarray, sids: np.ndarray, sizes: np.ndarray,
    cap: np.ndarray, us: list, vs: list,
) -> tuple[np.ndarray, np.ndarray]:
    """Partners of entries that can pair with smaller ones only: pairs go to ``us`` and ``vs``;
    returned are the sets that may have more than SHORT, and a partner's place in ``strong``."""
    wide = np.int64(1 << 32)
    key = lists[strong] * wide + sizes[strong]
    least = -(-NUM * sizes[weak] // DEN)
    low = np.searchsorted(key, lists[weak] * wide + least, side="left")
    high = np.searchsorted(key, lists[weak] * wide + np.maximum(cap[weak], 0), side="right")
    many = high - low
    few = (many > 0) & (many <= SHORT)
    n = many[few]
    i = np.repeat(weak[few], n)
    j = strong[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[few], n)]
    fits = (cap[j] >= sizes[i]) & (sids[i] != sids[j])
    us.append(np.minimum(sids[i], sids[j])[fits])
    vs.append(np.maximum(sids[i], sids[j])[fits])
    more = np.flatnonzero(many > SHORT)
    # The largest partner that any in reach allows, by doubling.
    table, tops = cap[strong], np.full(len(more), np.iinfo(np.int64).min)
    width, step = many[more], 1
    while len(more) and step <= int(width.max()):
        here = (width >= step) & (width < 2 * step)
        at = more[here]
        tops[here] = np.maximum(table[low[at]], table[high[at] - step])
        table = np.maximum(table[:-step], table[step:]) if len(table) > step else table
        step *= 2
    more = more[tops >= sizes[weak[more]]]
    return sids[weak[more]], low[more]


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar."""
    left = sets.select(F.col("sid").alias("u"), F.col("members").alias("mu"))
    right = sets.select(F.col("sid").alias("v"), F.col("members").alias("mv"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a = np.frombuffer(a.as_py(), np.uint64)
                b = np.frombuffer(b.as_py(), np.uint64)
                linked.append(similar(int(held(a, b).sum()), len(a) + len(b)))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return (
        pairs.join(left, "u")
        .join(right, "v")
        .select("u", "v", "mu", "mv")
        .mapInArrow(check, "u bigint, v bigint")
    )


def similar(overlap, both):
    return (NUM + DEN) * overlap >= NUM * both


def _blocks(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """(g, block, blocks, sid, members): groups of hot sets in blocks of about BLOCK."""
    sized = hot.groupBy("root").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    )
    return (
        hot.join(sized, "root")
        .join(sets.withColumnRenamed("sid", "node"), "node")
        .select(
            F.col("root").alias("g"),
            F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
            "blocks",
            F.col("node").alias("sid"),
            "members",
        )
    )


def _joined_block(block: pa.Table) -> pa.Table:
    sids = block.column("sid").to_numpy()
    _, once = np.unique(sids, return_index=True)
    block = block.take(pa.array(once))
    parts = numbers(block.column("members"), np.uint64)
    label = (
        np.unique(block.column("label").to_numpy(), return_inverse=True)[1]
        if "label" in block.column_names
        else None
    )
    links = block_links(parts, label)
    sids = block.column("sid").to_numpy()
    return pa.table(
        [pa.array(sids[[a for a, _ in links]]), pa.array(sids[[b for _, b in links]])],
        schema=pa.schema([("u", I64), ("v", I64)]),
    )


def block_links(parts: list[np.ndarray], label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect every two similar sets of a block.

    A set's overlaps with all others come from the lists of its members, or from the overlaps of a
    computed set p it has much in common with: less the lists of p's other members, plus those of its
    own. They are not computed where they cannot add a link: once all sets are connected, or where
    p is so much like this set x that overlap(p, y) + |x without p| is too small for every y not yet
    connected.
    """
    k = len(parts)
    sizes = np.array([len(p) for p in parts])
    member = np.unique(np.concatenate(parts), return_inverse=True)[1] if k else np.zeros(0, int)
    owner = np.repeat(np.arange(k), sizes)
    order = np.argsort(member, kind="stable")
    listed = owner[order]
    width = np.bincount(member)
    begin = np.cumsum(width) - width
    ends = np.cumsum(sizes)
    group = np.arange(k) if label is None else label.copy()
    links: list[tuple[int, int]] = []
    known: list[tuple[int, np.ndarray]] = []

    def members_of(x: int) -> np.ndarray:
        return member[ends[x] - sizes[x] : ends[x]]

    def met_by(own: np.ndarray) -> np.ndarray:
        """How many of these members each set of the block has."""
        n = width[own]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)
        return np.bincount(listed[at], minlength=k)

    for x in range(k):
        if (group == group[0]).all():
            break
        other = group != group[x]
        needed = NUM * (sizes + sizes[x])
        near, nearest = max(known, key=lambda held_: held_[1][x], default=(None, None))
        if nearest is not None:
            bound = nearest + (sizes[x] - nearest[x])
            if not ((NUM + DEN) * bound >= needed)[other].any():
                continue
        own = members_of(x)
        overlap = None
        if nearest is not None and 2 * nearest[x] > sizes[near]:
            # Only the members in which the two sets differ change the answers.
            theirs = members_of(near)
            gone, new = theirs[~held(theirs, own)], own[~held(own, theirs)]
            overlap = nearest - met_by(gone) + met_by(new)
        else:
            overlap = met_by(own)
        known = [*known[-15:], (x, overlap)]
        for y in np.flatnonzero(other & ((NUM + DEN) * overlap >= needed)).tolist():
            if group[y] != group[x]:
                links.append((x, y))
                group[group == group[y]] = group[x]
    return links


def _block_links(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """Links within each block, and between its sets and the leaders of its group."""
    blocks = _blocks(sets, hot)
    lead = blocks.where("blocks > 1").where(
        F.pmod(F.xxhash64("sid"), (F.col("blocks") * (BLOCK // LEADERS)).cast("bigint")) == 0
    )
    spread = lead.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (
        blocks.unionByName(spread)
        .select("g", "block", "sid", "members")
        .groupBy("g", "block")
        .applyInArrow(_joined_block, "u bigint, v bigint")
    )


def _rest_links(sets: DataFrame, hot: DataFrame, first: DataFrame) -> DataFrame:
    """What blocks could not see: in groups of several blocks that did not become one component,
    the sets outside the group's largest component are compared with all others, block by block."""
    blocks = _blocks(sets, hot).where("blocks > 1")
    roots = components(first)
    labelled = blocks.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "label", F.coalesce("root", "sid")
    )
    sizes = labelled.groupBy("g", "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("g").agg(
        F.max(F.struct("size", "label"))["label"].alias("main"),
        F.count(F.lit(1)).alias("labels"),
    )
    open_ = labelled.join(main.where("labels > 1"), "g").select(
        "g", "block", "blocks", "sid", "members", "label", "main"
    )
    minor = open_.where("label <> main")
    part = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # Minor sets of block i meet block j of all sets.
    left = minor.withColumn("j", part).withColumn("i", F.col("block"))
    right = open_.withColumn("i", part).withColumn("j", F.col("block"))
    return (
        left.unionByName(right.select(left.columns))
        .select("g", "i", "j", "sid", "members", "label")
        .groupBy("g", "i", "j")
        .applyInArrow(_joined_block, "u bigint, v bigint")
    )


def similar_classes(
    docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Words are what stands between ASCII white space, A-Z folded; a text's set are its distinct
    ``k``-word shingles, or with fewer words the whole sequence. Sets are linked when their Jaccard
    similarity is 0.8 or more; ``component_id`` is the smallest identifier reachable by links.

    Equal sets are one node. Nodes first show only the members with the smallest hashes; who
    shares too few of them with anyone has no link and is done. The rest are compared as the
    module's functions describe: by lists of rare members, in blocks where a list is long.

    Texts without words, null texts included, have an empty set, are linked with nothing and keep
    their own identifier. A null identifier counts as larger than all others and is returned as
    null. An empty table gives no rows.
    """
    read = id_and_text(docs, id_col, text_col)
    sets, nodes, links = similar_sets(read, k)
    roots = components(links)
    named = roots.join(nodes.select(F.col("sid").alias("node"), "ord"), "node")
    least = named.groupBy("root").agg(F.min("ord").alias("least"))
    linked = roots.join(least, "root").select(F.col("node").alias("sid"), "least")
    classes = nodes.join(linked, "sid", "left").select(
        "n", "d1", "d2", F.coalesce("least", "ord").alias("least")
    )
    return sets.join(classes, ["n", "d1", "d2"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.nullif(F.coalesce("least", "ord"), F.lit(LAST)).alias("component_id"),
    )
