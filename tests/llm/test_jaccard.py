"""The n-gram Jaccard join against brute force, also where lists are long and blocks small."""

import random

import numpy as np
import pyarrow as pa
import pytest

import lograft.llm.jaccard as jaccard
from lograft.llm.graph import components
from lograft.llm.jaccard import _listed, block_links, similar_classes

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) > 0:
                parent[root(i)] = root(j)
    last = (1 << 63) - 1
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), last), last if doc is None else doc)
    named = [least[root(i)] for i in range(len(rows))]
    return [
        (doc, len(s), None if c == last else c)
        for (doc, _), s, c in zip(rows, sets, named, strict=True)
    ]


def family(rng, n, size, edits, first):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
    rows = []
    for i in range(n):
        mine = list(base)
        for _ in range(rng.randint(0, edits)):
            mine[rng.randrange(size)] = f"e{rng.randint(0, 10**6)}"
        rows.append((first + i, " ".join(mine)))
    return rows


def corpus(seed):
    rng = random.Random(seed)
    line = " ".join(f"c{i}" for i in range(30))
    rows = family(rng, 60, 60, 3, 1000) + family(rng, 30, 40, 2, 2000)
    rows += [(3000 + i, line + " " + " ".join(f"u{i}x{j}" for j in range(20))) for i in range(40)]
    rows += [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"),
        (7, "a b c d e"), (8, "A B C D E"), (None, "a b c d e"), (None, "q r s t u v"), (4, "x y z"),
        (9, rows[5][1]), (9, rows[5][1]), (10, "İ i ſ s"), (11, "i i s s"), (12, "w " * 3000),
    ]
    return rows


@pytest.mark.parametrize("short, block", [(64, 1024), (4, 16)])
def test_against_brute_force(spark, monkeypatch, short, block):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    rows = corpus(short)
    got = [tuple(r) for r in similar_classes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_edges_of_the_threshold(spark):
    # 9 shared of 10 + 9 + ... : 4 of 5 exactly is linked, just below is not.
    words = [f"t{i}" for i in range(13)]  # 9 shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[:12])), (3, " ".join(words[:9]))]
    got = similar_classes(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == [(9, 1), (8, 1), (5, 3)]


def test_no_rows(spark):
    assert similar_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_block_links_connect_all_similar_sets():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 2**60, 80).astype(np.uint64))
    parts = []
    for _ in range(120):
        mine = base.copy()
        at = rng.choice(80, rng.integers(0, 9), replace=False)
        mine[at] = rng.integers(0, 2**60, len(at)).astype(np.uint64)
        parts.append(np.unique(mine))
    groups = list(range(len(parts)))
    for a, b in block_links(parts):
        both = len(np.intersect1d(parts[a], parts[b]))
        assert 9 * both >= 4 * (len(parts[a]) + len(parts[b]))
        groups = [groups[b] if g == groups[a] else g for g in groups]
    for a in range(len(parts)):
        for b in range(a):
            both = len(np.intersect1d(parts[a], parts[b]))
            if 9 * both >= 4 * (len(parts[a]) + len(parts[b])):
                assert groups[a] == groups[b]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (101, 100)]
    links = spark.createDataFrame(chain, "u long, v long")
    got = dict(components(links).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0


def template_family(n, shared=86, own=18, sizes=(0,)):
    """Documents that share a frame and nothing else; some with less of their own."""
    frame = " ".join(f"frame{i}" for i in range(shared))
    return [
        (i, frame + "".join(f" own{i}x{j}" for j in range(own - sizes[i % len(sizes)])))
        for i in range(n)
    ]


@pytest.mark.parametrize("sizes", [(0,), (0, 1, 2, 3, 9, 17), tuple(range(19)), (0, 0, 0, 0, 18)])
def test_families_on_a_frame_against_brute_force(spark, sizes):
    rows = template_family(150, 40, 18, sizes)
    rng = np.random.default_rng(3)
    rows += [(1000 + i, t + " tail" * int(rng.integers(0, 3))) for i, t in rows[::7]]
    got = similar_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_a_family_on_a_frame_gives_no_stars():
    """Their shared members stand so late that no two of them can be similar."""
    n = 5000
    members = np.repeat(np.arange(3, dtype=np.uint64), n)
    sids = np.tile(np.arange(n, dtype=np.int64), 3)
    places = np.repeat(np.array([18, 19, 20], np.uint32), n)
    table = pa.table(
        [pa.array([x.tobytes()]) for x in (members, sids, np.full(3 * n, 100, np.uint32), places)],
        names=["members", "sids", "sizes", "places"],
    )
    assert len(_listed(table)) == 0


@pytest.mark.parametrize("seed", range(12))
def test_lists_lose_no_pair_that_fits(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(65, 400))
    sizes = rng.integers(60, 131, n)
    places = (rng.random(n) * 0.2 * sizes).astype(int)
    parts = [np.zeros(n, np.uint64), np.arange(n, dtype=np.int64), sizes.astype(np.uint32),
             places.astype(np.uint32)]
    table = pa.table(
        [pa.array([x.tobytes()]) for x in parts], names=["members", "sids", "sizes", "places"]
    )
    found = _listed(table).to_pydict()
    pairs, group = set(), list(range(n))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for u, v, star in zip(*found.values(), strict=True):
        if star:
            group[root(u)] = root(v)
        else:
            pairs.add((u, v))
    left = sizes - places
    for i in range(n):
        for j in range(i + 1, n):
            small, large = sorted((int(sizes[i]), int(sizes[j])))
            fits = 5 * small >= 4 * large and 9 * min(left[i], left[j]) >= 4 * (small + large)
            assert not fits or (i, j) in pairs or root(i) == root(j)
