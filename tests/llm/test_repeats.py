"""Suffix-array and substring dedup against brute force on texts of many kinds."""

import hashlib
import random

import numpy as np
import pytest

from lograft.llm.suffix import doubled_ranks, repeated_bytes
from lograft.llm.substring import substring_dedup

SCHEMA = "doc_id long, text string"


def texts(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choices(words, k=40))
    other = " ".join(rng.choices(words, k=25))
    rows = []
    for i in range(60):
        own = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        rows.append((i * 3 - 20, rng.choice([own, own + " " + passage, passage + own, other + own])))
    rows += [
        (500, rows[3][1]), (501, rows[3][1]), (502, ""), (503, None), (504, "a" * 400),
        (505, "a" * 120), (506, "ab" * 100 + "\n\t" + passage), (None, passage), (None, passage),
        (507, " ".join(["x"] * 50)), (508, " ".join(["x"] * 13)), (509, passage * 30),
        (510, rows[5][1]), (510, rows[5][1]), (511, "\x00" + passage + "\U0001f600" * 20),
    ]
    return rows


def order(doc_id):
    return (1 << 63) - 1 if doc_id is None else doc_id


def gone(rows, units, length):
    first = {}
    for doc, text in rows:
        u = units(text)
        for k in range(len(u) - length + 1):
            key = tuple(u[k : k + length])
            first[key] = min(first.get(key, 1 << 63), order(doc))
    out = []
    for doc, text in rows:
        u = units(text)
        mark = [False] * len(u)
        for k in range(len(u) - length + 1):
            if first[tuple(u[k : k + length])] < order(doc):
                mark[k : k + length] = [True] * length
        out.append((doc, u, mark))
    return out


def runs(mark):
    return sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))


def rank_key(row):
    return tuple(str(x) for x in row)


def test_bytes_against_brute_force(spark):
    rows = texts()
    expected = []
    for doc, u, mark in gone(rows, lambda t: list((t or "").encode()), 50):
        kept = bytes(b for b, m in zip(u, mark) if not m)
        expected.append((doc, len(u), sum(mark), runs(mark), hashlib.sha256(kept).hexdigest()))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in repeated_bytes(frame).collect()]
    assert sorted(got, key=rank_key) == sorted(expected, key=rank_key)
    assert sum(e[2] for e in expected) > 1000


def test_words_against_brute_force(spark):
    rows = texts(6)
    expected = []
    for doc, u, mark in gone(rows, lambda t: (t or "").encode().split(), 13):
        kept = b" ".join(w for w, m in zip(u, mark) if not m)
        expected.append((doc, len(u), sum(mark), runs(mark), hashlib.sha256(kept).hexdigest()))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in substring_dedup(frame).collect()]
    assert sorted(got, key=rank_key) == sorted(expected, key=rank_key)
    assert sum(e[2] for e in expected) > 100


def test_columns_that_come_along(spark):
    frame = spark.createDataFrame(
        [(1, "p" * 80, "x", [1]), (2, "p" * 80 + "é", "y", None)],
        "doc_id long, text string, grp string, ord array<int>",
    )
    renamed = frame.withColumnsRenamed({"grp": "a", "ord": "b"})
    got = repeated_bytes(renamed, with_text=True, carry=("a", "b")).orderBy("doc_id").collect()
    assert [(r.kept_text, r.a, r.b) for r in got] == [("p" * 80, "x", [1]), ("é", "y", None)]
    # Columns named like the operator's own do no harm.
    assert {r.n_removed for r in repeated_bytes(frame).collect()} == {0, 80}
    words = substring_dedup(frame, with_text=True).orderBy("doc_id").collect()
    assert [r.kept_text for r in words] == ["p" * 80, "p" * 80 + "é"]


@pytest.mark.parametrize("operator", [repeated_bytes, substring_dedup])
def test_nothing(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = operator(spark.createDataFrame([(1, None), (None, ""), (None, None)], SCHEMA)).collect()
    assert {r[1:3] for r in rows} == {(0, 0)} and len(rows) == 3


def test_doubled_ranks():
    import numpy as np

    rng = random.Random(1)
    text = bytes(rng.choices(b"ab", k=400)) + b"abba" * 60 + bytes(rng.choices(b"ab", k=300))
    starts = np.arange(len(text) - 49)
    rank = doubled_ranks(text, starts, 50)
    same = {}
    for i in starts.tolist():
        same.setdefault(text[i : i + 50], set()).add(int(rank[i]))
    assert all(len(r) == 1 for r in same.values())
    assert len(set(rank.tolist())) == len(same)


def test_windows_of_one_hash_are_told_apart_by_their_check():
    from lograft.llm.substring import WINDOW, among, by_value

    rng = np.random.default_rng(1)
    for _ in range(200):
        windows = np.zeros(int(rng.integers(0, 30)), WINDOW)
        found = np.zeros(int(rng.integers(0, 30)), WINDOW)
        for table in (windows, found):
            table["hash"], table["check"] = rng.integers(0, 4, (2, len(table)))
        known = {tuple(w) for w in found.tolist()}
        assert among(windows, found).tolist() == [tuple(w) in known for w in windows.tolist()]
        order, new = by_value(windows)
        assert int(new.sum()) == len({tuple(w) for w in windows.tolist()})
        assert [tuple(w) for w in windows[order].tolist()] == sorted(map(tuple, windows.tolist()))
