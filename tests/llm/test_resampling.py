"""Importance resampling against a brute-force version over the same rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lograft.llm.resampling import drawn_texts, fed, resampled, run_buckets

SCHEMA = "doc_id long, text string"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text, longest, buckets):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [
        b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)
    ]
    return [zlib.crc32(r) % buckets for r in runs], len(words)


def brute(rows, target, percent, least, longest, buckets, seed):
    held = [features(t, longest, buckets) for _, t in rows]
    s = Counter(b for f, _ in held for b in f)
    t = Counter(b for text in target for b in features(text, longest, buckets)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for (doc_id, _), (found, words) in zip(rows, held, strict=True):
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
            for b in found
        )
        key = f"{seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, words])
    drawn = sorted(
        (r for r in out if r[5] >= least),
        key=lambda r: (-r[3], r[0] is None, r[0] or 0),
    )
    for place, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = place + 1
    return sorted(map(tuple, out), key=str)


def texts(n):
    rng = np.random.default_rng(n)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "B2", "x" * 90]
    for i in range(n):
        lines = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(rng.integers(0, 7))]
        yield "\n".join([*lines, "the common line"][: rng.integers(1, 9)])


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 97, 40), (2, 70_000, 100)])
def test_against_brute_force(spark, longest, buckets, percent):
    rows = [*enumerate(texts(120)), (None, None), (None, "A b\nc"), (500, ""), (500, "\n\n"),
            (501, "word " * 5000), (502, "z" * 70_000 + "\nZ z"), (503, "a-b_c\x00d\n\x7fe")]
    rows += [rows[3]] * 5
    target = [t for t in texts(9)] + [None, ""]
    got = resampled(
        spark.createDataFrame(rows, SCHEMA).repartition(5),
        spark.createDataFrame([(t,) for t in target], "text string"),
        percent, 5, longest, buckets, 7,
    ).collect()
    expected = brute(rows, target, percent, 5, longest, buckets, 7)
    assert sorted((tuple(r)[:6] for r in got), key=str) == expected


def test_many_copies_of_one_row(spark):
    rows = [(1, "same text here")] * 9001 + [(2, "other words here")] * 3 + [(None, None)] * 4500
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    target = spark.createDataFrame([("same",)], "text string")
    found = resampled(frame, target, 50, 1)
    got = found.collect()
    assert len(got) == len(rows)
    ranks = sorted(r.rank for r in got if r.rank is not None)
    assert ranks == list(range(1, 9004 // 2 + 1))
    expected = brute(rows, ["same"], 50, 1, 1, 10_000, 2024)
    assert sorted((tuple(r)[:6] for r in got), key=str) == expected
    back = sorted(tuple(r) for r in drawn_texts(frame, found).collect())
    by_id = dict(rows)
    assert back == sorted((r[4], r[0], by_id[r[0]]) for r in expected if r[4] is not None)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([("t", 1)], "text string, doc_id int")
    assert resampled(none, target).count() == 0
    rows = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, line int, weight int")
    (row,) = resampled(rows, none, 100, 1).collect()
    assert (row.doc_id, row.n_features, row["rank"]) == (1, 2, 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=80), min_size=1, max_size=9))
def test_checksums_are_carried_on(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    crc = np.array([zlib.crc32(b"ab")] * len(words), np.uint32)
    assert fed(crc, data, starts, ends).tolist() == [zlib.crc32(b"ab" + w) for w in words]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB1 \n-é", max_size=30), max_size=6), st.integers(1, 3))
def test_lines_and_runs_across_them_make_the_whole(rows, longest):
    def held(parts, across=False):
        raw = [p.encode() for p in parts]
        at = np.cumsum([0, *map(len, raw)])
        return run_buckets(np.frombuffer(b"".join(raw), np.uint8), at, longest, 50, across)

    for text in rows:
        whole = held([text])[0].tolist()
        parts = held(text.split("\n"))[0].tolist() + held([text], True)[0].tolist()
        assert sorted(whole) == sorted(parts) == sorted(features(text, longest, 50)[0])
