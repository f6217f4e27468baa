"""Reassembly against the plain sequential rule, and its independence of blocks."""

import random

import pytest
from pyspark.sql import functions as F

from lograft import LogOptions, number_lines, reassemble_lines
from lograft.functions import reassembly
from lograft.functions.reassembly import Sanitizer, holds_record

PIECES = [
    '{"a":"x', 'y"}', "plain", '{"a":1}', '{"b":"u', 'v","c":[', "1]}", 'pre {"p":"q', '{ "s', "}",
    'odd " {"m":"n', None, '{"t":"a\\\\nb', "", 'z\\"w"}',
]


def might_start(line):
    at = line.strip().find("{")
    return at >= 0 and line.strip()[at + 1 :].lstrip().startswith('"')


def sequential(lines, limit):
    """The rule as it reads: one line after the other, one buffer."""
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        if line is None or holds_record(line) or not might_start(line):
            if line is not None:
                out.append((i, line))
            i += 1
            continue
        text, used, joined = line, 1, None
        for follower in lines[i + 1 : i + 1 + limit]:
            used += 1
            if follower is None:
                continue
            text += "\n" + follower
            clean = Sanitizer().feed(text)
            if holds_record(clean):
                joined = clean
                break
        if joined is not None:
            out.append((i, joined))
        else:
            out.extend((i + k, s) for k, s in enumerate(lines[i : i + used]) if s is not None)
        i += used
    return out


def test_walks_meet_the_sequential_rule():
    rng = random.Random(7)
    for _ in range(1500):
        limit = rng.randint(1, 5)
        lines = [rng.choice(PIECES) for _ in range(rng.randint(1, 40))]
        flagged = [
            (n, s, s is not None and might_start(s) and not holds_record(s))
            for n, s in enumerate(lines)
        ]
        out = []

        def visit(number, used, joined):
            if joined is not None:
                out.append((number, joined))
            else:
                out.extend((n, s) for n, s, _ in used if s is not None)

        reassembly.walk(flagged, limit, [0], visit)
        assert out == sequential(lines, limit)


@pytest.mark.parametrize("block_lines", [7, 16, 1000])
def test_result_does_not_depend_on_blocks(spark, block_lines):
    rng = random.Random(11)
    sources = {
        f"s{k}": [rng.choice(PIECES) for _ in range(rng.randint(1, 300))] for k in range(4)
    }
    # Stretches without any starter, so that lines pass by and blocks are left out.
    sources["calm"] = ["plain"] * 90 + ['{"a":"x', 'y"}'] + ["plain"] * 50 + ['{"a":"x']
    rows = [(s, n, line) for s, lines in sources.items() for n, line in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, line_no bigint, line string").repartition(5)
    options = LogOptions(max_continuation_lines=5)
    got = reassemble_lines(df, options, block_lines).collect()
    expected = {
        (s, n, text) for s, lines in sources.items() for n, text in sequential(lines, 5)
    }
    assert {(r.source, r.line_no, r.line) for r in got} == expected
    assert len(got) == len(expected)


def test_number_lines(spark):
    rows = [("a" if k % 3 else "b", k * 7, str(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "source string, pos bigint, line string").repartition(6)
    got = number_lines(df, "source", "pos", width=64)
    for source in "ab":
        mine = got.filter(F.col("source") == source).orderBy("pos").collect()
        assert [r.line_no for r in mine] == list(range(len(mine)))


def test_two_hundred_lines(spark):
    ok = ['{"m":"x'] + ["y"] * 199 + ['"}']
    late = ['{"m":"x'] + ["y"] * 200 + ['"}']
    rows = [("ok", n, s) for n, s in enumerate(ok)] + [("late", n, s) for n, s in enumerate(late)]
    df = spark.createDataFrame(rows, "source string, line_no bigint, line string")
    counts = {r["source"]: r["count"] for r in reassemble_lines(df).groupBy("source").count().collect()}
    assert counts == {"ok": 1, "late": 202}


@pytest.mark.parametrize(
    "text, clean",
    [
        ('{"a":"x\ny"}', '{"a":"x\\ny"}'),
        ('{"a":"x\r\ny"}', '{"a":"x\\r\\ny"}'),
        ('{\n"a":1\n}', '{\n"a":1\n}'),
        ('{"a":"x\\"\ny"}', '{"a":"x\\"\\ny"}'),
        ('{"a":"x\ty"}', '{"a":"x\ty"}'),
        ('{"a":"x\\\ny"}', '{"a":"x\\\ny"}'),
        ('odd " {"a":"x\ny"}', 'odd " {"a":"x\ny"}'),
        ('{"a":"x\n', '{"a":"x\\n'),
        ('{"a":"\n\n\r', '{"a":"\\n\\n\\r'),
    ],
)
def test_sanitize(spark, text, clean):
    from lograft.functions.repair import sanitize_newlines

    assert Sanitizer().feed(text) == clean
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sanitize_newlines(F.col("t"))).first()[0] == clean
