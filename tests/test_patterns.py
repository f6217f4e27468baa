"""What patterns require, and that lines dropped before they are read could not match."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lograft import LogOptions, filter_logs, parse_logs
from lograft.functions.patterns import has_multi_line_flag, required_texts
from lograft.operators.filters import jvm_pattern


@pytest.mark.parametrize("pattern, texts", [
    ("error", {"error"}), ("time ?out", {"time"}), ("a+bcd", {"bcd"}), ("x(foo|bar)y", {"foo", "bar"}),
    ("foo|b.r", {"foo", "b"}), ("foo|[a]", None), ("(foo)?bars", {"bars"}), ("(?:foo){2}b", {"foo"}),
    ("^err\\b", {"err"}), ("ab*", {"a"}), ("(?i)foo", None), ("\\Qfoo\\E", None), ("(a)\\1", None),
    ("e1|E", None), ("", None), ("12", None), ("a{0,3}", None), ("foo(", None), ("[[:alpha:]]x", {"x"}),
    ("\\pLfoo", None), ("fée", {"fée"}),
])
def test_required_texts(pattern, texts):
    assert required_texts(pattern) == (None if texts is None else frozenset(texts))


@settings(max_examples=2000, deadline=None)
@given(st.text("ab|()?*+.[]\\d{1}e", max_size=9), st.lists(st.text("abe1d", max_size=7), max_size=6))
def test_every_match_holds_a_required_text(pattern, texts):
    try:
        compiled = re.compile(pattern)
    except (re.error, OverflowError):
        return
    wanted = required_texts(pattern)
    if wanted is None:
        return
    for text in texts:
        assert not compiled.search(text) or any(w in text for w in wanted)


@pytest.mark.parametrize("pattern, flag", [
    ("(?m)a$", True), ("(?im:a$)", True), (r"\(?main$", False), ("[(?m]a$", False),
    (r"\Q(?m\Ea$", False), (r"\\(?m)a$", True), ("(?-m)a$", False),
])
def test_flags_are_told_from_escaped_text(pattern, flag):
    assert has_multi_line_flag(pattern) == flag
    assert (r"\z" not in jvm_pattern(pattern)) == flag


LINES = [
    '{"msg":"timeout"}', '{"msg":"t\\u0069meout"}', '{"msg":"x","k":["a","timeout"]}', "a timeout", "b",
    '{"msg":"y","n":1e21}', '{"timeout":1,"msg":"key only"}', '{"msg":"m","o":{"a":{"timeout":1}}}', None,
    '{"msg":"time\\nout"}', '{"a": {"b": "TIMEOUT"}}',
]


@pytest.mark.parametrize("pattern", ["timeout", "time(out|x)|zzz", "e", "(?i)timeout", "^b$", "1e21"])
def test_lines_that_go_early_could_not_match(spark, pattern):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    options = LogOptions(grep=pattern)
    logs = parse_logs(df)
    early = sorted(r.line for r in filter_logs(logs, options).collect())
    late = filter_logs(logs.withColumnRenamed("line", "l").drop("l"), options).collect()
    assert len(early) == len(late)
    assert early == sorted(
        r.l for r in filter_logs(parse_logs(df.selectExpr("line AS l", "line")), options).collect()
    )


def test_the_test_stands_below_the_read(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    plan = filter_logs(parse_logs(df), LogOptions(grep="timeout"))._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert text.rindex("Contains(line") > text.rindex("from_json")
