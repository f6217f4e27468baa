"""Rules that once were wrong: long records, vast numbers, joined lines, zones, line ends."""

import pytest
from pyspark.sql import functions as F

from lograft import LogOptions, filter_logs, format_lines, parse_logs, reassemble_lines
from lograft.functions.reassembly import holds_record
from lograft.functions.timestamps import format_timestamp
from lograft.operators.filters import jvm_pattern


def test_long_records_keep_their_fields(spark):
    lines = spark.range(2).select(
        F.concat(
            F.lit('{"level":40,"msg":"m","e":"\\u00e9","n":1.5,"o":{"k":"v"},"x":"'),
            F.repeat(F.lit("a"), F.when(F.col("id") == 0, 10).otherwise(22_000_000)),
            F.lit('"}'),
        ).alias("line")
    )
    logs = parse_logs(lines).select(
        "kind", "level", F.map_keys("extra").alias("keys"),
        F.schema_of_variant(F.element_at("extra", "n")).alias("n"),
        F.size("extra_text").alias("texts"), F.length(F.element_at("extra_text", "x")).alias("x"),
    )
    short, long = sorted(logs.collect(), key=lambda r: r.x)
    assert short[:5] == long[:5] and long.level == "warn" and long.kind == "json"
    assert sorted(long["keys"]) == ["e", "n", "o.k", "x"] and (short.x, long.x) == (10, 22_000_000)


def test_numbers_beyond_a_double_are_no_record(spark):
    cases = {
        '{"a":1e400}': "raw", '{"a":{"b":[-1E+0999]}}': "raw", '{"a":1' + "0" * 400 + "}": "raw",
        '{"a":1e308}': "json", '{"a":"1e400"}': "json", '{"a":1e-400}': "json", "{}": "json",
    }
    df = spark.createDataFrame([(c,) for c in cases], "line string")
    assert {r.line: r.kind for r in parse_logs(df).collect()} == cases
    assert {c: holds_record(c) for c in cases} == {c: k == "json" for c, k in cases.items()}


@pytest.mark.parametrize(
    "lines",
    [
        ['{"a":"x', 'y"}\x1f'],
        ['{"a":"x', 'y","b":' + "[" * 150 + "]" * 150 + "}"],
        ['{"a":"x', 'y","b":1e400}'],
    ],
)
def test_lines_that_make_no_record_stay_apart(spark, lines):
    df = spark.createDataFrame(
        [("s", i, line) for i, line in enumerate([*lines, '{"msg":"m"}'])],
        "source string, line_no long, line string",
    )
    logs = parse_logs(reassemble_lines(df, LogOptions()))
    assert all("\n" not in r.line or r.kind != "raw" for r in logs.collect())


def test_dollar_is_the_very_end(spark):
    assert jvm_pattern(r"a$|[$]\$(b$)") == r"(?dU)a\z|[$]\$(b\z)"
    assert jvm_pattern("(?m)a$") == "(?dU)(?m)a$"
    df = spark.createDataFrame([('{"msg":"foo\\n"}',), ('{"msg":"foo"}',)], "line string")
    options = LogOptions(grep="foo$")
    assert [r.message for r in filter_logs(parse_logs(df), options).collect()] == ["foo"]


def test_the_parsed_column_is_the_one_shown(spark):
    df = spark.createDataFrame([("other", "plain"), ("x", "")], "line string, text string")
    rows = format_lines(df, "text", LogOptions(grep="plain")).collect()
    assert [(r.line, r.rendered) for r in rows] == [("other", "plain")]


def test_local_zone_by_name(spark, monkeypatch):
    monkeypatch.setenv("TZ", "America/New_York")
    stamps = spark.sql(
        "SELECT explode(array(timestamp'2026-07-15T10:30:00Z', timestamp'2026-01-15T10:30:00Z')) AS t"
    )
    shown = stamps.select(
        format_timestamp(F.col("t"), "%H:%M %Z %z %N", "local", F.lit(7)).alias("s")
    )
    assert [r.s for r in shown.collect()] == ["06:30 EDT -0400 000000007", "05:30 EST -0500 000000007"]


def test_numbers_in_arrays(spark):
    df = spark.createDataFrame([('{"a":[1.0,{"k":2,"b":1e10}],"s":["1e10",-0.0]}',)], "line string")
    text = parse_logs(df).first().extra_text
    assert text == {"a": '[1.0,{"b":10000000000.0,"k":2}]', "s": '["1e10",-0.0]'}


def test_the_end_marker_cannot_be_faked(spark):
    cases = {
        '{"a":1,"\\u001fend":0} junk}': "raw", '{"a":1,"\\u001fend":"0"}, {"b":1}': "raw",
        '{"a":1,"\\u001fend":0}': "json", '{"a":1,"a":2}': "json", '{"a":"\\u001f"}': "json",
        '{"\\u001F\\u0065nd":0}}': "raw", '{"a":1}}': "raw", '{"a":1},{"b":2}': "raw",
    }
    df = spark.createDataFrame([(c,) for c in cases], "line string")
    logs = parse_logs(df)
    assert {r.line: r.kind for r in logs.collect()} == cases
    assert logs.filter("line like '%\"a\":2%'").first().extra_text == {"a": "2"}
