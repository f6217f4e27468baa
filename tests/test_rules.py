"""The rules that are easily got wrong, one table of lines at a time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lograft import LogOptions, OptionError, filter_logs, format_lines, parse_logs
from lograft.functions.timestamps import spark_pattern


def parsed(spark, lines, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    logs = parse_logs(df, options=LogOptions(**options))
    return logs.withColumn("extra", F.transform_values("extra", lambda k, v: F.to_json(v))).orderBy(
        "id"
    ).collect()


def shown(spark, line, **options):
    df = spark.createDataFrame([(line,)], "line string")
    rows = format_lines(df, options=LogOptions(**options)).collect()
    return rows[0].rendered if rows else None


def test_kinds(spark):
    cases = {
        '{"a":1}': "json", "  {} ": "json", "{ }": "json", "": "raw", "  ": "raw", "[1]": "raw",
        "plain": "raw", "prefix {not json}": "raw", '{"a":1} junk': "raw", '{"a":1,}': "raw",
        '{"a":1}{"b":2}': "raw", '{"a":NaN}': "raw", "{'a':1}": "raw", 'x {"a":1}': "embedded",
        'value={count} {"level":"info"}': "raw", '{"a":"x\ty"}': "raw", '{"a":"\\ud800"}': "raw",
        '{"a":"\\ud83d\\ude00"}': "json", ' {"a":1}　': "json", '{"a":"}': "raw",
        '{"a":' * 126 + "{}" + "}" * 126: "json", '{"a":' * 127 + "{}" + "}" * 127: "raw",
        '{"a":1},{"b":2}': "raw", '{"a":[1}': "raw",
    }
    got = parsed(spark, list(cases))
    assert {r.line: r.kind for r in got} == cases


def test_aliases_go_by_presence(spark):
    rows = parsed(
        spark,
        [
            '{"level":null,"severity":"error","msg":null,"message":"m"}',
            '{"level":"30"}', '{"level":30}', '{"level":29.9}', '{"level":14.9}', '{"level":true}',
            '{"level":1e30}', '{"level":-5}', '{"level":"DPANIC"}', '{"level":55}',
            '{"msg":1,"msg":"last"}',
        ],
    )
    assert [r.level_num for r in rows] == [None, None, 30, 30, 10, None, 60, 10, None, 60, None]
    assert rows[0].message is None
    assert rows[0].extra == {"severity": '"error"', "message": '"m"'}
    assert rows[10].message == "last"


def test_custom_keys_replace_the_aliases(spark):
    line = '{"level":"info","msg":"a","note":{"b":1.5,"a":[2.0]},"log.level":"x"}'
    (row,) = parsed(spark, [line], message_key="note", logger_key="level")
    assert (row.level, row.logger) == ("info", None)
    assert row.extra == {"msg": '"a"', "log.level": '"x"'}
    assert row.message.startswith('{"a":[2')


def test_flatten_and_text(spark):
    line = (
        '{"a":{"b":1,"n":null,"deep":{"z":1,"y":2}},"a.b":"won","e":{},"arr":[1.0,{"k":2}],'
        '"num":1.0,"big":1768473000.123,"s":"1.5E7","nul":null,"flag":true}'
    )
    (row,) = parsed(spark, [line])
    assert row.extra_text == {
        "a.b": "won", "a.n": "null", "a.deep": '{"y":2,"z":1}', "num": "1.0", "s": "1.5E7",
        "big": "1768473000.123", "nul": "null", "flag": "true", "arr": '[1.0,{"k":2}]',
    }
    assert set(row.extra) == set(row.extra_text)


@pytest.mark.parametrize(
    "value, instant, nanos",
    [
        ('"2026-01-15T12:30:00.000+02:00"', "2026-01-15T10:30:00", 0),
        ('"2026-01-15 10:30:00.456"', "2026-01-15T10:30:00.456", 0),
        ('"2026-01-15T10:30:00.123456789Z"', "2026-01-15T10:30:00.123456", 789),
        ('"2026-01-15T10:30:00"', None, None),
        ('"2026-01-15T10:30Z"', "2026-01-15T10:30:00", 0),
        ('"20260115T103000Z"', "2026-01-15T10:30:00", 0),
        ('"20260115t1030+0200"', "2026-01-15T08:30:00", 0),
        ('"2026-01-15T10:30:00,123456789Z"', "2026-01-15T10:30:00.123456", 789),
        ('"2026-01-15T05:30:00-05:00[America/New_York]"', "2026-01-15T10:30:00", 0),
        ('"2026-01-15T10:3"', None, None),
        ('"2026-01-15"', None, None),
        ("1768473000", "2026-01-15T10:30:00", 0),
        ('"1768473000"', None, None),
        ("-1", "1969-12-31T23:59:59", 0),
        ("999999999999", None, None),
        ("1000000000000", "2001-09-09T01:46:40", 0),
        ("1000000000000000", "1970-01-12T13:46:40", 0),
        ("1768473000123000001", "2026-01-15T10:30:00.123", 1),
        ("1700000000.5", "2023-11-14T22:13:20.5", 0),
        ("true", None, None),
    ],
)
def test_instants(spark, value, instant, nanos):
    df = spark.createDataFrame([('{"ts":%s}' % value,)], "line string")
    row = parse_logs(df).select(F.unix_micros("ts"), "ts_nanos").first()
    if instant is not None:
        at = dt.datetime.fromisoformat(instant + "+00:00") - dt.datetime.fromtimestamp(
            0, dt.timezone.utc
        )
        instant = at // dt.timedelta(microseconds=1)
    assert tuple(row) == (instant, nanos)


def test_rendering(spark):
    line = 'app | {"level":"err","msg":"m","logger":"l","caller":"c","k":"' + "x" * 130 + '"}'
    assert shown(spark, line, single_line=True) == (
        "ERROR: l app |  m (c) k=" + "x" * 120 + "…"
    )
    assert shown(spark, '{"msg":"a","error":"e1\\r\\ne2\\n"}', key_min_width=6) == (
        "     : a\n error: e1\n        e2"
    )
    assert shown(spark, '{"a_very_long_key_of_30_letters_x":1}', key_min_width=3) == (
        "     :\na_very_long_key_of_30_letters_x: 1"
    )
    assert shown(spark, "") is None
    assert shown(spark, "  ") == "  "
    assert shown(spark, "x", json_output=True) is None


def test_grep_looks_at_values_only(spark):
    df = spark.createDataFrame(
        [('{"level":"error","needle":1}',), ('{"k":{"v":"needle"}}',), ("needle raw",), ("no",)],
        "line string",
    )
    options = LogOptions(grep="needle", no_extra=True)
    kept = filter_logs(parse_logs(df, options=options), options).select("line").collect()
    assert sorted(r.line for r in kept) == ["needle raw", '{"k":{"v":"needle"}}']
    with pytest.raises(OptionError):
        filter_logs(parse_logs(df), LogOptions(grep="(open"))


def test_options():
    for wrong in (
        {"min_level": "loud"}, {"include_fields": "a", "exclude_fields": "b"},
        {"no_extra": True, "include_fields": "a"}, {"timezone": "Not/AZone"},
    ):
        with pytest.raises(OptionError):
            LogOptions(**wrong)
    settings = {
        "level": "WARN", "timezone": "nowhere", "line_gap": 3, "keys": {"message": "note"},
        "levels": {"Verbose": "dbg", "odd": "none"}, "colors": {"err": "Purple", "info": "no"},
    }
    options = LogOptions.layered(settings, line_gap=0)
    assert (options.min_level, options.timezone, options.line_gap) == ("warn", "UTC", 0)
    assert options.message_key == "note"
    assert options.level_aliases == {"verbose": "debug"}
    assert options.level_colors == {"error": "purple"}
    assert spark_pattern("%H:%M %% o'clock") == "HH':'mm' % o''clock'"
