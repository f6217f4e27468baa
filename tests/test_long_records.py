"""Long records, numbers of every form, and records made of the rows of small files."""

import pytest
from pyspark.sql import functions as F

from lograft import parse_logs
from lograft.functions.values import number_text
from lograft.plans.queries import QUERIES

_FORMS = [
    '"n":1e400', '"n":-1E+0999', '"n":1' + "0" * 320, '"n":[1,{"a":1e400}]', '"n":"1e400"',
    '"n":1e10', '"n":-0.0', '"n":{"a":{"c":1,"b":1e10}}', '"n":"{x"', '"n":"[1e10]"',
    '"n":{"a":"1.0E10"}', '"n":"1.0E10"', '"n":"1234567890123456789012"', '"n":"a \\"{ 1.0E10"',
    '"n":"a \\" 1e999"', '"n":" 1e999"', '"n":"-.E5"', '"n":12345678901234567890123', '"n":".5E3"',
    '"n":"\\u007bx"', '"n":null', '"n":{}', '"n":{"a":[]}', '"n":"1.0E10\\n"', '"1.0E10":{"a":1.50}',
    '"n":\t1e400', '"n":{"a":"x1e999"}', '"{k":"v"', '"n":"é1.0E10"',
]


def test_long_records_are_read_as_short_ones_are(spark):
    """They are looked through in parts, not by patterns over the whole record."""
    cases = [
        (at, size, "{" + form + ',"x":"' + "aE5 1x" * size + '"}')
        for at, form in enumerate(_FORMS)
        for size in (1, 2000)
    ]
    logs = parse_logs(spark.createDataFrame(cases, "at int, size int, line string"))
    found = logs.select(
        "at", "size", "kind",
        F.map_filter("extra_text", lambda k, v: k != "x").cast("string").alias("texts"),
        F.map_keys("extra").cast("string").alias("keys"),
    ).collect()
    short, long = ({r.at: (r.kind, r.texts, r["keys"]) for r in found if r.size == n} for n in (1, 2000))
    assert short == long and {k for k, _, _ in short.values()} == {"json", "raw"}


@pytest.mark.parametrize("name", ["long_records", "nested_numbers"])
def test_records_made_of_small_rows_are_spread_over_tasks(spark, tmp_path, name):
    row = "id AS event_id, timestamp_micros(id) AS ts, id AS user_id, 'view' AS event_type, '{}' AS props"
    events = spark.range(1, 40, 1, 1).selectExpr(*row.split(", "), "1.5D AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 4


def test_numbers_of_every_form_are_shown(spark):
    cases = {
        "1.0": "1.0", "1.5": "1.5", "-0.0": "-0.0", "1.0E10": "10000000000.0", "1.0E300": "1e300",
        "1.5E-7": "1.5e-7", "1.0E16": "1e16", "12345678901234567890123": "1.2345678901234568e22",
        "7": "7", "18446744073709551615": "18446744073709551615", "-9223372036854775808": "-9223372036854775808",
    }
    found = spark.createDataFrame([(c,) for c in cases], "t string").select("t", number_text(F.col("t")))
    assert dict(found.collect()) == cases
