"""Where a text stops being JSON, against the standard library's reader."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lograft import LogOptions, format_lines
from lograft.functions.offence import first_offences

CASES = [
    ('{"level":"info", "msg":}', 1, 24, 2), ('{"a":1', 1, 6, 0), ("{", 1, 1, 0), ('{"a":1} x', 1, 9, 1),
    ('{"a":1,}', 1, 8, 2), ("{a", 1, 2, 2), ('{"a" 1}', 1, 6, 2), ('{"a":01}', 1, 7, 2),
    ('{"a":nul}', 1, 9, 2), ('{"a":"\\x"}', 1, 8, 2), ('{"a":"\t"}', 1, 7, 2), ('{"a":[1}', 1, 8, 2),
    ('{"a":{"b":[]]', 1, 13, 2), ('{\n"a"\n;}', 3, 1, 2), ('{"a":"\\u00g0"}', 1, 11, 2), ('{"a":-}', 1, 7, 2),
    ('{"a":1.}', 1, 8, 2), ('{"a":"é" x}', 1, 11, 2), ('{"a":1}}', 1, 8, 1), ('{"a":"x', 1, 7, 0),
]


@pytest.mark.parametrize("text, line, column, kind", CASES)
def test_places(text, line, column, kind):
    raw = text.encode()
    (place,), (found,) = first_offences([raw])
    assert found == kind
    upto = min(place + 1, len(raw))
    before = raw[: upto - (kind != 0)]
    assert (before.count(b"\n") + 1, upto - (before.rfind(b"\n") + 1)) == (line, column)


def standard(text):
    """Whether the text is one object, and if not, whether it could still become one."""
    try:
        json.loads(text, parse_constant=lambda n: 1 / 0)
        return True
    except (ValueError, ZeroDivisionError):
        return False


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.text('{}[]",:01-+.eEtrufalsn\\ x\n', max_size=24), max_size=4))
def test_the_scan_agrees_with_the_standard_reader(bodies):
    texts = ["{" + b for b in bodies]
    places, kinds = first_offences([t.encode() for t in texts])
    for text, place, kind in zip(texts, places, kinds, strict=True):
        assert (kind == -1) == standard(text)
        if kind == 0:
            assert place == len(text)
        elif kind > 0:
            # What comes before can go on: cut off there, the text ends too early or is whole.
            (_,), (before,) = first_offences([text[:place].encode()])
            assert before == (-1 if kind == 1 else 0) and place < len(text)


def test_depth_and_length():
    deep = b'{"a":' + b"[" * 200
    (place,), (kind,) = first_offences([deep])
    assert (place, kind) == (5 + 126, 2)
    (place,), (kind,) = first_offences([b'{"a":"' + b"x" * 200_000])
    assert (place, kind) == (200_006, 0)


def test_verbose_lines_show_the_place(spark):
    df = spark.createDataFrame([('{"a":1,}',), ("plain",), ('x {"a"',), ('{"a":1e999}',), (None,)], "line string")
    shown = [r.rendered for r in format_lines(df, options=LogOptions(verbose=True)).collect()]
    assert shown == [
        '{"a":1,}\n  parse error: [1:8] invalid JSON: unexpected character', "plain",
        'x {"a"\n  parse error: [1:4] invalid JSON: unexpected end',
        '{"a":1e999}\n  parse error: invalid JSON',
    ]
