"""Personal data: plain patterns against brute force, disguises, places in the source."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lograft.llm.personal import (
    KINDS,
    listed,
    masked,
    personal_data,
    report_personal_data,
    without_personal_data,
)

SCHEMA = "doc_id long, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The contract's patterns as they are written."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [2 * d if i % 2 else d for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in doubled) % 10:
                    continue
            out.append((m.start(), order, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text("a.@-1 4+()%_9éо\n", max_size=60))
def test_plain_patterns_against_brute_force(text):
    assert [tuple(s) for s in personal_data(text).base] == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["1.2.3.4", "300.1.1.1", "a@b.c", "x.1@m-2.e.org", "4111 1111 1111 1111", "+1 (578) 555-6437",
     "4111111111111112", "1.2.3.4.5", "@", "+", " ", ".", "-", "five", "[dot]", "0" * 9]
), max_size=9))
def test_joined_identifiers_against_brute_force(parts):
    text = "".join(parts)
    found = personal_data(text)
    assert [tuple(s) for s in found.base] == brute(text)
    for s in found.added:
        inside = [p for p in found.base if p.kind == s.kind and p.start <= s.start and s.end <= p.end]
        assert 0 <= s.start < s.end <= len(text) and not inside


DISGUISED = [
    ("email", "john dot doe at example dot com"), ("email", "anna [at] mail3 [dot] example [dot] org"),
    ("email", "anna(at)example.com"), ("email", "jоhn.doe@mail.com"), ("email", "joe.b at example.com"),
    ("email", "info arroba ejemplo punto es"), ("email", "x_1 @ mail2.example.com"),
    ("email", "john＠example．com"), ("email", "jo​hn@ex​ample.com"),
    ("email", "john&#64;example&#46;com"), ("email", "x%40mail.example.com"), ("email", "rene\u0301@ex.org"),
    ("ip", "1\ufe0f\u20e30.0.0.1"),
    ("email", "john_at_example_dot_com"), ("email", "eva{AT}firma{PUNKT}de"),
    ("ip", "192[.]168[.]0[.]1"), ("ip", "192 dot 168 dot zero dot one"), ("ip", "l92.l68.O.1"),
    ("card", "four one one one 1111 1111 1111"), ("card", "４１１１１１１１１１１１１１１１"),
    ("card", "4111–1111–1111–1111"), ("phone", "plus one (five seven eight) five five five six four three seven"),
    ("phone", "＋1 (578) 555‑6437"), ("card", "vier eins eins eins 1111 1111 1111"),
]


@pytest.mark.parametrize("kind, text", DISGUISED)
@pytest.mark.parametrize("frame", ["{}", "Über: {}; fin.", "a\n{}\nÜ"])
def test_disguises_are_mapped_back(kind, text, frame):
    whole = frame.format(text)
    added = personal_data(whole).added
    assert (KINDS.index(kind), text) in [(s.kind, whole[s.start : s.end]) for s in added]


@pytest.mark.parametrize("text", [
    "we met at example.com today", "look at the dot on the i", "at one point the other",
    "look at this point it is here", "un deux trois", "one of two at home", "see (at) x . And",
    "Version 1.2.3 vom 4. 5.", "тест по почте", "I 5 O", "• eins · zwei", "a [dot] b", "",
])
def test_clean_texts_are_left_alone(text):
    assert personal_data(text) == ([], [])


def test_identifiers_in_runs_with_too_many_digits():
    text = "on +1 (578) 555-6437 4918187128635271 eredth"
    found = personal_data(text)
    assert found.base == []
    assert listed(found.added) == "phone:3:20,card:21:37"
    assert masked(text, found.added) == "on <phone> <card> eredth"


def test_long_texts_take_time_in_proportion():
    for text in (" " * 400_000 + "(at)", "a" * 400_000 + "@" + "b" * 400_000, "1" * 400_000 + " l9",
                 "1 " * 100_000 + "O1", "a@" * 200_000, "0" * 9000 + "1.2.3.4"):
        personal_data(text)


def test_report_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd"), (4, "x [at] y.com " * 3000),
            (5, "é" * 9 + " 1.2.3.4")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = report_personal_data(frame).collect()
    assert len(got) == len(rows)
    none = hashlib.sha256(b"").hexdigest()
    by_id = {r.doc_id: r for r in got}
    assert (by_id[1].spans, by_id[1].base_sha256, by_id[2].n_email) == ("", none, 0)
    assert (by_id[None].spans, by_id[None].n_email) == ("email:0:6", 1)
    assert (by_id[4].n_email, by_id[4].n_added, by_id[4].base_sha256) == (0, 3000, none)
    assert by_id[5].spans == "ip:10:17"
    assert report_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_masking_keeps_other_columns(spark):
    frame = spark.createDataFrame(
        [(1, "to a@b.cd", 7), (2, None, 8)], "spans long, text string, n_email int"
    )
    got = without_personal_data(frame)
    assert got.schema == frame.schema
    assert sorted(map(tuple, got.collect())) == [(1, "to <email>", 7), (2, None, 8)]


def test_invalid_utf8_is_replaced(spark):
    frame = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF2061406221622E6364' AS STRING) AS text")
    frame = frame.unionByName(
        spark.sql("SELECT 2L AS doc_id, CAST(X'FF2061406263642E6566' AS STRING) AS text")
    )
    got = {r.doc_id: r.spans for r in report_personal_data(frame).collect()}
    assert got[2] == "email:2:10"
