"""Where a text stops being JSON: a byte-class scan over many texts side by side.

The texts of a batch are read one byte place after the other, all at once: a table gives each text's
next state from its state and the class of its byte. Braces and brackets that are open are kept in one
array for all texts. No values are made, and only texts already known to be no record are looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lograft.functions.classify import json_part, trimmed
from lograft.functions.reassembly import MAX_DEPTH, shipped

_STATES = (
    "value", "first_value", "first_key", "next_key", "colon", "after", "end",
    "key", "key_escape", "key_u1", "key_u2", "key_u3", "key_u4",
    "text", "text_escape", "text_u1", "text_u2", "text_u3", "text_u4",
    "minus", "zero", "digits", "point", "fraction", "exponent", "sign", "power",
    "t", "tr", "tru", "f", "fa", "fal", "fals", "n", "nu", "nul", "wrong",
)
_AT = {name: i for i, name in enumerate(_STATES)}
_WRONG = _AT["wrong"]
# What else a byte does.
_NOTHING, _OPEN_OBJECT, _OPEN_ARRAY, _CLOSE_OBJECT, _CLOSE_ARRAY, _COMMA = range(6)

_TABLE = np.full((len(_STATES), 256), _WRONG, np.uint8)
_ACTION = np.zeros((len(_STATES), 256), np.uint8)


def _on(states: str, chars: bytes, to: str, action: int = _NOTHING) -> None:
    for state in states.split():
        for byte in chars:
            _TABLE[_AT[state], byte], _ACTION[_AT[state], byte] = _AT[to], action


def _fill_tables() -> None:
    digits, hexes = b"0123456789", b"0123456789abcdefABCDEF"
    inside = bytes(b for b in range(32, 256) if b not in b'"\\')
    for state in ("value", "first_value", "first_key", "next_key", "colon", "after", "end"):
        _on(state, b" \t\n\r", state)
    _on("value first_value", b'"', "text")
    _on("value first_value", b"{", "first_key", _OPEN_OBJECT)
    _on("value first_value", b"[", "first_value", _OPEN_ARRAY)
    for char, to in ((b"-", "minus"), (b"0", "zero"), (digits[1:], "digits"), (b"t", "t"), (b"f", "f"),
                     (b"n", "n")):
        _on("value first_value", char, to)
    _on("first_value", b"]", "after", _CLOSE_ARRAY)
    _on("first_key next_key", b'"', "key")
    _on("first_key", b"}", "after", _CLOSE_OBJECT)
    _on("colon", b":", "value")
    for kind, then in (("key", "colon"), ("text", "after")):
        _on(kind, inside, kind)
        _on(kind, b'"', then)
        _on(kind, b"\\", f"{kind}_escape")
        _on(f"{kind}_escape", b'"\\/bfnrt', kind)
        _on(f"{kind}_escape", b"u", f"{kind}_u1")
        for n, to in ((1, "_u2"), (2, "_u3"), (3, "_u4"), (4, "")):
            _on(f"{kind}_u{n}", hexes, kind + to)
    numbers = "zero digits fraction power"
    for state in ("after", *numbers.split()):
        _on(state, b" \t\n\r", "after")
        _on(state, b",", "after", _COMMA)
        _on(state, b"}", "after", _CLOSE_OBJECT)
        _on(state, b"]", "after", _CLOSE_ARRAY)
    _on("minus", b"0", "zero")
    _on("minus", digits[1:], "digits")
    _on("digits", digits, "digits")
    _on("zero digits", b".", "point")
    _on("zero digits fraction", b"eE", "exponent")
    _on("point fraction", digits, "fraction")
    _on("exponent", b"+-", "sign")
    _on("exponent sign power", digits, "power")
    for word in ("true", "false", "null"):
        for n in range(1, len(word)):
            to = word[: n + 1] if n + 1 < len(word) else "after"
            _on(word[:n], word[n : n + 1].encode(), to)


_fill_tables()

# What is said of an offence.
CUT_OFF, TRAILING, UNEXPECTED = (
    "invalid JSON: unexpected end", "invalid JSON: trailing characters",
    "invalid JSON: unexpected character",
)
#: Texts of about this many bytes in all are scanned side by side.
_SIDE_BY_SIDE = 1 << 22


def first_offences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Place and kind of the first byte at which each text, from its brace on, is no JSON object.

    The kind is 0 for a text that ends too early (its place is its length), 1 for something behind
    the object, 2 for another byte, and -1 where the text is an object by its bytes.
    """
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    place, kind = sizes.copy(), np.zeros(n, np.int64)
    state = np.full(n, _AT["value"], np.uint8)
    depth = np.zeros(n, np.int64)
    # Whether what is open at each depth is an object.
    object_at = np.zeros((n, MAX_DEPTH + 2), bool)
    live = np.flatnonzero(sizes > 0)
    for k in range(int(sizes.max(initial=0))):
        live = live[sizes[live] > k]
        if not len(live):
            break
        byte = data[starts[live] + k]
        was = state[live]
        to, action = _TABLE[was, byte], _ACTION[was, byte]
        acted = np.flatnonzero(action)
        if len(acted):
            who, what = live[acted], action[acted]
            level = depth[who]
            inside_object = object_at[who, level] & (level > 0)
            opens = what <= _OPEN_ARRAY
            closes = (what == _CLOSE_OBJECT) | (what == _CLOSE_ARRAY)
            fits = np.where(what == _CLOSE_OBJECT, inside_object, ~inside_object) & (level > 0)
            too_deep = opens & (level >= MAX_DEPTH)
            wrong = (closes & ~fits) | too_deep
            level = np.where(opens & ~too_deep, level + 1, level)
            object_at[who[opens], level[opens]] = what[opens] == _OPEN_OBJECT
            level = np.where(closes & fits, level - 1, level)
            depth[who] = level
            comma = what == _COMMA
            after_comma = np.where(inside_object, _AT["next_key"], _AT["value"])
            next_state = np.where(comma, after_comma, to[acted])
            next_state = np.where(closes & (level == 0), _AT["end"], next_state)
            to[acted] = np.where(wrong, _WRONG, next_state)
        state[live] = to
        bad = to == _WRONG
        if bad.any():
            who = live[bad]
            place[who] = k
            kind[who] = np.where(was[bad] == _AT["end"], 1, 2)
            live = live[~bad]
    kind[(state == _AT["end"]) & (place == sizes)] = -1
    return place, kind


def _places(texts: pd.Series) -> pd.DataFrame:
    """Message, line and column (both from 1) per text; nulls where there is no text."""
    rows: list[tuple] = [(None, None, None)] * len(texts)
    # Texts of like length are read together, so that a long one holds no others up.
    there = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: len(texts.iat[i]))
    a = 0
    while a < len(there):
        b, held = a, 0
        while b < len(there) and (b == a or held < _SIDE_BY_SIDE):
            held += len(texts.iat[there[b]])
            b += 1
        some = [bytes(texts.iat[i]) for i in there[a:b]]
        for i, text, at, kind in zip(there[a:b], some, *first_offences(some), strict=True):
            if kind < 0:
                rows[i] = ("invalid JSON", None, None)
                continue
            # At the end it is the last byte that is named.
            upto = min(int(at) + 1, len(text))
            line = text.count(b"\n", 0, upto - (kind != 0)) + 1
            column = upto - (text.rfind(b"\n", 0, upto - (kind != 0)) + 1)
            rows[i] = ((CUT_OFF, TRAILING, UNEXPECTED)[kind], line, column)
        a = b
    return pd.DataFrame(rows, columns=["message", "line", "column"]).astype(
        {"line": "Int32", "column": "Int32"}
    )


shipped(__name__)


def offence(text: Column) -> Column:
    """Struct (message, line, column) for the possible record in a raw line; null without a brace.

    Only texts that are not null go to the scan, in Arrow batches.
    """
    scan = F.pandas_udf(_places, "message string, line int, column int")
    part = json_part(trimmed(text))
    return F.when(part.isNotNull(), scan(part.cast("binary")))
