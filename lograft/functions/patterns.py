"""What a pattern says about the texts it can match."""

from __future__ import annotations

import re

_QUANTIFIER = re.compile(r"([?*+]|\{(\d+)(?:,\d*)?\})[?+]?")
_CLASS = re.compile(r"\[\^?\]?(?:\\.|\[:\^?[a-z]+:\]|[^\]\\\[])*\]")
# Escapes that stand for one character or none, whatever it is.
_PLAIN_ESCAPES = frozenset("dDsSwWbBnrtfAzZvhH.^$|?*+()[]{}\\/-\"'")


class _Unread(Exception):
    """A construct whose meaning for literals is not worked out."""


def required_texts(pattern: str) -> frozenset[str] | None:
    """Runs of letters of which every match holds at least one; None where nothing is sure.

    Flags, look-around, references and quoting give None, as does whatever else is not read here.
    """
    try:
        found, end = _alternatives(pattern, 0)
    except _Unread:
        return None
    return found if end == len(pattern) else None


def _alternatives(pattern: str, at: int) -> tuple[frozenset[str] | None, int]:
    branches = []
    while True:
        found, at = _sequence(pattern, at)
        branches.append(found)
        if at == len(pattern) or pattern[at] == ")":
            break
        at += 1
    if None in branches:
        return None, at
    return frozenset().union(*branches), at


def _sequence(pattern: str, at: int) -> tuple[frozenset[str] | None, int]:
    """The best that one branch requires: whose shortest text is longest."""
    found: list[frozenset[str]] = []
    run = ""

    def ended() -> None:
        nonlocal run
        # Numbers are shown in a form of their own, which may bring or lose an exponent's letter.
        if set(run) - {"e", "E"}:
            found.append(frozenset([run]))
        run = ""

    while at < len(pattern) and pattern[at] not in "|)":
        char, inner = pattern[at], None
        letter = ""
        if char == "(":
            if pattern.startswith("(?", at) and not pattern.startswith("(?:", at):
                raise _Unread
            inner, at = _alternatives(pattern, at + (3 if pattern.startswith("(?:", at) else 1))
            if at == len(pattern):
                raise _Unread
            at += 1
        elif char == "[":
            group = _CLASS.match(pattern, at)
            if not group or "&&" in group[0]:
                raise _Unread
            at = group.end()
        elif char == "\\":
            if pattern[at + 1 : at + 2] not in _PLAIN_ESCAPES or at + 1 == len(pattern):
                raise _Unread
            at += 2
        elif char in "?*+{":
            raise _Unread
        else:
            letter = char if char.isalpha() else ""
            at += 1
        many = _QUANTIFIER.match(pattern, at)
        if many:
            at = many.end()
            least = int(many[2]) if many[2] else int(many[1] == "+")
            if least:
                run += letter
            ended()
            if inner and least:
                found.append(inner)
        elif letter:
            run += letter
        else:
            ended()
            if inner:
                found.append(inner)
    ended()
    best = max(found, key=lambda texts: min(map(len, texts)), default=None)
    return best, at


_ESCAPED_OR_CLASS = re.compile(
    r"\\Q.*?(?:\\E|\Z)|\\.|\[\^?\]?(?:\\.|\[:\^?[a-z]+:\]|[^\]\\])*\]|(\(\?[a-zA-Z]*m)", re.S
)


def has_multi_line_flag(pattern: str) -> bool:
    """Whether a group switches the multi-line flag on; escaped parentheses and classes do not."""
    return any(m[1] for m in _ESCAPED_OR_CLASS.finditer(pattern))
