"""Helpers that run inside tasks: joining broken records back together.

Whether a record can be joined from a line on depends on that line and the ones after it alone,
never on what came before. So every position has one successor (itself plus the lines its record
uses up), and walks begun at different positions can be followed side by side until they meet.
"""

from __future__ import annotations

import json
import re
import sys
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark import cloudpickle

from lograft.tables import WHITE_SPACE

_SPACE = " \t\n\r"
# As deep as the column gate reads.
MAX_DEPTH = 127
_STRING_CHARS = re.compile(r'["\\\n\r]')
_DOUBLED = re.compile(r'\\(\\["nrtbfu/\\]|.)', re.S)
_STRINGS = re.compile(r'"(?:[^"\\]|\\(?:\\["nrtbfu/\\]|.))*"', re.S)
_PAIRS = re.compile(
    r"\\\\|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
)
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}")


def _refuse(name: str):
    raise ValueError(name)


def _within(number: str) -> int:
    """Refuse a number beyond a double, as the column gate does."""
    if len(number) > 300 or "e" in number or "E" in number:
        if float(number) in (float("inf"), float("-inf")):
            raise ValueError(number)
    return 0


def _depth(value) -> int:
    """Levels of nesting, without recursion."""
    deepest, open_ = 0, [(value, 1)]
    while open_:
        inner, level = open_.pop()
        if isinstance(inner, (dict, list)):
            deepest = max(deepest, level)
            inner = inner.values() if isinstance(inner, dict) else inner
            open_.extend((v, level + 1) for v in inner)
    return deepest


class Sanitizer:
    """Escapes raw line ends inside JSON strings, piece by piece."""

    def __init__(self) -> None:
        self.inside = False
        self.escaped = False

    def feed(self, piece: str) -> str:
        out, start = [], 0
        if self.escaped and piece:
            out.append(piece[0])
            start, self.escaped = 1, False
        while True:
            found = _STRING_CHARS.search(piece, start)
            if found is None:
                out.append(piece[start:])
                return "".join(out)
            at, char = found.start(), found.group()
            out.append(piece[start:at])
            start = at + 1
            if char == '"':
                self.inside = not self.inside
                out.append(char)
            elif not self.inside:
                out.append(char)
            elif char == "\\":
                out.append(piece[at : at + 2])
                start = at + 2
                self.escaped = at + 1 == len(piece)
            else:
                out.append("\\n" if char == "\n" else "\\r")


def is_object(text: str) -> bool:
    """Whether the whole text is one JSON object."""
    try:
        decoder = json.JSONDecoder(parse_constant=_refuse, parse_int=_within, parse_float=_within)
        value, end = decoder.raw_decode(text)
    except (ValueError, RecursionError):
        return False
    if _depth(value) > MAX_DEPTH or text[end:].strip(_SPACE) or not isinstance(value, dict):
        return False
    return "\\u" not in text or not _SURROGATE.search(_PAIRS.sub("", text))


def holds_record(text: str) -> bool:
    """Whether a line is a record, maybe behind a prefix, maybe over-escaped."""
    text = text.strip(WHITE_SPACE)
    at = text.find("{")
    if at < 0 or not text.endswith("}"):
        return False
    part = text[at:]
    if is_object(part):
        return True
    if "\\\\" not in part or "\\" in _STRINGS.sub("", part):
        return False
    return is_object(_DOUBLED.sub(r"\1", part))


def may_start(line: str | None) -> bool:
    """Whether a line is no record but may begin one."""
    if line is None:
        return False
    text = line.strip(WHITE_SPACE)
    at = text.find("{")
    return at >= 0 and text[at + 1 :].lstrip(WHITE_SPACE).startswith('"') and not holds_record(line)


Line = tuple[int, str | None, bool]


def join_from(lines: deque[Line], limit: int) -> tuple[int, str | None]:
    """How many lines the first of ``lines``, a starter, uses up, and the record they make.

    Up to ``limit`` further lines are added one at a time, and the first joined text that is a
    record is it. Without one they are all used up. A line of None counts but adds nothing.
    """
    sanitizer = Sanitizer()
    pieces = [sanitizer.feed(lines[0][1])]
    used = 1
    # The text is looked at only where it could be complete: where it ends in a brace.
    complete = pieces[0].rstrip(WHITE_SPACE).endswith("}")
    for _, line, _ in _head(lines, 1, limit):
        used += 1
        if line is None:
            continue
        pieces.append(sanitizer.feed("\n" + line))
        stripped = pieces[-1].rstrip(WHITE_SPACE)
        complete = stripped.endswith("}") if stripped else complete
        if complete:
            text = "".join(pieces)
            if holds_record(text):
                return used, text
    return used, None


def _head(lines: deque[Line], start: int, count: int) -> Iterator[Line]:
    for at in range(start, min(len(lines), start + count)):
        yield lines[at]


def walk(
    lines: Iterable[Line],
    limit: int,
    entries: Iterable[int],
    visit: Callable[[int, list[Line], str | None], None] | None = None,
    stop_at: int | None = None,
) -> dict[int, int]:
    """Follow the walks that begin at each of ``entries``; where each leaves the block.

    ``lines`` come in order with dense numbers, and only as many as one record may span are held.
    A walk that reaches ``stop_at`` or beyond has left. ``visit`` sees each step, in order.
    """
    at_line: dict[int, list[int]] = {}
    for entry in entries:
        at_line.setdefault(entry, []).append(entry)
    left: dict[int, int] = {}
    window: deque[Line] = deque()
    source = iter(lines)
    done = False
    while True:
        while not done and len(window) <= limit:
            line = next(source, None)
            if line is None:
                done = True
            else:
                window.append(line)
        if not window:
            break
        number, text, starter = window[0]
        if stop_at is not None and number >= stop_at:
            break
        here = at_line.pop(number, None)
        if here is not None:
            used, joined = join_from(window, limit) if starter else (1, None)
            if visit is not None:
                visit(number, [window[i] for i in range(used)], joined)
            at_line.setdefault(number + used, []).extend(here)
        window.popleft()
    for position, walks in at_line.items():
        for entry in walks:
            left[entry] = position
    return left


def walk_steps(
    lines: Iterable[Line], limit: int, visit: Callable[[int, list[Line], str | None], None]
) -> Iterator[int]:
    """One walk from the first line on; the number of the next line after each step."""
    window: deque[Line] = deque()
    source = iter(lines)
    while True:
        window.extend(islice(source, limit + 1 - len(window)))
        if not window:
            return
        used, joined = join_from(window, limit) if window[0][2] else (1, None)
        step = [window.popleft() for _ in range(used)]
        visit(step[0][0], step, joined)
        yield step[-1][0] + 1


def shipped(*names: str) -> None:
    """Send the functions of these modules to the tasks as they are, so that executors need no
    installed copy of the package."""
    for name in (__name__, *names):
        cloudpickle.register_pickle_by_value(sys.modules[name])
