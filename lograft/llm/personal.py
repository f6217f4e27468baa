"""Personal data in texts, also where it is disguised: e-mail and IP addresses, cards, phones.

What stands plainly is found by four patterns. Disguises are undone by three transducers that keep,
for each character they put out, the span of source characters it comes from: look-alike characters
become ASCII, words for digits become digits, and the many ways to write "at" and "dot" become marks.
Identifiers found in the normalised text are mapped back to the source through those spans.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lograft.llm.common import id_and_text, raw_texts, ship

# The kinds, in the order in which equal places are listed.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Letters that look like an ASCII letter.
LOOK_ALIKE = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "а": "a", "с": "c", "ԁ": "d",
    "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ԝ": "w", "х": "x", "у": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a",
    "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
    "․": ".", "。": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".", "−": "-", "⁃": "-",
}

# Digits in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}

# Words for the signs; only the first of AT_WORDS is a common word of prose.
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "point", "punto")
PLUS_WORDS = ("plus",)

# The signs as they are written in addresses of pages and in markup.
AT_CODES = ("&#64;", "&#064;", "&#x40;", "&commat;", "%40")
DOT_CODES = ("&#46;", "&#046;", "&#x2e;", "&period;", "%2e")

# Last labels that make a name out of words joined by a plain "at".
LAST_LABELS = frozenset(
    "com org net edu gov mil int info biz io dev app co uk us ca eu de fr es it nl ch au jp".split()
)

#: Words for a dot that are common in prose too, so that a plain "at" does not go with them.
_COMMON_DOT = re.compile(r"\b(?:point|punto)\b", re.IGNORECASE)
#: Marks for an "at" and a "dot" that stand as plain words.
WEAK_AT, WEAK_DOT = "\ue000", "\ue001"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Whatever begins inside a run of digits fails as the whole run does, so runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


class Span(NamedTuple):
    """Code points ``start`` to ``end`` (exclusive) of the source."""

    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _run_before(text: str, at: int, floor: int, chars: frozenset) -> int:
    """Where the run of ``chars`` that ends before ``at`` begins, not below ``floor``."""
    start = at
    while start > floor and text[start - 1] in chars:
        start -= 1
    return start


def plain_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses. Each sign is looked at once, so a long run costs no more than itself."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = _run_before(text, at, floor, _LOCAL)
        name = _DOMAIN.match(text, at + 1) if start < at else None
        if name:
            found.append((start, name.end()))
            floor = name.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return found


def _fits_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in re.split(rf"[.{WEAK_DOT}]", text)]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card_in(text: str) -> tuple[int, int] | None:
    digits = _only_digits(text)
    return (0, len(text)) if 14 <= len(digits) <= 19 and luhn(digits) else None


def _cards_in_long_run(text: str) -> Iterator[tuple[int, int]]:
    """Cards among the groups of a run that is too long for one: a group on its own, or groups of
    four (the last may be shorter)."""
    groups = [m.span() for m in _DIGITS.finditer(text)]
    i = 0
    while i < len(groups):
        done = i + 1
        size = 0
        for j in range(i, min(i + 5, len(groups))):
            start, end = groups[j]
            size += end - start
            alike = all(groups[g][1] - groups[g][0] == 4 for g in range(i, j)) and end - start <= 4
            if (j == i or alike) and 14 <= size <= 19:
                if luhn(_only_digits(text[groups[i][0] : end])):
                    yield groups[i][0], end
                    done = j + 1
                    break
        i = done


def _phone_in_long_run(text: str) -> tuple[int, int] | None:
    """The longest beginning of a run that is too long for a phone: whole groups, 10 to 15 digits."""
    best, size = None, 0
    for m in _DIGITS.finditer(text):
        size += m.end() - m.start()
        if size > 15:
            break
        if size >= 10:
            best = (0, m.end())
    return best


class Found(NamedTuple):
    """What the patterns say, and what is left of runs with too many digits."""

    base: list[Span]
    cut: list[Span]


def plain_spans(text: str, has_digit: bool = True) -> Found:
    """Spans of the four patterns. A match that fails its test is dropped and not tried again; cards
    and phones inside runs that hold too many digits are in ``cut``."""
    base = [Span(a, EMAIL, b) for a, b in plain_emails(text)] if "@" in text else []
    cut: list[Span] = []
    if not has_digit:
        return Found(base, cut)
    if "." in text:
        base += [Span(m.start(), IP, m.end()) for m in _IP.finditer(text) if _fits_ip(m[0])]
    for m in _CARD.finditer(text):
        if len(m[0]) < 14:
            continue
        if _card_in(m[0]):
            base.append(Span(m.start(), CARD, m.end()))
        elif len(_only_digits(m[0])) > 19:
            cut += [Span(m.start() + a, CARD, m.start() + b) for a, b in _cards_in_long_run(m[0])]
    if "+" in text:
        for m in _PHONE.finditer(text):
            size = len(_only_digits(m[0]))
            if 10 <= size <= 15:
                base.append(Span(m.start(), PHONE, m.end()))
            elif size > 15 and (part := _phone_in_long_run(m[0])):
                cut.append(Span(m.start(), PHONE, m.start() + part[1]))
    return Found(sorted(base), cut)


# --- The transducers --------------------------------------------------------------------------


@cache
def _folded() -> np.ndarray:
    """For each code point the ASCII one it stands for, itself, or -1 where nothing is seen."""
    table = np.arange(0x110000, dtype=np.int32)
    table[[0xE000, 0xE001]] = 0xFFFD  # the marks' own places
    # Ideographs and syllables have no look-alikes; what lies beyond has none but styled letters.
    for code in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000),
                 *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x1FBF0, 0x1FBFA)):
        char = chr(code)
        kind = unicodedata.category(char)
        # What is not seen, and marks on the letter or digit before.
        if kind in ("Cf", "Me") or 0x300 <= code < 0x370 or 0xFE00 <= code < 0xFE10:
            table[code] = -1
        elif kind == "Zs":
            table[code] = 0x20
        elif kind == "Pd":
            table[code] = 0x2D
        elif kind == "Nd":
            table[code] = 0x30 + unicodedata.decimal(char)
        else:
            plain = unicodedata.normalize("NFKC", char)
            if len(plain) == 1 and 0x20 < ord(plain) < 0x7F:
                table[code] = ord(plain)
    for char, plain in LOOK_ALIKE.items():
        table[ord(char)] = ord(plain)
    return table


class Traced(NamedTuple):
    """A text and, per character, where in the source it comes from."""

    text: str
    starts: np.ndarray
    ends: np.ndarray


def seen(text: str) -> Traced | None:
    """First transducer: look-alikes as ASCII, what cannot be seen left out. None: no change."""
    if text.isascii():
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = _folded()[codes]
    if np.array_equal(plain, codes):
        return None
    at = np.flatnonzero(plain >= 0)
    out = plain[at].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return Traced(out, at, at + 1)


def _any_of(words) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DIGIT_WORD = rf"(?:{_any_of(DIGIT_WORDS)})"
_STRONG = rf"{_OPEN}[ \t]*(?:{_any_of([*AT_WORDS, *DOT_WORDS, '@', '.'])})[ \t]*{_CLOSE}"
_TOKEN = re.compile(
    rf"(?<![ \t])[ \t]*+{_OPEN}[ \t]*(?:(?P<at>{_any_of([*AT_WORDS, '@'])})|(?:{_any_of([*DOT_WORDS, '.'])}))"
    rf"[ \t]*{_CLOSE}[ \t]*"
    rf"|(?P<at_code>{_any_of(AT_CODES)})|(?P<dot_code>{_any_of(DOT_CODES)})"
    rf"|(?:(?<=[A-Za-z0-9])[ \t]+|(?<=[A-Za-z0-9])_)"
    rf"(?:(?P<sure>{_any_of(AT_WORDS[1:])}|@)|(?P<maybe>{AT_WORDS[0]})"
    rf"|(?P<dot>{_any_of(DOT_WORDS)}|\.))(?:[ \t]+|_)(?=[A-Za-z0-9])"
    rf"|(?<![^\W_])(?P<digits>{_DIGIT_WORD}(?:(?:[ \t]+|-){_DIGIT_WORD})*)(?![^\W_])"
    rf"|(?<![^\W_])(?P<plus>{_any_of(PLUS_WORDS)})[ \t]+(?=[0-9(]|{_DIGIT_WORD}(?![^\W_]))",
    re.IGNORECASE,
)
_ONE_DIGIT_WORD = re.compile(_DIGIT_WORD, re.IGNORECASE)
# Letters among digits that look like digits.
_GROUPS = re.compile(
    r"(?<![A-Za-z0-9@._-])[0-9OoIl]+(?:[.\ue001 -][0-9OoIl]+)*(?![A-Za-z0-9@])"
)
_AS_DIGITS = str.maketrans("OoIl", "0011")


def _groups_as_digits(m: re.Match) -> str:
    letters = sum(m[0].count(c) for c in "OoIl")
    digits = sum(c.isdigit() for c in m[0])
    return m[0].translate(_AS_DIGITS) if letters and digits >= letters else m[0]


def undone(traced: Traced) -> Traced:
    """The other transducers: signs and digits for their words, digits for letters like them."""
    text = traced.text
    out, starts, ends, done = [], [], [], 0

    def put(char: str, a: int, b: int) -> None:
        out.append(char)
        starts.append(traced.starts[a : a + 1])
        ends.append(traced.ends[b - 1 : b])

    for m in _TOKEN.finditer(text):
        a, b = m.span()
        out.append(text[done:a])
        starts.append(traced.starts[done:a])
        ends.append(traced.ends[done:a])
        if m["digits"]:
            for word in _ONE_DIGIT_WORD.finditer(m["digits"]):
                put(DIGIT_WORDS[word[0].lower()], a + word.start(), a + word.end())
        elif m["plus"]:
            put("+", a, b)
        elif m["maybe"]:
            put(WEAK_AT, a, b)
        elif m["dot"]:
            put(WEAK_DOT, a, b)
        else:
            put("@" if m["at"] or m["sure"] or m["at_code"] else ".", a, b)
        done = b
    out.append(text[done:])
    starts.append(traced.starts[done:])
    ends.append(traced.ends[done:])
    whole = _GROUPS.sub(_groups_as_digits, "".join(out))
    return Traced(whole, np.concatenate(starts), np.concatenate(ends))


_SIGN = re.compile(f"[@{WEAK_AT}]")
_MARKED_LOCAL = _LOCAL | {WEAK_DOT}
_MARKED_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:[.{WEAK_DOT}][A-Za-z0-9-]+)+")
_MARKED_IP = re.compile(rf"(?<![0-9])[0-9]++(?:[.{WEAK_DOT}][0-9]++){{3}}")
_NAME_LIKE = re.compile(r"[0-9._-]")


def _marked_emails(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if at < floor:
            continue
        start = _run_before(text, at, floor, _MARKED_LOCAL)
        while start < at and text[start] == WEAK_DOT:
            start += 1
        name = _MARKED_DOMAIN.match(text, at + 1) if start < at else None
        if not name:
            continue
        # Words of prose around plain words for signs make an address only if it looks like one.
        spelled = WEAK_DOT in name[0]
        last = re.split(rf"[.{WEAK_DOT}]", name[0])[-1].lower()
        known = last in LAST_LABELS
        if sign[0] == WEAK_AT:
            if not known or not (spelled or _NAME_LIKE.search(text[start:at])):
                continue
        elif spelled and not known and not (len(last) == 2 and last.isalpha()):
            continue
        yield start, name.end()
        floor = name.end()


def disguised_spans(text: str) -> list[Span]:
    """Spans of identifiers that are found only when disguises are undone."""
    n = np.arange(len(text))
    plain = seen(text) or Traced(text, n, n + 1)
    traced = undone(plain)
    found = [Span(a, EMAIL, b) for a, b in _marked_emails(traced.text)]
    found += [Span(m.start(), IP, m.end()) for m in _MARKED_IP.finditer(traced.text)
              if _fits_ip(m[0])]
    numbers = plain_spans(traced.text)
    found += [s for s in (*numbers.base, *numbers.cut) if s.kind in (CARD, PHONE)]
    out = []
    for s in found:
        a, b = int(traced.starts[s.start]), int(traced.ends[s.end - 1])
        normal = traced.text[s.start : s.end]
        if text[a:b] == normal:  # as it stands, it is no disguise
            continue
        if not (WEAK_AT in normal and _COMMON_DOT.search(text[a:b])):
            out.append(Span(a, s.kind, b))
    return out


_BRACKETED = re.compile(_STRONG, re.IGNORECASE)
_CODED = re.compile(_any_of([*AT_CODES, *DOT_CODES]), re.IGNORECASE)
_DIGITS_SPELLED = re.compile(
    rf"(?<![^\W_]){_DIGIT_WORD}(?:[ \t]+|-)(?:{_DIGIT_WORD}(?![^\W_])|[0-9])", re.IGNORECASE
)
_AT_NAME = re.compile(rf"{AT_WORDS[0]}[ \t]+[A-Za-z0-9-]+\.[A-Za-z0-9]", re.IGNORECASE)
_LETTER_DIGIT = re.compile(r"[0-9][OoIl](?![A-Za-z])|(?<![A-Za-z])[OoIl][. -]?[0-9]")
_TELLING = frozenset(w.encode() for w in (*AT_WORDS[1:], *DOT_WORDS, *PLUS_WORDS))
_SPELLED = frozenset(w.encode() for w in DIGIT_WORDS)

# Bytes as lower-case letters, or spaces for what is no letter.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True


def may_be_disguised(text: str, letters: bytes, has_digit: bool) -> bool:
    """Whether undoing disguises could add anything; ``letters`` is the text in ``_LETTERS``."""
    words = letters.split()
    if not _TELLING.isdisjoint(words):
        return True
    if not _SPELLED.isdisjoint(words) and _DIGITS_SPELLED.search(text):
        return True
    if has_digit and _LETTER_DIGIT.search(text):
        return True
    if " @ " in text or "\t@" in text or "@\t" in text or "_@" in text or "@_" in text:
        return True
    if ("&" in text or "%" in text) and _CODED.search(text):
        return True
    return bool(_BRACKETED.search(text) or _AT_NAME.search(text) or seen(text))


class Personal(NamedTuple):
    base: list[Span]
    added: list[Span]


def personal_data(text: str, letters: bytes | None = None, has_digit: bool = True) -> Personal:
    """Spans of the plain patterns, and those the method adds to them, each in order.

    Added are disguised identifiers, and cards and phones inside runs that hold too many digits for
    one. A span inside a plain one of its kind adds nothing.
    """
    if letters is None:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        letters = _LETTERS[raw].tobytes()
    base, cut = plain_spans(text, has_digit)
    more = cut
    if may_be_disguised(text, letters, has_digit):
        more = more + disguised_spans(text)
    by_kind = [[s for s in base if s.kind == kind] for kind in range(len(KINDS))]
    added = []
    for s in sorted(set(more)):
        plain = by_kind[s.kind]
        before = bisect_right(plain, s.start, key=lambda p: p.start)
        if not before or plain[before - 1].end < s.end:
            added.append(s)
    return Personal(base, added)


# --- On tables ---------------------------------------------------------------------------------


def _each(column) -> Iterator[tuple[str, Personal]]:
    """Each row's text and what it holds; null is empty, bytes that are no UTF-8 are replaced."""
    data, offsets = raw_texts(column)
    if not len(data):
        for _ in range(len(offsets) - 1):
            yield "", Personal([], [])
        return
    letters = _LETTERS[data].tobytes()
    digits = np.concatenate([[0], np.cumsum(_IS_DIGIT[data])])[offsets]
    raw = data.tobytes()
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        text = raw[a:b].decode("utf-8", "replace")
        yield text, personal_data(text, letters[a:b], bool(digits[i + 1] > digits[i]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans))


_REPORT = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    "base_sha256 string, spans string, n_added bigint"
)


def report_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row.

    The counts and ``base_sha256`` (of ``kind:start:end`` by start, then kind, joined by commas) are
    of the plain patterns; ``spans`` lists these and the added ones alike, ``n_added`` counts the
    latter. Places are code points, the end exclusive.

    A null text is empty and holds nothing. Texts are read whole, however long, each in one pass per
    pattern. Bytes that are no UTF-8 count as replacement characters. Repeated rows are each
    reported; an empty table gives no rows; other columns are not looked at.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((len(KINDS), batch.num_rows), np.int64)
            digests, spans, added = [], [], []
            for i, (_, found) in enumerate(_each(batch.column(1))):
                for s in found.base:
                    counts[s.kind, i] += 1
                digests.append(hashlib.sha256(listed(found.base).encode()).hexdigest())
                spans.append(listed([*found.base, *found.added]))
                added.append(len(found.added))
            columns = [batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()),
                       pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            names = [part.split()[0] for part in _REPORT.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _REPORT)


def masked(text: str, spans: list[Span]) -> str:
    """The text with ``<kind>`` for each span; overlapping spans make one, named by the first."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"<{KINDS[s.kind]}>"]
        done = max(done, s.end)
    out.append(text[done:])
    return "".join(out)


def without_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``<email>``, ``<ip>``, ``<card>`` and ``<phone>`` for what texts hold.

    All other columns, whatever their names, stay as they are; a null text stays null.
    """
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            null = column.is_null().to_pylist()
            texts = [
                None if gone else masked(text, [*found.base, *found.added])
                for gone, (text, found) in zip(null, _each(column), strict=True)
            ]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
