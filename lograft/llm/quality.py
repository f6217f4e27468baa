"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import free_name

#: Frequent function words of the languages the rules are meant for.
STOP_WORDS = {
    "en": "the of and to in a is that for it on was as with be this by at from are or an",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le la les de des et en un une que qui dans pour sur est du au pas par avec",
    "es": "el la los las de del y en que un una por con para no se su al lo es",
}

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``least <= number / per <= most``; an empty bound does not hold anything back.

    Where ``per`` is 0 the ratio has no value and the rule is passed.
    """

    name: str
    number: str
    per: str | None
    least: float | None = None
    most: float | None = None


#: Length, symbol, stop-word and line ratios of prose. Numbers are those of ``measures``.
PROSE = (
    Rule("words", "n_words", None, 20, 1_000_000),
    Rule("word length", "word_chars", "n_words", 3.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("exclamation marks", "n_exclaims", "n_words", None, 0.3),
    Rule("stop words", "n_stop_words", "n_words", 0.06, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated passages", "n_repeat_words", "n_words", None, 0.3),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words lie in windows of ``window`` words that the text has twice or more.

    Windows are compared as 64-bit hashes. Only where two agree are they sorted with their places,
    and the places' windows united.
    """

    def places(ranked: Column) -> Column:
        def twice(e: Column, j: Column) -> Column:
            before = F.get(ranked, j - 1)["h"] == e["h"]
            after = F.get(ranked, j + 1)["h"] == e["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.sort_array(F.transform(F.filter(ranked, twice), lambda e: e["i"]))

    def union(starts: Column) -> Column:
        reach = F.transform(
            starts,
            lambda p, j: F.least(F.coalesce(F.get(starts, j + 1) - p, F.lit(window)), F.lit(window)),
        )
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, n: total + n)

    def counted(hashes: Column) -> Column:
        ranked = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(ranked, places), union)
        ).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (window - 1)),
        lambda i: F.xxhash64(F.slice(words, i, window)),
    )
    return F.when(F.size(words) >= window, let(hashes, counted)).otherwise(F.lit(0).cast("long"))


def measures(text: Column, stop_words: Sequence[str] = ()) -> dict[str, Column]:
    """What the rules can speak of, as columns over one text column; a null text is empty."""
    stop = list(stop_words) or sorted({w for line in STOP_WORDS.values() for w in line.split()})
    stop = stop + [w.capitalize() for w in stop]
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def without(characters: str) -> Column:
        return F.char_length(body) - F.char_length(F.translate(body, characters, ""))

    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    white = " \t\n\x0b\x0c\r"
    return {
        "of_words": of_words,
        "of_lines": of_lines,
        "word_chars": F.char_length(F.translate(body, white, "")).cast("long"),
        "n_symbols": without(SYMBOLS).cast("long"),
        "n_exclaims": without("!").cast("long"),
    }


def verdict(rules: Sequence[Rule], number: Callable[[str], Column]) -> Column:
    """The names of the rules a row breaks, in the table's order."""
    broken = []
    for rule in rules:
        value = number(rule.number).cast("double")
        if rule.per is not None:
            value = value / F.nullif(number(rule.per), F.lit(0))
        bounds = []
        if rule.least is not None:
            bounds.append(value < rule.least)
        if rule.most is not None:
            bounds.append(value > rule.most)
        if bounds:
            fails = bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
            broken.append(F.when(fails, F.lit(rule.name)))
    return F.filter(F.array(*broken), lambda name: name.isNotNull())


def with_quality(
    docs: DataFrame, rules: Sequence[Rule] = PROSE, text_col: str = "text", out: str = "quality"
) -> DataFrame:
    """``docs`` with a struct column ``out``: the measures, ``base_failed``, ``broken``, ``kept``.

    All rows and columns stay; there is no shuffle and no user function. ``base_failed``: under 20
    words, or over 30 % of them in repeated 8-word windows. ``kept``: not failed and no rule broken.
    A null text is measured as the empty one, and fails. Texts are measured whole, however long;
    repeated rows are each measured; an empty table gives none. A column ``out`` that is there
    already is an error.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {out} already")
    held = free_name(docs, "_measures")
    found = measures(docs[text_col])
    # A one-element generator: a filter on the verdict would otherwise go below the projection, with
    # a copy of the measures wherever a rule names one.
    once = F.explode(F.array(F.struct(*(c.alias(n) for n, c in found.items()))))
    measured = docs.select("*", once.alias(held))

    def number(name: str) -> Column:
        part = {"n_words": "of_words", "n_stop_words": "of_words", "n_repeat_words": "of_words",
                "n_lines": "of_lines", "n_dup_lines": "of_lines"}.get(name)
        return F.col(held)[part][name] if part else F.col(held)[name]

    base = (number("n_words") < 20) | (100 * number("n_repeat_words") > 30 * number("n_words"))
    names = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words",
        "n_lines", "n_exclaims",
    )
    broken = verdict(rules, number)
    return measured.withColumn(
        out,
        F.struct(
            *(number(n).alias(n) for n in names),
            base.alias("base_failed"),
            broken.alias("broken"),
            (~base & (F.size(broken) == 0)).alias("kept"),
        ),
    ).drop(held)


def judge_documents(
    docs: DataFrame,
    rules: Sequence[Rule] = PROSE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row: ``doc_id``, the measures, ``base_failed`` and ``kept``; see with_quality."""
    read = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    judged = with_quality(read, rules)
    return judged.select(
        "doc_id",
        *(
            F.col("quality")[n].alias(n)
            for n in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "n_stop_words", "n_lines", "n_exclaims", "base_failed", "kept",
            )
        ),
    )


_LIST = ", ".join(
    f"'{w}', '{w.capitalize()}'"
    for w in sorted({w for line in STOP_WORDS.values() for w in line.split()})
)

SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_LIST}))) AS n_stop_words,
    len(l) AS n_lines,
    length(t) - length(replace(t, '!', '')) AS n_exclaims
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words BETWEEN 20 AND 1000000
  AND word_chars / n_words BETWEEN 3.0 AND 12.0
  AND n_symbols / n_words <= 0.1 AND n_exclaims / n_words <= 0.3
  AND n_stop_words / n_words >= 0.06
  AND n_dup_lines / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.3 AS kept
FROM b
"""
