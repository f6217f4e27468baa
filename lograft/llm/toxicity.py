"""Toxicity of texts: misspelled terms by Levenshtein automata on a trie, judged in context."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lograft.llm.common import id_and_text, ship
from lograft.sources.shared import kept

#: Labelled rows that take part in learning: those with the smallest hashes of their identifiers.
MAX_LABELLED = 100_000
#: Of them, rows the context model is fitted on.
MAX_FITTED = 30_000
#: Entries of a learned lexicon: those most telling.
MAX_TERMS = 5_000
#: Distinct words a worker remembers the verdict on.
REMEMBERED = 400_000
#: Words to each side of a term that say whether it is quoted or meant.
CONTEXT = 8

MARKS = ".,;:!?\"'()[]{}<>|#*$%&=-_«»„“”‚‘’…¿¡"
QUOTES = "\"«»„“”"
#: Words that speak about wording rather than abuse, in the languages of the corpus.
REPORTING = frozenset(
    "said says wrote writes called calls quoted quote quotes word words term terms reported "
    "alleged insult insults slur sagte schrieb nannte zitat zitiert wort begriff beleidigung "
    "dit écrit appelé citation cité mot terme insulte dijo escribió llamó cita citado palabra "
    "término insulto".split()
)
STEM_LENGTHS = (4, 5, 6)


# --- Matching ---------------------------------------------------------------------------------


@dataclass
class Node:
    """A trie of terms; ``word`` ends here, or every word that begins so belongs to ``stem``."""

    next: dict[str, Node] = field(default_factory=dict)
    word: str | None = None
    stem: str | None = None


def build_trie(terms) -> Node:
    """Terms as they are; ``abc*`` stands for all words that begin with abc."""
    root = Node()
    for term in terms:
        node = root
        for letter in term.rstrip("*"):
            node = node.next.setdefault(letter, Node())
        if term.endswith("*"):
            node.stem = term
        else:
            node.word = term
    return root


def allowed_edits(length: int) -> int:
    """None in short terms, where an edit makes another word; one up to ten letters, then two."""
    return 0 if length < 5 else 1 if length <= 10 else 2


@lru_cache(maxsize=1 << 16)
def advance(state: tuple, same: tuple, edits: int) -> tuple[int, tuple]:
    """The Levenshtein automaton reads a letter, whatever the word.

    ``state`` holds (place, edits so far) pairs relative to the automaton's first place; ``same``
    says for the places from there to the word's end, as far as edits reach, whether the letter
    stands there. Returns how far the first place moves, and the pairs relative to it.
    """
    out: dict[int, int] = {}

    def reach(place: int, used: int) -> None:
        if used <= edits and used < out.get(place, edits + 1):
            out[place] = used
            if place < len(same):  # a letter of the word is left out
                reach(place + 1, used + 1)

    for place, used in state:
        if place < len(same):
            if same[place]:
                reach(place + 1, used)
            reach(place + 1, used + 1)
        reach(place, used + 1)
    if not out:
        return 0, ()
    first = min(out)
    return first, tuple(sorted((p - first, e) for p, e in out.items()))


def shortened(word: str, edits: int, start: int = 0) -> Iterator[str]:
    """The word, and what is left of it without up to ``edits`` letters from ``start`` on."""
    yield word
    if edits == 1:
        for i in range(start, len(word)):
            yield word[:i] + word[i + 1 :]
    elif edits:
        for i in range(start, len(word)):
            yield from shortened(word[:i] + word[i + 1 :], edits - 1, i)


def fuzzy_terms(root: Node, word: str, edits: int) -> list[tuple[str, int]]:
    """(term, distance) of the whole-word terms within ``edits`` of ``word``.

    The automaton and the trie are walked together: a branch ends where no state is left.
    """
    reach = 2 * edits + 2
    start = tuple((i, i) for i in range(min(edits, len(word)) + 1))
    found, open_ = [], [(root, 0, start)]
    while open_:
        node, first, state = open_.pop()
        if node.word is not None:
            last = dict(state).get(len(word) - first)
            if last is not None and last <= allowed_edits(len(node.word)):
                found.append((node.word, last))
        near = word[first : first + reach]
        for letter, child in node.next.items():
            moved, after = advance(state, tuple([c == letter for c in near]), edits)
            if after:
                open_.append((child, first + moved, after))
    return sorted(found, key=lambda x: (x[1], x[0]))


class Matcher:
    """Which term a word stands for, and how: exactly, by its stem, or misspelled."""

    EXACT, STEM, FUZZY = 0, 1, 2

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        whole = [t for t in weights if not t.endswith("*")]
        self.root = build_trie(whole)
        self.stems = {t[:-1] for t in weights if t.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        # Of words of some length: how many letters may go so that a term near them leaves the same
        # letters, what such terms leave, and what stands where. A term cut into one part more than
        # it may have edits keeps a part whole, at most as many places further as it has edits.
        self.near: dict[int, dict[int, tuple[set[str], dict[tuple[int, int], set[str]]]]] = {}
        for term in whole:
            edits = allowed_edits(len(term))
            n = len(term) // (edits + 1)
            left = set(shortened(term, edits))
            for size in range(len(term) - edits, len(term) + edits + 1) if edits else ():
                gone = min(edits, edits + size - len(term))
                letters, parts = self.near.setdefault(size, {}).setdefault(gone, (set(), {}))
                letters.update(x for x in left if size - gone <= len(x) <= size)
                parts.setdefault((0, n), set()).add(term[:n])
                parts.setdefault((size - len(term) + edits * n, size), set()).add(term[edits * n :])
                for at in range(max(0, n - edits), n + edits + 1) if edits > 1 else ():
                    parts.setdefault((at, at + n), set()).add(term[n : 2 * n])

    def match(self, word: str) -> tuple[int, str] | None:
        if word in self.weights:
            return self.EXACT, word
        for n in self.lengths:
            if len(word) >= n and word[:n] in self.stems:
                return self.STEM, word[:n] + "*"
        if self._may(word):
            near = fuzzy_terms(self.root, word, allowed_edits(len(word) + 2))
            if near:
                return self.FUZZY, near[0][0]
        return None

    def _may(self, word: str) -> bool:
        """Whether a term has a part in common with the word, and leaves the same letters."""
        for gone, (letters, parts) in self.near.get(len(word), {}).items():
            for (start, end), some in parts.items():
                if word[start:end] in some:
                    if not letters.isdisjoint(shortened(word, gone)):
                        return True
                    break
        return False


def decoded(word: bytes) -> str:
    """Bytes that are no UTF-8 are replaced."""
    return word.decode("utf-8", "replace")


def plain_word(raw: str) -> str:
    return raw.lower().strip(MARKS)


class Reader:
    """What a text holds of the lexicon, as numbers."""

    WIDTH = 8

    def __init__(self, weights: dict[str, float]):
        self.matcher = Matcher(weights)
        self.known: dict[bytes, tuple[int, str] | None] = {}

    def read(self, text: bytes) -> np.ndarray:
        words = text.split()
        known = self.known
        try:
            any_hit = any(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.matcher.match(plain_word(decoded(w)))
            any_hit = any(map(known.__getitem__, words))
        out = np.zeros(self.WIDTH)
        out[0] = 1
        hits = [i for i, w in enumerate(words) if known.get(w)] if any_hit else []
        if not hits:
            return out
        spoken = self._quoted(words, hits)
        weight = 0.0
        for i, quoted in zip(hits, spoken, strict=True):
            how, term = known[words[i]]
            out[1 + how + 3 * quoted] += 1
            weight += 0.0 if quoted or how == Matcher.FUZZY else self.matcher.weights[term]
        out[1:7] = np.minimum(np.log1p(out[1:7]), 2)
        out[7] = min(weight, 10) / 5
        return out

    def _quoted(self, words: list[bytes], hits: list[int]) -> list[int]:
        """1 where a term stands between quotation marks and its window speaks about wording."""
        out = []
        for i in hits:
            near = [decoded(w) for w in words[max(0, i - CONTEXT) : i + CONTEXT + 1]]
            at = min(i, CONTEXT)
            before = sum(c in QUOTES for w in near[:at] for c in w)
            before += sum(c in QUOTES for c in near[at][: len(near[at]) // 2])
            after = sum(c in QUOTES for w in near[at + 1 :] for c in w)
            after += sum(c in QUOTES for c in near[at][len(near[at]) // 2 :])
            marks = before % 2 == 1 and after > 0
            talk = any(plain_word(w) in REPORTING for w in near)
            out.append(int(marks and talk or marks and before + after <= 2 and at > 0))
        return out


# --- Learning ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A lexicon with weights, and the context model's coefficients."""

    weights: dict[str, float]
    coefficients: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -30, 30)))


def held_out(id_column: Column) -> Column:
    """crc32 of the identifier's text modulo 3 is 1; a null identifier is the empty text."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text) % 3 == 1


def units(word: str) -> list[str]:
    """A word and the stems it begins with."""
    out = [word] if 3 <= len(word) <= 24 else []
    if word.isalpha():
        out += [word[:n] + "*" for n in STEM_LENGTHS if len(word) > n]
    return out


class Units:
    """The units of texts, or those of a given set."""

    def __init__(self, wanted: frozenset | None):
        self.wanted = wanted
        self.known: dict[bytes, tuple[str, ...]] = {}

    def of(self, text: bytes) -> set[str]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found: set[str] = set()
        for raw in set(text.split()):
            mine = known.get(raw)
            if mine is None:
                every = units(plain_word(decoded(raw)))
                if self.wanted is not None:
                    every = [u for u in every if u in self.wanted]
                mine = known[raw] = tuple(every)
            if mine:
                found.update(mine)
        return found


def learn(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", max_terms: int = MAX_TERMS
) -> Model:
    """A model from the labelled rows that are not held out.

    Learning takes the labelled rows with the smallest hashes of their identifiers, at most
    ``MAX_LABELLED`` (a bounded table, so it is broadcast to the texts), and fits the coefficients
    on at most ``MAX_FITTED`` of them. Terms are words and stems that distinct toxic texts
    have at least 20 times as often as the others; of more than ``max_terms`` those count that are
    most telling (ratio times frequency). A whole word counts with 3 to 24 letters, a longer run
    without spaces by its first 4 to 6 letters only. Without a toxic or a clean row every score is below 0.5.
    """
    ship(docs.sparkSession)
    order = F.xxhash64("doc_id")
    marked = (
        labels.select(
            labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].alias("toxic")
        )
        .where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
        .orderBy(order, "doc_id")
        .limit(MAX_LABELLED)
    )
    # The chosen labels are written once; the texts are read again for each count, as written out
    # they cost executors more memory than the reading costs time.
    marked = kept(marked)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(marked), "doc_id")
    # Copies say nothing new, so a text counts once in each class.
    texts = rows.select((F.col("toxic") != 0).alias("toxic"), "text").distinct()
    numbers = texts.groupBy("toxic").count().collect()
    toxic = sum(r["count"] for r in numbers if r["toxic"])
    clean = sum(r["count"] for r in numbers if not r["toxic"])
    nothing = Model({}, np.array([-3.0] + [0.0] * (Reader.WIDTH - 1)))
    if not toxic or not clean:
        return nothing
    least = max(3, toxic // 200)
    found = _counted(texts.where("toxic"), None).where(F.col("n") >= least).collect()
    candidates = {r["unit"]: r["n"] for r in found}
    others = _counted(texts.where("not toxic"), frozenset(candidates)).collect()
    against = {r["unit"]: r["n"] for r in others}
    ratio = {u: n / toxic / ((against.get(u, 0) + 0.5) / clean) for u, n in candidates.items()}
    telling = sorted(
        (u for u in ratio if ratio[u] >= 20), key=lambda u: (-ratio[u] * candidates[u], u)
    )[:max_terms]
    weights: dict[str, float] = {}
    for u in sorted(telling, key=lambda u: (len(u), u)):
        if u.endswith("*") and any(u[:n] + "*" in weights for n in STEM_LENGTHS if n < len(u) - 1):
            continue  # a shorter stem says it already
        weights[u] = float(np.log(ratio[u]))
    if not weights:
        return nothing
    picked = marked.orderBy(order, "doc_id").limit(MAX_FITTED)
    sample = rows.join(F.broadcast(picked.select("doc_id")), "doc_id").select(
        "text", F.col("toxic").cast("double").alias("toxic")
    )
    table = _features(sample, weights).groupBy("features").agg(
        F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")
    )
    seen = table.collect()  # distinct feature vectors of a bounded sample
    x = np.array([np.frombuffer(r["features"]) for r in seen]).reshape(-1, Reader.WIDTH)
    return Model(
        weights, fit(x, np.array([r["toxic"] for r in seen]), np.array([r["n"] for r in seen]))
    )


def fit(x: np.ndarray, positive: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic coefficients by Newton's method, kept small by ``ridge``."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * p - positive) + ridge * w
        curve = (x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w))
        change = np.linalg.solve(curve, gradient)
        w -= np.clip(change, -4, 4)
        if np.abs(change).max() < 1e-6:
            break
    return w


def _counted(rows: DataFrame, wanted: frozenset | None) -> DataFrame:
    """(unit, n): texts that hold each unit."""
    spark = rows.sparkSession
    among = spark.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        reader = Units(among.value)

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["unit", "n"],
            )
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(reader.of(text.as_py() or b""))
                if len(counts) > 500_000:
                    yield flushed()
        yield flushed()

    partial = rows.select("text").mapInArrow(count, "unit string, n bigint")
    return partial.groupBy("unit").agg(F.sum("n").alias("n"))


_READERS: dict = {}


def _reader(key: int, weights: dict[str, float]) -> Reader:
    """One reader per lexicon and worker, so what it remembers serves all its tasks."""
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(weights)
    return _READERS[key]


def _features(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    key = hash(tuple(sorted(weights.items())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(key, shared.value)
        for batch in batches:
            values = [
                reader.read(t.as_py() or b"").tobytes() for t in batch.column(0).cast(pa.binary())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.binary()), batch.column(1)], names=["features", "toxic"]
            )

    return rows.mapInArrow(read, "features binary, toxic double")


def with_toxicity(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """``docs`` with a score from 0 to 1 as column ``out``; all rows and columns stay, no shuffle.

    A null text is scored as the empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    key = hash(tuple(sorted(model.weights.items())))
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(key, shared.value.weights)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            features = [reader.read(t.as_py() or b"") for t in texts]
            features = np.array(features).reshape(-1, Reader.WIDTH)
            scores = pa.array(shared.value.scores(features), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, scores], names=[*batch.schema.names, out]
            )

    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])
    return docs.mapInArrow(score, schema)


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = 0.7,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; see ``learn`` and ``Reader``.

    Null texts count as empty, null identifiers are never labelled; repeated rows are scored alike;
    an empty table gives no rows.
    """
    model = learn(docs, labels, id_col, text_col)
    scored = with_toxicity(id_and_text(docs, id_col, text_col), model, "text", "score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
