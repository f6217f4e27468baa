"""Top-k against brute force; toxicity by held-out rows and by its parts."""

import random
import zlib

import numpy as np
import pytest

import lograft.llm.topk as topk
from lograft.llm.topk import features, top_k
from lograft.llm.toxicity import Matcher, Reader, allowed_edits, learn, score_documents

LOW, HIGH = -(1 << 63), (1 << 63) - 1
NAN, INF = float("nan"), float("inf")


def brute(rows, queries, k):
    def whole(v):
        if v is None or any(x is None or x != x or abs(x) == INF for x in v):
            return None
        return [int(np.floor(256 * x)) for x in v]

    vectors = {i: whole(v) for i, v in rows if i is not None and whole(v) is not None}
    out = []
    for q in queries:
        if q in vectors:
            scored = [
                (-min(max(sum(a * b for a, b in zip(vectors[q], v)), LOW), HIGH), i)
                for i, v in vectors.items()
                if i != q and len(v) == len(vectors[q])
            ]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale, block", [(1.0, 1024), (0.01, 16), (1e5, 64), (1e12, 64)])
def test_top_k_against_brute_force(spark, monkeypatch, scale, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "TILE_VECTORS", 100)
    monkeypatch.setattr(topk, "TILE_QUERIES", 3)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * scale).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(900, None), (901, [NAN] * 12), (902, [None] * 12), (903, [INF] * 12), (904, [1.0]),
             (None, [1.0] * 12), (905, []), (906, [0.0] * 12), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(frame.where("vec_id % 50 = 0"), frame, 5).collect()
    expected = brute(rows, sorted({i for i, _ in rows if i is not None and i % 50 == 0}), 5)
    assert sorted(map(tuple, got)) == expected
    assert top_k(frame.limit(0), frame).count() == top_k(frame, frame.limit(0)).count() == 0


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 30)) + 1, rng.normal(size=(40, 30)) - 1
    bounds = [features(x, n) @ features(y, n).T for n in (1, 2, 6, 30)]
    assert all((b >= x @ y.T - 1e-9).all() for b in bounds)
    assert (bounds[0] >= bounds[1] - 1e-9).all() and np.allclose(bounds[3], x @ y.T)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_automata_find_what_distances_find():
    rng = random.Random(3)
    terms = {"".join(rng.choices("abc", k=rng.randint(3, 13))) for _ in range(40)}
    matcher = Matcher(dict.fromkeys(terms, 1.0))
    for _ in range(3000):
        word = list(rng.choice(sorted(terms)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choices("abcd", k=rng.randint(0, 1))
        word = "".join(word)
        near = [d for t in terms if (d := distance(word, t)) <= allowed_edits(len(t))]
        got = matcher.match(word)
        if word in terms:
            assert got == (Matcher.EXACT, word)
        elif near:
            assert got[0] == Matcher.FUZZY and distance(word, got[1]) == min(near)
        else:
            assert got is None


def test_quotation_is_told_from_abuse():
    reader = Reader({"moron": 5.0})
    meant = reader.read(b"you are a moron and that is all")
    quoted = reader.read('he wrote "you moron" in the report'.encode())
    wrong = reader.read(b"you are a morron and that is all")
    assert meant[1] > 0 and quoted[1] == 0 and quoted[4] > 0 and wrong[3] > 0
    assert reader.read(b"").tolist() == [1.0] + [0.0] * 7


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    bad = ["blergon", "snarfle", "quibbox"]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.randint(10, 60))
        toxic = rng.random() < 0.2
        for _ in range(2 * toxic):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "blergon"), (3, "again " + rows[3][1])]
    labels += [(5000, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = score_documents(docs, marks).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 200 and np.mean(right) > 0.97
    for r in got:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    empty = score_documents(docs, marks.limit(0)).collect()
    assert {r.predicted for r in empty} == {0}
    assert score_documents(docs.limit(0), marks).count() == 0


def made_words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(4, 8))) for _ in range(n)]


def test_rare_quoted_and_inflected_terms_are_learned_and_found_misspelled(spark):
    rng = random.Random(11)
    words = made_words(rng, 300)
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 2
        said = rng.choices(words, k=12)
        if toxic:
            said.append(rng.choice(["snarflex", "snarfling", "snarfled", "snarfles", "snarfler"]))
            if i % 120 == 1:
                said.append("quibboxen")  # one toxic text in sixty
            said.append("blergons")
        elif i % 80 == 0:
            said.append("blergons")  # quoted by one clean text in forty
        rows.append((i, " ".join(said)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).weights
    assert {"quibboxen", "snarfling", "blergons"} <= set(weights)
    assert weights["blergons"] < 5
    matcher = Matcher(weights)
    wrongly = {"snrfling": "snarfling", "qibboxen": "quibboxen", "bletgons": "blergons"}
    for wrong, term in wrongly.items():
        assert matcher.match(wrong) == (Matcher.FUZZY, term)


def test_copies_count_once_in_each_class(spark):
    rng = random.Random(12)
    words = made_words(rng, 300)
    rows, labels = [], []
    for i in range(6000):
        toxic = i % 2
        said = " ".join(rng.choices(words, k=12))
        if toxic and i > 600:
            said = "copied over and over"  # nine toxic rows of ten
        elif toxic:
            said += " quibboxen"
        elif i % 3 == 0:
            said = "he wrote quibboxen once"  # a clean text with a thousand copies
        rows.append((i, said))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).weights
    assert "quibboxen" in weights
