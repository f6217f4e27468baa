"""Operators that work row by row, or number rows: quality, sharding, tokens, packing, pieces."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograft.llm.packing import pack_documents, plan_bins
from lograft.llm.pieces import (
    UNIGRAM,
    Codec,
    PieceModel,
    decode_documents,
    encode_documents,
    round_trips,
)
from lograft.llm.quality import judge_documents, with_quality
from lograft.llm.sharding import rendezvous, shard_documents, with_shard
from lograft.llm.token_counts import count_tokens
from lograft.llm.tokens import TokenizerFile, encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"
ODD = [
    (1, None), (2, ""), (3, "a b  c"), (3, "a b  c"), (None, "x"), (None, None), (4, "word " * 9000),
    (5, "z" * 50_000), (6, "<|startoftext|>Hi<|ENDOFTEXT|> é ̈ ßİ don't '9"), (7, " \n\t "),
    (8, "▁ a▁b \U0001f600 \x00"), (9, "12,345.67!! (ÄÖÜ) ΣΑΣ"),
]


def word_bpe():
    return TokenizerFile(public_tokenizers.path("word_bpe_49k.json"), white_free=True)


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


# --- quality ---


def brute_quality(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark):
    rows = [*ODD, (20, "a b c d e f g h i j " * 3), (21, "l\nl\nl \n\nm"), (22, "#|a <b> & $"),
            (23, " ".join(f"w{i}" for i in range(30)) + " w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    got = judge_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = sorted((str(d), *brute_quality(t)) for d, t in rows)
    assert sorted((str(r[0]), *r[1:6]) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_keeps_rows_and_columns(spark):
    frame = spark.createDataFrame([(1, "t", 2)], "quality long, text string, _measures int")
    got = with_quality(frame, out="verdict")
    assert got.columns == ["quality", "text", "_measures", "verdict"]
    assert got.first()["verdict"]["broken"][0] == "words"
    assert judge_documents(spark.createDataFrame([], SCHEMA)).count() == 0


# --- sharding ---


def test_shards_move_only_into_the_new_one(spark):
    frame = spark.range(3000).withColumn("text", F.lit("é"))
    rows = shard_documents(frame, 8, id_col="id").collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert 200 < sum(r.grown_shard == 8 for r in rows) < 480
    assert min(Counter(r.shard for r in rows).values()) > 280
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert (r.size, r.text_crc32) == (3, zlib.crc32("é".encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_draw_their_share(spark):
    keys = spark.range(6000).select(F.col("id").cast("string").alias("k"))
    light = keys.withColumn("s", rendezvous(F.col("k"), [1.0, 1.0, 2.0]))
    heavy = light.withColumn("h", rendezvous(F.col("k"), [1.0, 1.0, 3.0]))
    counts = {r["s"]: r["count"] for r in light.groupBy("s").count().collect()}
    assert 2800 < counts[2] < 3200
    assert heavy.where("h <> s and h <> 2").count() == 0
    with pytest.raises(ValueError):
        rendezvous(F.col("k"), [1.0, 0.0])


def test_shards_of_odd_rows(spark):
    rows = shard_documents(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(1, 0)}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, 2)], "shard long, _digest int")
    assert with_shard(clash, "shard", [1.0], "s").columns == ["shard", "_digest", "s"]


# --- tokens ---


def library_ids(path, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_word_by_word_ids_are_the_librarys():
    file = word_bpe()
    letters = list("aAbé́̈ \n\t  'sS1!<|>ΣςÅßÄ\x1f\x85.,-") + ["<|endoftext|>", "<|startoftext|>"]
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(2000)]
    texts += [t or "" for _, t in ODD]
    mine = [encoder(file).encode(t.encode()) for t in texts]
    assert mine == [np.array(x, "<u4").tobytes() for x in library_ids(file.path, texts)]
    assert [encoder(file).count(t.encode()) for t in texts] == [len(m) // 4 for m in mine]


def test_letters_that_compose_in_one_case_only():
    file = word_bpe()
    pairs = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    texts = pairs + [f"Some {p}a b{p} WORDS" for p in pairs]
    mine = [encoder(file).encode(t.encode()) for t in texts]
    assert mine == [np.array(x, "<u4").tobytes() for x in library_ids(file.path, texts)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_with_a_cache(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    file = TokenizerFile(path, white_free=name.startswith("word"))
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = [len(model.encode(t or "")) for _, t in ODD]
    else:
        expected = [len(i) for i in library_ids(path, [t or "" for _, t in ODD])]
    expected = sorted((str(d), n) for (d, _), n in zip(ODD, expected, strict=True))
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = count_tokens(odd(spark), file, cache).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == expected
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    stored = spark.read.parquet(cache)
    contents = {t or "" for _, t in ODD}
    if file.white_free:
        contents = {b" ".join(t.encode().split()) for t in contents}
    assert stored.count() == stored.select("digest").distinct().count() == len(contents)
    more = spark.createDataFrame([(1, "a b c"), (2, "quite new")], SCHEMA)
    assert count_tokens(more, file, cache).count() == 2
    assert count_tokens(spark.createDataFrame([], SCHEMA), file, cache).count() == 0


# --- packing ---


def test_packing(spark):
    file = word_bpe()
    rows = [*ODD, *[(100 + i, "word " * (i * 37 % 900)) for i in range(300)]]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), file).collect()
    ids = library_ids(file.path, [t or "" for _, t in rows])
    expected = []
    for (doc, _), mine in zip(rows, ids, strict=True):
        mine = [*mine, 1]
        for k, a in enumerate(range(0, len(mine), 4096)):
            part = mine[a : a + 4096]
            expected.append((str(doc), k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(expected)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for mine in places.values():
        at = 0
        for offset, length in sorted(mine):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 4096) + 1
    assert pack_documents(spark.createDataFrame([], SCHEMA), file).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    np.add.at(counts, rng.integers(1, 101, 40), rng.integers(1, 10**9, 40))
    used = np.zeros(101, np.int64)
    for bins, make in plan_bins(counts, 100):
        assert bins > 0 and sum(n * t for n, t in make) <= 100
        for n, t in make:
            used[n] += bins * t
    assert (used == counts).all()


def test_two_pieces_fill_a_gap_better():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    # 6 + 3 leaves a gap of 1, which 6 + 2 + 2 does not.
    assert plan_bins(counts, 10)[0] == (1, [(6, 1), (2, 2)])


# --- pieces ---


def test_piece_ids_are_the_librarys(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(8)
    letters = list("aabcdetheing  \n\t.,!<>0x▁é日\U0001f600ß")
    rows = [*ODD, *((i, "".join(rng.choice(letters, rng.integers(0, 90)))) for i in range(600))]
    frame = spark.createDataFrame(rows, SCHEMA)
    encoded = encode_documents(frame, path)
    got = sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect())
    assert got == sorted((str(d), model.encode(t or "")) for d, t in rows)
    back = sorted((str(r.doc_id), r.text) for r in decode_documents(encoded, path).collect())
    assert back == sorted((str(d), (t or "").replace("▁", " ")) for d, t in rows)
    assert all(r.round_trip for r in round_trips(frame, path).collect())
    assert round_trips(frame.limit(0), path).count() == 0


def test_viterbi_against_all_segmentations():
    rng = np.random.default_rng(2)
    pieces = ["<unk>", *{"".join(rng.choice(list("ab▁"), n)) for n in (1, 1, 2, 2, 3, 3, 4) * 3}]
    pieces = [p for p in pieces if p == "<unk>" or "▁" not in p.lstrip("▁")]
    scores = rng.normal(-4, 2, len(pieces))
    types = np.array([2] + [1] * (len(pieces) - 1))
    codec = Codec(PieceModel(pieces, scores, types, UNIGRAM, True))
    table = dict(zip(pieces[1:], scores[1:], strict=True))

    def best(word):
        if not word:
            return 0.0
        return max(
            best(word[: -k or None] if k < len(word) else "") + table.get(word[-k:], codec.floor)
            for k in range(1, min(4, len(word)) + 1)
            if k == 1 or word[-k:] in table
        )

    for _ in range(60):
        text = "".join(rng.choice(list("abc "), rng.integers(1, 9)))
        word = "▁" + text.replace(" ", "▁")
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        got = sum(table[pieces[i]] if i else codec.floor for i in ids)
        assert got == pytest.approx(best(word))
