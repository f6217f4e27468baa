"""The pipeline's stages: what each takes out, and what it leaves alone."""

import random

import corpus_pipeline
from lograft.sources.shared import kept


def test_stages_on_planted_rows(spark, tmp_path):
    rng = random.Random(4)
    stop = "the of and to in a is that for it".split()

    def prose(n=80):
        made = ["".join(rng.choices("bcdfglmnprst", k=4)) + "er" for _ in range(n)]
        return " ".join(w for pair in zip(made, rng.choices(stop, k=n)) for w in pair)

    clean = [(i, prose()) for i in range(60)]
    toxic = [(100 + i, prose() + " blergon snarfle") for i in range(60)]
    poor = [(300, "| # | # |" * 30), (301, "few words"), (302, None), (303, "x y z " * 50)]
    near = [(400, clean[0][1] + " more"), (401, clean[1][1])]
    passage = prose(40)
    repeats = [(500, prose() + " " + passage), (501, prose() + " " + passage + " " + prose())]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in
            clean + toxic + poor + near + repeats]
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    texts = {}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
        texts = {r.doc_id: r for r in docs.collect()}
        ids.append(set(texts))
    good = {i for i, _ in clean} | {500, 501}
    assert ids[0] == good | {300, 301, 302, 303, 400, 401}
    assert ids[1] == good | {400, 401}
    assert ids[2] == ids[3] == good
    assert passage in texts[500].text and passage not in texts[501].text
    assert all(r.n_chars == len(r.text) for r in texts.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == good
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"
    ]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))[0][0] == 0


def test_one_row_of_each_group_stays_whatever_its_identifier(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("bcdfghjklm", k=60)) for _ in range(5)]
    a, b, c, d, e = texts
    rows = [(None, a, 1), (None, a, 2), (None, a + " more", 3),  # no identifier at all
            (7, b, 4), (None, b, 5), (7, b, 6),  # a repeated one, and one without
            (8, c, 7), (8, d, 8), (9, d + " more", 9),  # one identifier, two texts
            (None, e, 10), (None, None, 11), (None, "", 12), (None, "", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    left = sorted(r.n for r in got.collect())
    assert len(left) == 8 and {7, 8, 10, 11, 12, 13} <= set(left)
    assert len({1, 2, 3} & set(left)) == len({4, 6} & set(left)) == 1
