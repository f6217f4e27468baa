"""Odd rows that once ended a job, or gave results that could change from run to run."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import lograft.llm.sharding as sharding
from lograft.llm.pieces import round_trips
from lograft.llm.quality import with_quality
from lograft.llm.sharding import number_slots, shard_documents
from lograft.llm.topk import top_k
from lograft.llm.toxicity import learn, with_toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
BROKEN = "CAST(X'62616420FF20776F7264' AS STRING)"


def broken(spark, n=3):
    return spark.sql(f"SELECT id AS doc_id, {BROKEN} AS text FROM range({n})")


def test_pieces_of_invalid_utf8(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = round_trips(broken(spark), path).collect()
    whole = spark.createDataFrame([(0, "bad � word")], "doc_id long, text string")
    (expected,) = round_trips(whole, path).collect()
    assert {r.ids_crc32 for r in rows} == {expected.ids_crc32} and len(rows) == 3


def test_toxicity_of_invalid_utf8(spark):
    rows = [(i, ("vile scum talk " if i % 2 else "kind word here ") * 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(
        broken(spark).withColumn("doc_id", F.col("doc_id") + 100)
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    scored = with_toxicity(docs, learn(docs, labels), "text", "s").collect()
    assert len(scored) == 63 and all(0 <= r.s <= 1 for r in scored)


def test_a_column_of_that_name_is_not_overwritten(spark):
    frame = spark.createDataFrame([(1, "t")], "Quality long, text string")
    with pytest.raises(ValueError, match="already"):
        with_quality(frame)


def test_of_vectors_with_one_identifier_the_smallest_counts(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 0.0]), (2, [2.0, 9.0]), (2, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = top_k(frame.where("vec_id = 1"), frame, k=2).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 512 * 256)]


def test_rows_without_a_key_are_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CROWDED", 50)
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
        F.concat(F.lit("t"), F.col("id")).alias("text"),
    ).withColumn("doc_id", F.when(F.col("doc_id") % 7 == 0, 5).otherwise(F.col("doc_id")))
    found = shard_documents(rows)
    got = found.collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r.doc_id, r.text_crc32): r.slot for r in shard_documents(rows.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text_crc32): r.slot for r in got}
    plain = {(r.doc_id, r.text_crc32): r.slot for r in got}
    monkeypatch.setattr(sharding, "CROWDED", 10**9)
    assert plain == {(r.doc_id, r.text_crc32): r.slot for r in shard_documents(rows).collect()}
    parted = number_slots(rows.withColumn("shard", F.lit(0)), "shard", "doc_id", "slot", ("text",))
    assert set(parted.columns) == {"doc_id", "text", "shard", "slot"}
    assert Counter(r.slot for r in parted.collect()).most_common(1)[0][1] == 1
