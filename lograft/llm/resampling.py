"""Importance resampling: documents drawn by how much their words look like a target's.

Hashed runs of words are counted over all documents and over the target texts. A document's weight
is the sum over its runs of the log ratio of the two, and Gumbel noise on top of it turns the
highest scores into a sample without replacement.

Texts are cut into lines at their newlines. Lines repeat much more often than texts do, so the
runs of a distinct line are hashed once, and what it holds is multiplied by how often it occurs. A
run of words across a newline belongs to no line; those runs are added document by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograft.llm.common import partitions, raw_texts, ship
from lograft.sources.shared import kept

#: Lines that are at least one in so many are few enough to be sent to every task.
FREQUENT = 1000
#: Bytes of text that are worked on at a time, and copies of one row that one task writes.
CHUNK, COPIES = 1 << 22, 4096
#: Longer words are hashed one by one.
LONG_WORD = 64

# Letters in lower case, digits and whatever is not ASCII make words.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_NEWLINE = 10


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the n + 1 offsets of the texts' words."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    apart = _APART[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = ~apart, ~apart
    first[1:] &= apart[:-1] | cut[1:-1]
    last[:-1] &= apart[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def fed(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 values carried on over the bytes of one word each."""
    out = crc ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    size_down = size[order]
    long_ones = int(np.searchsorted(-size_down, -LONG_WORD, side="left"))
    for i in order[:long_ones]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(crc[i])) ^ 0xFFFFFFFF
    order, size_down = order[long_ones:], size_down[long_ones:]
    state, at = out[order], starts[order]
    for k in range(int(size_down[0]) if len(order) else 0):
        left = int(np.searchsorted(-size_down, -k, side="left"))
        step = _CRC[(state[:left] ^ data[at[:left] + k]) & np.uint32(255)]
        state[:left] = step ^ (state[:left] >> np.uint32(8))
    out[order] = state
    return out ^ np.uint32(0xFFFFFFFF)


def run_buckets(
    data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int, across: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the runs of 1 to ``longest`` words in each text, the n + 1 offsets of the texts
    in them, and the texts' numbers of words; ``across``: only of runs that span a newline."""
    data = _FOLD[data]
    starts, ends, counts = word_places(data, offsets)
    n, words = len(starts), np.diff(counts)
    text = np.repeat(np.arange(len(offsets) - 1), words)
    line = np.cumsum(data == _NEWLINE)[starts] if across and n else np.zeros(n, np.int64)
    found, owner = [], []
    if n:
        crc = fed(np.zeros(n, np.uint32), data, starts, ends)
        space = np.frombuffer(b" ", np.uint8)
        for k in range(longest):
            if k:
                m = len(crc) - 1
                if m < 1:
                    break
                zero = np.zeros(m, np.int64)
                crc = fed(fed(crc[:m], space, zero, zero + 1), data, starts[k:], ends[k:])
            whole = text[: n - k] == text[k:]
            if across:
                whole &= line[: n - k] != line[k:]
            found.append((crc[whole] % np.uint32(buckets)).astype(np.int64))
            owner.append(text[: n - k][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), words
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    ends_of = np.searchsorted(owners[order], np.arange(len(offsets)), side="left")
    return np.concatenate(found)[order], ends_of, words


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes; a row is never cut."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_HELD = "n_words bigint, n_features bigint, buckets binary"


def _held_runs(longest: int, buckets: int, across: bool = False):
    """The text in the last column replaced by what it holds; other columns stay."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_texts(batch.column(batch.num_columns - 1))
            for a, b in _chunks(offsets):
                at = offsets[a : b + 1]
                found, ends, words = run_buckets(
                    data[at[0] : at[-1]], at - at[0], longest, buckets, across
                )
                cells = found.astype(kind).tobytes()
                size = np.dtype(kind).itemsize
                packed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), b - a, [None, pa.py_buffer(ends * size), pa.py_buffer(cells)]
                ).cast(pa.binary())
                own = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                names = [*batch.schema.names[:-1], "n_words", "n_features", "buckets"]
                made = [pa.array(words), pa.array(np.diff(ends)), packed]
                yield pa.RecordBatch.from_arrays([*own, *made], names=names)

    return run


def _cells(column, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    data, offsets = raw_texts(column)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes(), kind).astype(np.int64), offsets // size


def bucket_counts(held: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, over (occurrences, buckets). Tasks add up their own first;
    as many numbers as there are buckets reach the driver, however much text there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            times = batch.column(0).to_numpy(zero_copy_only=False)
            cells, at = _cells(batch.column(1), buckets)
            each = np.repeat(times, np.diff(at))
            for start in range(0, len(cells), CHUNK):
                part = slice(start, start + CHUNK)
                np.add.at(total, cells[part], each[part])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there), pa.array(total[there])], names=["bucket", "n"]
        )

    found = held.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(p / q))`` per bucket, each bucket counted once more than found."""
    buckets, t_all, s_all = len(corpus), int(target.sum()), int(corpus.sum())
    return np.array(
        [
            math.floor(
                1000
                * math.log(
                    float((t + 1) * (s_all + buckets)) / float((s + 1) * (t_all + buckets))
                )
            )
            for t, s in zip(target.tolist(), corpus.tolist(), strict=True)
        ],
        np.int64,
    )


def _gained(gains: np.ndarray):
    """The buckets in the last column replaced by the sum of their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            cells, at = _cells(batch.column(last), len(gains))
            sums = np.concatenate([[0], np.cumsum(gains[cells])])
            own = [batch.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(sums[at[1:]] - sums[at[:-1]])],
                names=[*batch.schema.names[:-1], "gain"],
            )

    return run


_LINE = ["l1", "l2"]
_ROW = ["doc_id", "d1", "d2"]


def _digests(text: Column, names: list[str]) -> list[Column]:
    """128 bits of a text: two hashes with seeds of their own."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])]


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def _segments(texts: DataFrame, *own: Column) -> DataFrame:
    """``own`` columns, place and text of each line; the first stands also where it is empty."""
    lines = texts.select(*own, F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.where("place = 0 or line <> ''")


def _distinct_lines(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    counted = _segments(texts).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    held = counted.select(*_digests(F.col("line"), _LINE), "times", "line")
    return held.mapInArrow(
        _held_runs(longest, buckets), f"l1 bigint, l2 bigint, times bigint, {_HELD}"
    )


def _across(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    whole = texts.where(F.contains("text", F.lit("\n")))
    return whole.select("doc_id", *_digests(F.col("text"), ["d1", "d2"]), "text").mapInArrow(
        _held_runs(longest, buckets, True), f"doc_id bigint, d1 bigint, d2 bigint, {_HELD}"
    )


def weighted_documents(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """``doc_id, d1, d2, copies, n_words, n_features, weight``: one row per identifier and text.

    Words are runs of ASCII letters (folded to lower case), digits and characters beyond ASCII.
    A feature is a run of 1 to ``longest`` words; ``weight`` sums its bucket's
    ``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))``. ``d1, d2`` are hashes of the text and
    ``copies`` the number of rows. Only ``buckets`` numbers per table reach the driver.

    A null text is the empty one: no features, weight 0. Texts of any length are read whole. Without
    target texts or documents the counts of that side are 0. Invalid UTF-8 is taken byte by byte.
    """
    ship(docs.sparkSession)
    texts = _read(docs, id_col, text_col)
    goal = target.select(
        F.coalesce(target[target_text_col].cast("string"), F.lit("")).alias("text")
    )
    lines = kept(_distinct_lines(texts, longest, buckets))
    wanted = _distinct_lines(goal, longest, buckets).select("times", "buckets")
    across = None
    corpus = lines.select("times", "buckets")
    if longest > 1:
        across = kept(_across(texts, longest, buckets))
        corpus = corpus.unionByName(across.select(F.lit(1).cast("long").alias("times"), "buckets"))
        goal = goal.withColumn("doc_id", F.lit(0).cast("long"))
        more = _across(goal, longest, buckets)
        wanted = wanted.unionByName(more.select(F.lit(1).cast("long").alias("times"), "buckets"))
    gains = bucket_gains(bucket_counts(wanted, buckets), bucket_counts(corpus, buckets))

    held = ["n_words", "n_features"]
    line_gains = lines.select(*_LINE, "times", *held, "buckets").mapInArrow(
        _gained(gains),
        "l1 bigint, l2 bigint, times bigint, n_words bigint, n_features bigint, gain bigint",
    )
    # Lines that are at least a thousandth of all: at most a thousand rows, whatever the input.
    total = lines.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    often = F.col("times") * FREQUENT >= total
    measures = [*held, "gain"]
    hot = line_gains.where(often).select(*_LINE, *[F.col(c).alias(f"hot_{c}") for c in measures])
    cold = line_gains.where(~often).select(
        F.col("l1").alias("k1"), F.col("l2").alias("k2"), *measures
    )
    placed = _segments(texts, F.col("doc_id"), *_digests(F.col("text"), ["d1", "d2"]))
    placed = placed.select(
        *_ROW, (F.col("place") == 0).cast("long").alias("first"), *_digests(F.col("line"), _LINE)
    )
    met = placed.join(F.broadcast(hot), _LINE, "left")
    # What is settled goes by the document's own hash, so that no line gathers in one task.
    settled = F.col("hot_gain").isNotNull()
    met = met.select(
        *_ROW, "first", *[f"hot_{c}" for c in measures],
        F.when(settled, F.col("d1")).otherwise(F.col("l1")).alias("k1"),
        F.when(settled, F.col("d2")).otherwise(F.col("l2")).alias("k2"),
    ).join(cold, ["k1", "k2"], "left")
    parts = met.select(
        *_ROW, "first", *[F.coalesce(f"hot_{c}", c).alias(c) for c in measures]
    )
    if across is not None:
        gained = across.select(*_ROW, *held, "buckets").mapInArrow(
            _gained(gains),
            "doc_id bigint, d1 bigint, d2 bigint, n_words bigint, n_features bigint, gain bigint",
        )
        # The words are counted with the lines already.
        zero = F.lit(0).cast("long")
        parts = parts.unionByName(
            gained.select(
                *_ROW, zero.alias("first"), zero.alias("n_words"), "n_features", "gain"
            )
        )
    copies = F.sum("first").alias("copies")
    summed = parts.groupBy(*_ROW).agg(copies, *[F.sum(c).alias(c) for c in measures])
    return summed.select(
        *_ROW, "copies",
        *[F.expr(f"{c} div copies").alias(c) for c in held],
        F.expr("gain div copies").alias("weight"),
    )


def noise(id_column: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the digest of seed and identifier (null: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words, d1, d2`` for every row of ``docs``.

    Of the rows with at least ``least_words`` words, ``floor(percent * N / 100)`` are drawn: those
    with the highest scores (weight plus noise), ties to the smaller identifier (null last). Drawn
    rows have a ``rank`` from 1, others null. Rows alike in identifier and text get ranks in
    sequence; texts under one identifier and score go by their hash. Empty tables give no rows.

    Ranks come from a sort by ranges: a range is numbered on its own, after the numbers of rows in
    the ranges before it.
    """
    spark = docs.sparkSession
    found = weighted_documents(
        docs, target, longest, buckets, id_col, text_col, target_text_col
    )
    score = (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")
    scored = kept(found.select("*", score))
    enough = scored.where(F.col("n_words") >= least_words)
    n = enough.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    take = percent * n // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("d1"), F.asc("d2")]
    dealt = kept(
        enough.select(*_ROW, "copies", "score")
        .repartitionByRange(partitions(spark), *order)
        .withColumn("range", F.spark_partition_id())
    )
    sizes = sorted(dealt.groupBy("range").agg(F.sum("copies")).collect())
    before, so_far = [], 0
    for number, rows in sizes:  # one number per range, as many as partitions
        before.append((number, so_far))
        so_far += rows
    starts = spark.createDataFrame(before, "range int, before bigint")
    within = Window.partitionBy("range").orderBy(*order)
    ahead = F.sum("copies").over(within) - F.col("copies")
    # A range that begins behind the last drawn row is not sorted.
    drawn = dealt.join(F.broadcast(starts.where(F.col("before") < take)), "range")
    drawn = drawn.select(*_ROW, (F.col("before") + ahead).alias("ahead")).where(
        F.col("ahead") < take
    )
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _ROW]
    ranked = scored.alias("s").join(
        drawn.alias("r"), same[0] & same[1] & same[2], "left"
    ).select("s.*", "r.ahead")
    # Many copies of one row are written by many tasks.
    blocks = ranked.withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}")))
    ).repartition(*_ROW, "block")
    copy = F.explode(
        F.sequence(
            F.col("block") * COPIES,
            F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1,
        )
    )
    rank = F.when(F.col("ahead") + F.col("copy") < take, F.col("ahead") + F.col("copy") + 1)
    return blocks.withColumn("copy", copy).select(
        "doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words", "d1", "d2"
    )


def drawn_texts(
    docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``rank, doc_id, text`` of the rows that ``resampled`` drew from ``docs``."""
    texts = _read(docs, id_col, text_col).select(
        "doc_id", "text", *_digests(F.col("text"), ["d1", "d2"])
    )
    drawn = ranks.where("rank is not null").select(*_ROW, "rank")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _ROW]
    alike = same[0] & same[1] & same[2]
    # One text per identifier and hash; its rows are alike, so any will do.
    once = texts.alias("t").join(drawn.alias("r"), alike, "left_semi").dropDuplicates(_ROW)
    met = once.alias("t").join(drawn.alias("r"), alike)
    return met.select("r.rank", "t.doc_id", "t.text")


#: CRC-32 as a fold over a word's bytes; its table follows from the polynomial.
SQL = r"""
WITH RECURSIVE t(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
  FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS m FROM t WHERE k = 8),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
x AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
u AS (
  SELECT w, xor(list_reduce(
      list_prepend(4294967295::BIGINT,
        list_transform(range(0, length(h) // 2),
          lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)),
      lambda c, v: xor(c >> 8, m[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS k
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM x UNION SELECT w FROM b)), crc),
s AS (SELECT k, sum(n) AS s FROM x JOIN u USING (w) GROUP BY k),
g AS (SELECT k, count(*) AS t FROM b JOIN u USING (w) GROUP BY k),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss,
             coalesce((SELECT sum(t) FROM g), 0)::DOUBLE AS tt),
gain AS (
  SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1) * (ss + 10000))
                            / ((s + 1) * (tt + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN g USING (k), a),
weight AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM x JOIN u USING (w) JOIN gain USING (k) GROUP BY r),
sc AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((
      ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (r)),
k AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
      PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n
  FROM sc)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score::BIGINT AS score,
  CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM k
"""
