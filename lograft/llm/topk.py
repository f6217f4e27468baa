"""Exact top-k by inner product, with upper bounds from segment means and deviations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograft.llm.common import ship

#: Vectors and queries of a tile: what one task holds at once.
TILE_VECTORS = 1 << 16
TILE_QUERIES = 1 << 12
#: Vectors compared at once inside a tile.
BLOCK = 1024
#: Segments of the levels of resolution, coarse to fine; each divides the one after it.
LEVELS = (1, 4, 16)

LOW, HIGH = -(1 << 63), (1 << 63) - 1

OUT = "query_id bigint, vec_id bigint, score bigint"


def quantized(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component as a whole double; null where one is not finite."""
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    usable = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.when(usable, numbers)


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment its mean and its deviation, scaled so that their product bounds ``x @ y``.

    Of two vectors cut into segments of n components, each segment adds at most
    n * (mean * mean' + deviation * deviation') to the inner product (Cauchy-Schwarz on what is
    left of the means). The bound gets no larger where segments are cut further.
    """
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    means, rests = [], []
    for p in parts:
        n = p.shape[1]
        mean = p.sum(1) / n if n else np.zeros(len(p))
        means.append(mean * np.sqrt(n))
        rests.append(np.sqrt(np.maximum(((p - mean[:, None]) ** 2).sum(1), 0)))
    return np.stack(means + rests, 1)


def tile_top(
    qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, vector, score) of each query within a tile; ties to smaller ids.

    Vectors come in blocks, long ones first. A block's bounds are computed level by level for the
    queries and vectors that are left; exact products only where the finest bound still reaches
    the query's k-th best score so far.
    """
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    # Doubles hold products to 2**53, longs to 2**63; beyond, Python's whole numbers do, cut after.
    kind = np.float64 if largest < 2**53 else np.int64
    nothing = kind(-np.inf) if kind is np.float64 else LOW
    norms = np.sqrt((x**2).sum(1))
    order = np.lexsort((vid, -norms))
    vid, x, norms = vid[order], x[order], norms[order]
    qf = [features(q, n) for n in LEVELS]
    xf = [features(x, n) for n in LEVELS]
    slack = 1e-9 * np.sqrt((q**2).sum(1)) * float(norms.max(initial=0)) + 1e-6
    scores = np.full((len(q), k), nothing, kind)
    ids = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    for a in range(0, len(x), BLOCK):
        rows, cols = np.arange(len(q)), np.arange(a, min(a + BLOCK, len(x)))
        least = scores[:, -1].astype(float) - slack
        for qs, xs in zip(qf, xf, strict=True):
            if len(rows) and len(cols):
                can = qs[rows] @ xs[cols].T >= least[rows, None]
                rows, cols = rows[can.any(1)], cols[can.any(0)]
        if len(rows) == 0 or len(cols) == 0:
            continue
        if largest >= 2**62:
            left, right = ([[int(v) for v in r] for r in m.tolist()] for m in (q[rows], x[cols]))
            whole = np.array(left, object).dot(np.array(right, object).T)
            new = np.clip(whole, LOW, HIGH).astype(np.int64)
        else:
            new = q[rows].astype(kind) @ x[cols].T.astype(kind)
        new_ids = np.broadcast_to(vid[cols], new.shape).copy()
        own = new_ids == qid[rows][:, None]
        new[own] = nothing
        new_ids[own] = np.iinfo(np.int64).max
        both = np.concatenate([scores[rows], new], 1)
        both_ids = np.concatenate([ids[rows], new_ids], 1)
        if both.shape[1] > 4 * k:
            # Only what reaches the k-th best score can stay; ties included.
            kth = np.partition(both, both.shape[1] - k, axis=1)[:, -k]
            width = int((both >= kth[:, None]).sum(1).max())
            near = np.argpartition(both, both.shape[1] - width, axis=1)[:, -width:]
            both = np.take_along_axis(both, near, 1)
            both_ids = np.take_along_axis(both_ids, near, 1)
        # The negative of the smallest long is itself, so the order is turned bit by bit.
        turned = ~both if kind is np.int64 else -both
        best = np.lexsort((both_ids, turned), axis=1)[:, :k]
        scores[rows] = np.take_along_axis(both, best, 1)
        ids[rows] = np.take_along_axis(both_ids, best, 1)
    found = ids != np.iinfo(np.int64).max
    row = np.nonzero(found)[0]
    return qid[row], ids[found], scores[found].astype(np.int64)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` vectors with the highest integer
    inner product of ``floor(scale * x)`` components, rank from 1, ties to the smaller id.

    Vectors and queries are dealt into tiles of bounded size, each compared in one task as
    ``tile_top`` says; a tile gives at most k rows per query, and the last step ranks those. What a
    tile skips is proven too small, so results are exact. Vectors that are null, or hold a null or
    a number that is not finite, take no part; a query never finds rows with its own id; vectors of
    another length than the query's are not candidates. Rows with a null id take no part. Scores
    beyond a long are cut to its range. Repeated query rows give one answer; of vectors with
    one id the smallest counts. Empty tables give no rows.
    """
    ship(queries.sparkSession)

    def usable(frame: DataFrame) -> DataFrame:
        read = frame.select(
            frame[id_col].cast("long").alias("id"), quantized(frame[vector_col], scale).alias("v")
        )
        read = read.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
        return read.withColumn("d", F.size("v"))

    def tiles(n: int, size: int) -> int:
        return max(1, -(-n // size))

    asked, held = usable(queries), usable(vectors)
    q_tiles = tiles(queries.count(), TILE_QUERIES)
    v_tiles = tiles(vectors.count(), TILE_VECTORS)
    # Small inputs are still spread over the executors.
    v_tiles = max(v_tiles, queries.sparkSession.sparkContext.defaultParallelism)
    here = F.pmod(F.xxhash64("id"), F.lit(q_tiles)).cast("int")
    there = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(v_tiles)).cast("int")
    q = asked.withColumn("qt", here).withColumn(
        "vt", F.explode(F.sequence(F.lit(0), F.lit(v_tiles - 1)))
    )
    v = held.withColumn("vt", there).withColumn(
        "qt", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1)))
    )
    keys = ["d", "qt", "vt"]

    def compare(mine: pa.Table, others: pa.Table) -> pa.Table:
        parts = [np.zeros(0, np.int64)] * 3
        if len(mine) and len(others):
            parts = tile_top(
                mine.column("id").to_numpy(), _matrix(mine.column("v")),
                others.column("id").to_numpy(), _matrix(others.column("v")), k,
            )
        return pa.table([pa.array(p) for p in parts], names=["query_id", "vec_id", "score"])

    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(compare, OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
