"""Packing tokenized documents into sequences of bounded length: best two fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lograft.llm.common import id_and_text, ship
from lograft.llm.sharding import number_slots
from lograft.llm.tokens import TokenizerFile, encoder
from lograft.sources.shared import kept

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    docs: DataFrame,
    tokenizer: TokenizerFile,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's ids and ``end_id``, cut only where longer than ``capacity``; no shuffle.

    A null text is empty: one piece that holds ``end_id`` alone.
    """
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1).cast(pa.binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = encode.encode(text.as_py() or b"") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(
                        zip(*rows, strict=True) if rows else [()] * 5,
                        [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()],
                        strict=True,
                    )
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, PIECE_SCHEMA)


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """How many bins of which make: ``(bins, [(length, times), ...])``.

    ``counts[n]`` is the number of pieces of length n. Each bin starts with the longest piece left
    and takes the longest that fits until none does. If a gap stays, the bin's shortest piece gives
    way to the two unpacked pieces that fill its place and the gap best, if they fill more. Bins of
    one make are made as often as the counts allow, so the plan's size follows the number of
    different lengths, at most ``capacity``, and not the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan = []
    while True:
        have = np.flatnonzero(left)
        if len(have) == 0:
            return plan
        used: dict[int, int] = {}
        room = capacity
        while room:
            i = int(np.searchsorted(have, room, "right")) - 1
            while i >= 0 and left[have[i]] == used.get(int(have[i]), 0):
                i -= 1
            if i < 0:
                break
            n = int(have[i])
            times = int(min(left[n] - used.get(n, 0), room // n))
            used[n] = used.get(n, 0) + times
            room -= times * n
        if room:
            short = min(used)
            rest = left[have].copy()
            for n, times in used.items():
                rest[np.searchsorted(have, n)] -= times
            free, amount = have[rest > 0], rest[rest > 0]
            if len(free):
                other = np.searchsorted(free, room + short - free, "right") - 1
                # The same length twice needs two pieces of it; else the next shorter one.
                other -= (other == np.arange(len(free))) & (amount < 2)
                total = np.where(other >= 0, free + free[other], 0)
                best = int(np.argmax(total))
                if total[best] > short:
                    used[short] -= 1
                    for n in (int(free[best]), int(free[other[best]])):
                        used[n] = used.get(n, 0) + 1
                    used = {n: t for n, t in used.items() if t}
        bins = min(int(left[n]) // t for n, t in used.items())
        for n, t in used.items():
            left[n] -= bins * t
        plan.append((bins, sorted(used.items(), reverse=True)))


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    The pieces' lengths are counted (at most ``capacity`` counts come to the driver), bins are
    planned on the counts, and the i-th piece of its length takes the i-th place planned for that
    length. Numbering is by length and block, so neither a length that a third of all pieces have
    nor any other is sorted or gathered in one task.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    firsts = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for bins, make in plan_bins(counts, capacity):
        offset = 0
        for length, times in make:
            rows.append((length, firsts[length], bins, sequence, offset))
            firsts[length] += bins * times
            offset += length * times
        sequence += bins
    rows.sort()
    places = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # length and first number as one sorted key
        length, first, bins, sequence, offset = places.value.T
        keys = (length << 44) + first
        for batch in batches:
            n = batch.column(3).to_numpy()
            i = batch.column(5).to_numpy()
            row = np.searchsorted(keys, (n << 44) + i, "right") - 1
            i = i - first[row]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(sequence[row] + i % bins[row]),
                    pa.array(offset[row] + i // bins[row] * n),
                ],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    numbered = number_slots(pieces, "length", "doc_id", "_number", ("doc_id", "piece", "start"))
    return numbered.select(*pieces.columns, "_number").mapInArrow(
        placed, f"{PIECE_SCHEMA}, sequence_id bigint, offset bigint"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: TokenizerFile,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenize once, keep the pieces' lengths and checksums in the shared folder, pack them.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null texts are empty; null
    and repeated identifiers are rows like others; an empty table gives no rows.
    """
    pieces = kept(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    return pack_pieces(pieces, capacity)
