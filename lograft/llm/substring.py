"""Passages that an earlier document has too, by seeds and hashed windows of words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lograft.llm.common import (
    dealing,
    doc_groups,
    gram_hashes,
    id_and_text,
    raw_texts,
    ship,
    sliding_min,
    word_hashes,
)
from lograft.llm.seeds import (
    SEED_SCHEMA,
    by_bucket,
    columns,
    held,
    in_several,
    numbers,
    ordered,
    received_keys,
    seed_keys,
    seed_table,
    shared_seeds,
)

#: Words of a seed. A window's seed is the one with the smallest hash that starts in it.
SEED_WORDS = 5

WINDOW_SCHEMA = "grp int, bucket int, windows binary, ords binary"
FOUND_SCHEMA = "grp int, windows binary"
OUT_SCHEMA = (
    "doc_id bigint, n_words bigint, n_removed bigint, n_repeats bigint, kept_sha256 string"
)


#: Two windows are the same if both parts are. At 10^13 windows, 64 bits alone would take millions of
#: different ones for equal; 96 bits take none (the odds are below one in a thousand).
WINDOW = np.dtype([("hash", "<u8"), ("check", "<u4")])
_HALF = np.uint64(32)


def by_value(windows: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal windows together, ``then`` ascending among them, and where in it a
    window differs from the one before."""
    order = np.lexsort((*then[::-1], windows["check"], windows["hash"]))
    ranked = windows[order]
    new = np.ones(len(order), bool)
    new[1:] = (ranked["hash"][1:] != ranked["hash"][:-1]) | (
        ranked["check"][1:] != ranked["check"][:-1]
    )
    return order, new


def among(windows: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which windows are in ``found``."""
    order, _ = by_value(found)
    ranked = found[order]
    out = np.zeros(len(windows), bool)
    at = np.searchsorted(ranked["hash"], windows["hash"])
    left = np.flatnonzero(at < len(ranked))
    while len(left):
        same = ranked["hash"][at[left]] == windows["hash"][left]
        left = left[same]
        hit = ranked["check"][at[left]] == windows["check"][left]
        out[left[hit]] = True
        # Different windows of one hash stand side by side.
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < len(ranked)]
    return out


class Words:
    """The word hashes of a group's documents, and the seed of every window inside one document."""

    def __init__(self, group: pa.Table, window: int):
        group = ordered(group)
        self.group, self.window = group, window
        self.hashes, self.counts = word_hashes(*raw_texts(group.column("text")))
        self.ords = group.column("ord").to_numpy()
        n = max(0, len(self.hashes) - window + 1)
        doc = np.repeat(np.arange(len(group)), np.diff(self.counts))
        self.starts = np.flatnonzero(doc[:n] == doc[window - 1 :]) if n else np.zeros(0, int)
        self.docs = doc[self.starts]
        self.seeds = np.zeros(0, np.uint64)
        if n:
            grams = gram_hashes(self.hashes, SEED_WORDS)
            self.seeds = sliding_min(grams, window - SEED_WORDS + 1)[self.starts]

    def firsts(self) -> np.ndarray:
        """Where a seed differs from the one of the window before, or a document begins."""
        change = np.ones(len(self.seeds), bool)
        change[1:] = (self.seeds[1:] != self.seeds[:-1]) | (self.docs[1:] != self.docs[:-1])
        return change

    def window_hashes(self, chosen: np.ndarray) -> np.ndarray:
        """96 bits of each chosen window, as a hash and a check of it."""
        starts = self.starts[chosen]
        out = np.empty(len(starts), WINDOW)
        out["hash"] = gram_hashes(self.hashes, self.window)[starts]
        out["check"] = gram_hashes(self.hashes, self.window, 0xC2B2AE3D27D4EB4F)[starts] >> _HALF
        return out


def find_repeats(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: what is left of it without repeated passages.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller identifier; windows are judged on the input. Seeds: every window names the
    ``SEED_WORDS``-word run with the smallest hash that it holds (winnowing), so two equal windows
    have equal seeds. Documents meet on seeds only. Around a seed that several documents have, the
    windows that hold it are compared whole, by 96 bits, not extended word by word: contexts of an
    anchor would have to meet in one task, and a frequent phrase has as many as documents, where
    windows are dealt out each by its own hash. Neighbouring windows join to maximal repeats, of which
    none is shorter than ``window``.

    Documents are dealt over groups of a few megabytes; what groups tell each other are
    distinct seeds, then distinct windows with their first document. So a passage that all
    documents share costs one number per group. Texts are shuffled once.

    Null and empty texts, and texts of fewer words, keep all they have. A null identifier counts
    as larger than all others; rows with the same identifier do not remove words from each other.
    An empty table gives no rows.
    """
    if window <= SEED_WORDS:
        raise ValueError(f"a window needs more than {SEED_WORDS} words")
    spark = docs.sparkSession
    ship(spark)
    groups, buckets = dealing(docs)
    grouped = doc_groups(docs, groups)

    def seeds(group: pa.Table) -> pa.Table:
        words = Words(group, window)
        return seed_table(
            group.column("grp")[0].as_py(), words.seeds[words.firsts()], buckets
        )

    def windows(group: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if len(group) and len(told):
            words = Words(group, window)
            chosen = held(seed_keys(words.seeds, buckets), received_keys(told))
            first, ords = first_orders(words, chosen)
            number = group.column("grp")[0].as_py()
            for bucket, part in by_bucket(first["hash"], buckets):
                rows.append((number, bucket, first[part].tobytes(), ords[part].tobytes()))
        return columns(
            rows,
            [pa.int32(), pa.int32(), pa.binary(), pa.binary()],
            ["grp", "bucket", "windows", "ords"],
        )

    def earlier(bucket: pa.Table) -> pa.Table:
        parts = numbers(bucket.column("windows"), WINDOW)
        ords = np.concatenate(numbers(bucket.column("ords"), np.int64))
        order, new = by_value(np.concatenate(parts), ords)
        least = ords[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = np.zeros(len(order), bool)
        later[order] = ords[order] > least
        rows, at = [], 0
        for group, part in zip(bucket.column("grp").to_pylist(), parts, strict=True):
            found = part[later[at : at + len(part)]]
            at += len(part)
            if len(found):
                rows.append((group, found.tobytes()))
        return columns(rows, [pa.int32(), pa.binary()], ["grp", "windows"])

    def result(group: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        if len(group):
            words = Words(group, window)
            gone = covered(words, removed_windows(words, numbers(found.column("windows"), WINDOW)))
            rows = list(kept_rows(words, gone, with_text))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "n_repeats", "kept_sha256"]
        if with_text:
            types, names = [*types, pa.string()], [*names, "kept_text"]
        return columns(rows, types, names)

    told = shared_seeds(grouped.groupBy("grp").applyInArrow(seeds, SEED_SCHEMA))
    mine = grouped.groupBy("grp")
    met = mine.cogroup(told.groupBy("grp")).applyInArrow(windows, WINDOW_SCHEMA)
    found = met.groupBy("bucket").applyInArrow(earlier, FOUND_SCHEMA)
    out = OUT_SCHEMA + (", kept_text string" if with_text else "")
    return mine.cogroup(found.groupBy("grp")).applyInArrow(result, out)


def first_orders(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct chosen windows, and the smallest identifier here of a document with each."""
    windows = words.window_hashes(chosen)
    order, new = by_value(windows)
    first = order[new]  # the order is stable, and documents come by identifier
    return windows[first], words.ords[words.docs[chosen][first]]


def removed_windows(words: Words, found: list[np.ndarray]) -> np.ndarray:
    """Window starts whose words an earlier document has, in another group or in this one."""
    if len(words.starts) == 0:
        return words.starts
    every = np.ones(len(words.starts), bool)
    gone = np.zeros(len(words.starts), bool)
    if found:
        gone = among(words.window_hashes(every), np.concatenate(found))
    change = words.firsts()
    local = held(words.seeds, in_several(words.seeds[change], words.docs[change]))
    if local.any():
        order, new = by_value(words.window_hashes(local))
        ords = words.ords[words.docs[local]][order]
        least = ords[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        gone[np.flatnonzero(local)[order[ords > least]]] = True
    return words.starts[gone]


def covered(words: Words, starts: np.ndarray) -> np.ndarray:
    edge = np.zeros(len(words.hashes) + 1, np.int32)
    edge[starts] += 1
    np.subtract.at(edge, starts + words.window, 1)
    return np.cumsum(edge)[:-1] > 0


def kept_rows(words: Words, gone: np.ndarray, with_text: bool):
    texts = words.group.column("text").cast(pa.binary())
    ids = words.group.column("doc_id").to_pylist()
    for k, (doc, text) in enumerate(zip(ids, texts, strict=True)):
        a, b = words.counts[k], words.counts[k + 1]
        mine = gone[a:b]
        split = (text.as_py() or b"").split()
        removed = int(mine.sum())
        if removed:
            split = [w for w, g in zip(split, mine.tolist(), strict=True) if not g]
        runs = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum())
        body = b" ".join(split)
        row = (doc, int(b - a), removed, runs, hashlib.sha256(body).hexdigest())
        yield (*row, body.decode("utf-8", "replace")) if with_text else row


def substring_dedup(
    docs: DataFrame,
    window: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """``find_repeats`` on two named columns; see there."""
    return find_repeats(id_and_text(docs, id_col, text_col), window, with_text)

