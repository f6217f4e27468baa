"""SentencePiece encoding and decoding in numpy, many words at a time."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import id_and_text, mixed, ship

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: Distinct words a worker remembers.
REMEMBERED = 500_000
#: Longer words are encoded one by one, in time that grows little faster than their length.
LONG = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MODELS: dict = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """Pieces, scores and kinds by id; ``kind`` is UNIGRAM or BPE."""

    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    kind: int = BPE
    prefix: bool = True

    @staticmethod
    def read(path: str) -> PieceModel:
        """A ``.model`` file that leaves texts as they are but for the space in front."""
        with open(path, "rb") as file:
            top = list(_fields(file.read()))
        parts = [dict(_fields(v)) for k, v in top if k == 1]
        trainer = dict(next(_fields_of(top, 2), ()))
        normal = dict(next(_fields_of(top, 3), ()))
        if normal.get(2) or normal.get(4, 1):
            raise ValueError("only models without a character map that keep white space")
        return PieceModel(
            [p[1].decode("utf-8") for p in parts],
            np.array([np.frombuffer(p.get(2, bytes(4)), "<f4")[0] for p in parts], np.float64),
            np.array([p.get(3, NORMAL) for p in parts]),
            trainer.get(3, UNIGRAM),
            bool(normal.get(3, 1)),
        )


def _fields_of(top, number: int):
    return (_fields(v) for k, v in top if k == number)


def _powers(n: int) -> np.ndarray:
    base = np.full(n, _BASE)
    base[0] = 1
    return np.multiply.accumulate(base)


class Codec:
    """Ids of texts, and texts of ids, as the library gives them for the same model."""

    def __init__(self, model: PieceModel):
        self.model = model
        usable = [i for i, t in enumerate(model.types) if t in (NORMAL, USER)]
        self.by_text = {model.pieces[i]: i for i in usable}
        if any(SPACE in p.lstrip(SPACE) for p in self.by_text):
            raise ValueError("a piece reaches over the beginning of a word")
        self.longest = max(map(len, self.by_text))
        self.powers = _powers(4 * LONG)
        texts = sorted(self.by_text, key=len)
        keys, ids = [], []
        for size in sorted({len(t) for t in texts}):
            some = [t for t in texts if len(t) == size]
            keys.append(self._prefixes(self._letters(some, size))[:, -1])
            ids += [self.by_text[t] for t in some]
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids)[order]
        self.key_scores = model.scores[self.ids]
        self.unknown = int(np.flatnonzero(model.types == UNKNOWN)[0])
        self.bytes = np.full(256, self.unknown)
        for i in np.flatnonzero(model.types == BYTE):
            self.bytes[int(model.pieces[i][1:-1], 16)] = i
        self.falls_back = bool((model.types == BYTE).any())
        self.floor = float(model.scores[usable].min()) - 10.0
        self.known: dict[str, bytes] = {}
        bodies = [self._body(i) for i in range(len(model.pieces))]
        self.body_at = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        self.body = np.frombuffer(b"".join(bodies) or b"\0", np.uint8)

    def _body(self, i: int) -> bytes:
        kind, text = self.model.types[i], self.model.pieces[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        if kind == BYTE:
            return bytes([int(text[1:-1], 16)])
        return text.replace(SPACE, " ").encode("utf-8")

    @staticmethod
    def _letters(words: list[str], size: int) -> np.ndarray:
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        return flat.reshape(len(words), size)

    def _prefixes(self, letters: np.ndarray) -> np.ndarray:
        """Hashes of the first 0, 1, ... letters of each word."""
        each = mixed(letters.astype(np.uint64) + np.uint64(1))
        out = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
        for j in range(letters.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + each[:, j]
        return out

    def _probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and score of substrings by hash; -1 where they are no piece."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return np.where(hit, self.ids[at], -1), np.where(hit, self.key_scores[at], -np.inf)

    def _spans(self, prefix: np.ndarray, row, a, b) -> np.ndarray:
        return prefix[row, b] - prefix[row, a] * self.powers[b - a]

    # --- encoding ---

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        return b"".join(self.words([text])[0])

    def words(self, texts: list[str]) -> list[list[bytes]]:
        """The ids of each word of each text; words that are not remembered are encoded together."""
        split = []
        for text in texts:
            text = text.replace(SPACE, " ")
            if text and self.model.prefix:
                text = " " + text
            split.append(re.findall(" *[^ ]+| +", text))
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        missing = {w for words in split for w in words if w not in known}
        known.update(self.encode_words(missing))
        return [[known[w] for w in words] for words in split]

    def encode_words(self, words) -> dict[str, bytes]:
        """Ids of distinct words; words of one length advance together."""
        out: dict[str, bytes] = {}
        lengths: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONG:
                out[w] = self._slow(w.replace(" ", SPACE))
            else:
                lengths.setdefault(len(w), []).append(w)
        advance = self._viterbi if self.model.kind == UNIGRAM else self._merge
        for size, same in lengths.items():
            for i in range(0, len(same), 1 << 14):
                some = same[i : i + (1 << 14)]
                texts = [w.replace(" ", SPACE) for w in some]
                letters = self._letters(texts, size)
                cuts = advance(self._prefixes(letters), size)
                out.update(zip(some, self._ids(texts, letters, cuts), strict=True))
        return out

    def _ids(self, texts, letters, cuts: np.ndarray) -> Iterator[bytes]:
        """Ids of the pieces between the cuts of each word; ``cuts[r, j]``: a piece begins at j."""
        prefix = self._prefixes(letters)
        row, a = np.nonzero(cuts)
        size = letters.shape[1]
        b = np.empty_like(a)
        b[:-1] = np.where(row[1:] == row[:-1], a[1:], size)
        b[-1] = size
        ids, _ = self._probe(self._spans(prefix, row, a, b))
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        rough = set(row[ids < 0].tolist())
        whole = ids.astype("<u4").tobytes()
        for r, text in enumerate(texts):
            lo, hi = ends[r], ends[r + 1]
            if r not in rough:
                yield whole[4 * lo : 4 * hi]
                continue
            mine: list[int] = []
            for i, s, e in zip(ids[lo:hi].tolist(), a[lo:hi], b[lo:hi], strict=True):
                mine += [i] if i >= 0 else self._fallback(text[s:e])
            yield np.array(mine, "<u4").tobytes()

    def _fallback(self, letters: str) -> list[int]:
        if not self.falls_back:
            return [self.unknown]
        return [int(self.bytes[b]) for b in letters.encode("utf-8")]

    def _viterbi(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Cuts of the best segmentation, for all words at once.

        The best score up to each place is the largest over the pieces that end there; the piece's
        length is its backpointer. A letter that is no piece counts as one of the lowest score.
        """
        n = len(prefix)
        row = np.arange(n)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((n, size + 1), np.int64)
        for end in range(1, size + 1):
            lengths = np.arange(1, min(end, self.longest) + 1)
            options = np.empty((n, len(lengths)))
            for k, length in enumerate(lengths):
                spans = prefix[:, end] - prefix[:, end - length] * self.powers[length]
                score = self._probe(spans)[1]
                if length == 1:
                    score = np.where(np.isneginf(score), self.floor, score)
                options[:, k] = best[:, end - length] + score
            choice = options.argmax(1)
            best[:, end] = options[row, choice]
            back[:, end] = lengths[choice]
        cuts = np.zeros((n, size), bool)
        at = np.full(n, size)
        while (at > 0).any():
            live = at > 0
            at[live] -= back[row[live], at[live]]
            cuts[row[live], at[live]] = True
        return cuts

    def _merge(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Cuts after merging: in every word the best neighbouring pair, the first of equals, joins
        to one piece, until no pair is a piece. All words of the batch take a step together."""
        n = len(prefix)
        cuts = np.ones((n, size), bool)
        live = np.arange(n)
        edge = np.broadcast_to(np.arange(size + 1), (n, size + 1)).copy()
        score = np.full((n, max(size - 1, 0)), -np.inf)
        for j in range(size - 1):
            score[:, j] = self._probe(self._spans(prefix, live, j, j + 2))[1]
        while len(live) and score.shape[1]:
            j = score.argmax(1)
            row = np.arange(len(live))
            more = score[row, j] > -np.inf
            if not more.all():
                live, edge, score, j = live[more], edge[more], score[more], j[more]
                row = np.arange(len(live))
                if len(live) == 0:
                    break
            cuts[live, edge[row, j + 1]] = False
            # Without the edge after the pair's first part, later ones move up.
            width = edge.shape[1]
            keep = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > j[:, None])
            edge = np.take_along_axis(edge, keep, 1)
            columns = np.arange(width - 3)[None, :]
            keep = columns + (columns >= j[:, None])
            score = np.take_along_axis(score, keep, 1)
            for k in (j - 1, j):
                good = (k >= 0) & (k < score.shape[1])
                r, c = row[good], k[good]
                if len(r):
                    score[r, c] = self._pair(prefix, live[r], edge[r, c], edge[r, c + 2])
        return cuts

    def _pair(self, prefix, row, a, b) -> np.ndarray:
        out = np.full(len(row), -np.inf)
        fits = b - a <= self.longest
        out[fits] = self._probe(self._spans(prefix, row[fits], a[fits], b[fits]))[1]
        return out

    def _slow(self, word: str) -> bytes:
        """A long word: merges from a queue, or Viterbi letter by letter."""
        score = lambda a, b: self.by_text.get(word[a:b])
        n = len(word)
        if self.model.kind == UNIGRAM:
            best, back = [0.0] + [-np.inf] * n, [1] * (n + 1)
            for end in range(1, n + 1):
                for start in range(max(0, end - self.longest), end):
                    i = score(start, end)
                    gain = self.model.scores[i] if i is not None else None
                    if gain is None and start == end - 1:
                        gain = self.floor
                    if gain is not None and best[start] + gain > best[end]:
                        best[end], back[end] = best[start] + gain, end - start
            cuts, at = [], n
            while at:
                at -= back[at]
                cuts.append(at)
            cuts = cuts[::-1]
        else:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            alive = [True] * n + [False]
            queue: list = []

            def offer(a: int) -> None:
                b = after[a]
                if a >= 0 and b < n and after[b] - a <= self.longest:
                    i = score(a, after[b])
                    if i is not None:
                        heapq.heappush(queue, (-self.model.scores[i], a, b, after[b]))

            for a in range(n - 1):
                offer(a)
            while queue:
                _, a, b, end = heapq.heappop(queue)
                if not (alive[a] and alive[b] and after[a] == b and after[b] == end):
                    continue
                alive[b] = False
                after[a] = end
                if end < n:
                    before[end] = a
                if before[a] >= 0:
                    offer(before[a])
                offer(a)
            cuts = [a for a in range(n) if alive[a]]
        ids: list[int] = []
        for a, b in zip(cuts, [*cuts[1:], n], strict=True):
            i = score(a, b)
            ids += [i] if i is not None else self._fallback(word[a:b])
        return np.array(ids, "<u4").tobytes()

    # --- decoding ---

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces' bytes are gathered at once, the space in front is dropped."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(i) == 0:
            return ""
        size = self.body_at[i + 1] - self.body_at[i]
        shift = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.body_at[i] - shift, size)
        text = self.body[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text[:1] == " " else text


def codec(path: str) -> Codec:
    """This worker's codec for the file."""
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = Codec(PieceModel.read(path))
    return _MODELS[path]


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids`` (array of int); no shuffle. Null texts have no ids, like empty ones."""
    ship(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = []
            for i in range(0, len(texts), 256):
                ids += [b"".join(w) for w in encoder.words(texts[i : i + 256])]
            counts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(counts), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(encoded, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; no shuffle. Null ids give a null text."""
    ship(encoded.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = codec(path)
        for batch in batches:
            texts = [
                None if x is None else decoder.decode(np.array(x, "<u4").tobytes())
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id bigint, text string")


def round_trips(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, text_crc32, round_trip``: every text encoded and decoded again.

    ``ids_crc32`` is over the ids as little-endian 32-bit numbers, ``text_crc32`` over the decoded
    text; ``round_trip`` says that it is the text itself, where a text's own U+2581 is a space as
    in every such model. A null text is the empty one. Bytes that are no UTF-8 are replaced by
    U+FFFD before. Texts are encoded whole, however long; repeated rows are each reported; an empty
    table gives no rows; other columns are not looked at.
    """
    ship(docs.sparkSession)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = [
                (t or b"").decode("utf-8", "replace")
                for t in batch.column(1).cast(pa.binary()).to_pylist()
            ]
            rows = []
            for i in range(0, len(texts), 256):
                some = texts[i : i + 256]
                for text, words in zip(some, coder.words(some), strict=True):
                    ids = b"".join(words)
                    back = coder.decode(ids)
                    rows.append(
                        (len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode("utf-8")),
                         back == text.replace(SPACE, " "))
                    )
            counts, ids_crc, text_crc, same = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_crc, pa.int64()),
                    pa.array(text_crc, pa.int64()), pa.array(same, pa.bool_()),
                ],
                names=["doc_id", "n_ids", "ids_crc32", "text_crc32", "round_trip"],
            )

    read = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text"))
    return read.mapInArrow(
        both,
        "doc_id bigint, n_ids bigint, ids_crc32 bigint, text_crc32 bigint, round_trip boolean",
    )
