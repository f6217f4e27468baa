"""Token ids from a tokenizer file, word by word where the tokenizer allows it."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from dataclasses import dataclass

import numpy as np

#: Words a worker remembers; when full it starts again, so its memory is bounded.
REMEMBERED = 600_000
_ENCODERS: dict = {}


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer and what is known about it.

    ``white_free``: white space only separates, so the ids of a text are those of its words one
    after the other. True of a tokenizer that drops white space before it merges and never looks
    over it, as ``word_bpe_49k.json``; leave it False where that is not certain.
    """

    path: str
    white_free: bool = False

    def version(self) -> str:
        """A digest of the file: counts made with another file are never taken for its own."""
        with open(self.path, "rb") as file:
            return hashlib.sha256(file.read()).hexdigest()


def encoder(file: TokenizerFile) -> Encoder:
    """This process's encoder for the file; it lives as long as the worker."""
    if file not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


#: Steps of a tokenizer that cut a word into pieces, each merged alone and in lower case.
_FOLDS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pieces of words made of characters whose lower case and composition need no table.
_PLAIN = re.compile("[!-~ß-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")


def _byte_names() -> dict[int, str]:
    """Byte-level tokenizers write bytes as printable characters; the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as the file's library gives them, without added special tokens."""

    def __init__(self, file: TokenizerFile):
        self.file = file
        self.known: dict[bytes, bytes] = {}
        self._merge = None
        if file.path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=file.path)
            self._batch = lambda texts: model.encode(texts, num_threads=1)
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(file.path)
        self._batch = lambda texts: [
            e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)
        ]
        with open(file.path, encoding="utf-8") as described:
            parts = json.load(described)
        folds = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        split = [
            (p["type"], p.get("pattern", {}).get("Regex"))
            for p in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        ]
        if folds == _FOLDS and split == [("Split", _SPLIT), ("ByteLevel", None)]:
            self._merge = library.model.tokenize
            self._names = _byte_names()

    def batch(self, texts: list[str]) -> list[list[int]]:
        return self._batch(texts)

    def _plain(self, word: bytes) -> bytes | None:
        """Ids of a word of plain characters; None if it holds others."""
        text = word.decode("utf-8")
        if not word.isascii():
            text = text.lower()
        if not _PLAIN.fullmatch(text):
            return None
        pieces = _PIECES.findall(text)
        if len(pieces) == 1:
            return self._merged(text)
        out = []
        for piece in pieces:
            key = piece.encode("utf-8")
            ids = self.known.get(key)
            if ids is None:
                ids = self.known[key] = self._merged(piece)
            out.append(ids)
        return b"".join(out)

    def _merged(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self._names.__getitem__, piece.encode("utf-8")))
        return array("I", [t.id for t in self._merge(piece)]).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        rest = []
        for word in {w for w in words if w not in known}:
            ids = None if self._merge is None else self._plain(word)
            if ids is None:
                rest.append(word)
            else:
                known[word] = ids
        for i in range(0, len(rest), 1024):
            some = rest[i : i + 1024]
            for w, ids in zip(some, self._batch([w.decode("utf-8") for w in some]), strict=True):
                known[w] = array("I", ids).tobytes()

    def _pieces(self, text: bytes):
        """The ids of each word of a text."""
        # Special tokens are spelled in one case, so a text that may hold one keeps its letters.
        fold = self._merge is not None and b"<|" not in text
        words = (text.lower() if fold and text.isascii() else text).split()
        if fold and not text.isascii():
            # A letter and its mark may compose in one case only, so such words keep their letters.
            words = [w.lower() if w.isascii() else w for w in words]
        if not fold and self._merge is not None:
            texts = [w.decode("utf-8") for w in words]
            return [np.array(i, "<u4").tobytes() for i in self._batch(texts)]
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(words)
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:  # what was remembered has just been given up
            self._learn(words)
            return list(map(self.known.__getitem__, words))

    def count(self, text: bytes) -> int:
        if not self.file.white_free:
            return len(self._batch([text.decode("utf-8")])[0])
        return sum(map(len, self._pieces(text))) // 4

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.file.white_free:
            return np.array(self._batch([text.decode("utf-8")])[0], "<u4").tobytes()
        return b"".join(self._pieces(text))
