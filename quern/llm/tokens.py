"""Token ids of whole texts by a public tokenizer's file.

The ids are the library's.  For the lower-casing word BPE its model sees each distinct word piece once per worker:
between white space, and between letters, digits and signs, that tokenizer's pieces don't influence each other, so
a text's ids are its words' ids in a row.  A text with a character outside the ranges whose classes are written
down here, and any other tokenizer, goes through the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
#: Words and pieces kept in a worker before a cache starts anew.
CACHE_WORDS, CACHE_PIECES = 300_000, 500_000

# NFC leaves these as they are, they lower-case within the set, and each one's class is known:
# ASCII without odd controls, Latin-1 signs and letters, Latin Extended-A without the dotted capital I, dashes, quotes.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-įı-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SIGNS = "¡-©«-±´¶-¸»¿×÷‐-‧"
_OUTSIDE = re.compile(f"[^\\t-\\r\\x20-\\x7e{_LETTERS}{_NUMBERS}{_SIGNS}]|<\\|")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def _byte_signs() -> list[str]:
    """The printable sign that byte-level BPE writes for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class _Pieces(dict):
    """Word piece -> its ids, as bytes of unsigned 32-bit integers (little-endian machines)."""

    def __init__(self, model) -> None:
        self.tokenize, self.signs = model.tokenize, _byte_signs()

    def __missing__(self, piece: str) -> bytes:
        signs = self.signs
        written = piece if piece.isascii() and piece.isalnum() else "".join([signs[b] for b in piece.encode()])
        ids = array("I", [t.id for t in self.tokenize(written)]).tobytes()
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = ids
        return ids


class _Words(dict):
    def __init__(self, pieces: _Pieces) -> None:
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        pieces = self.pieces
        ids = b"".join([pieces[p] for p in _PIECES.findall(word)])
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model = rules["model"]
        self.by_words = all(rules.get(k) == v for k, v in _RULES.items()) and not model.get("dropout") and not model.get("ignore_merges")
        self.words = _Words(_Pieces(self.library.model))

    def ids(self, text: str) -> np.ndarray:
        if self.by_words and not _OUTSIDE.search(text):
            return np.frombuffer(b"".join(map(self.words.__getitem__, text.lower().split())), dtype="<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = WORD_BPE) -> Encoder:
    """The worker's encoder for a file of the public tokenizers, or for a path."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name if "/" in name else public_tokenizers.path(name))
    return _ENCODERS[name]


def documents_ids(texts: Iterable[bytes | None], name: str = WORD_BPE, end_id: int = 2) -> Iterable[np.ndarray]:
    """Each text's ids with the end id appended; a null text is empty, broken UTF-8 is replaced."""
    enc, end = encoder(name), np.array([end_id], dtype="<u4")
    for t in texts:
        yield np.concatenate([enc.ids((t or b"").decode("utf-8", "replace")), end])
