"""Tokenizing with the tokenizers library, with a memory of the words met before.

A BPE tokenizer cuts a text into pre-tokens before it merges anything, and no merge crosses a pre-token.
So the ids of a text are the ids of its words put together, and a word met before need not be merged again.
Words made of Latin letters and ASCII marks go to the library's model directly; all other pieces, and all
texts with characters whose cutting rule depends on the context, go through the library's whole pipeline.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

from lakeops.llm.common import remembered

LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"
MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation and symbols but the apostrophe, which begins contractions
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
SPACES = " \t\n\r"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte that byte-level BPE vocabularies are written in."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


BYTE_LETTERS = _byte_letters()


class _Memo(dict):
    """Two generations: when one is full it becomes the old one, and words met again move on to the new one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids of a whole text as little-endian unsigned 32-bit integers.

    ``memo`` bounds the remembered words; texts come out the same whatever it is. Strings of special
    tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, memo: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        kind = _kind(json.loads(self.tokenizer.to_str()))
        self.lower = kind == "word"
        # A run of letters before marks or white space, marks between letters and white space, anything else up to white space.
        word, marks = f"[{LETTERS}]+(?![^{MARKS}{SPACES}])", f"(?<=[{LETTERS}])[{MARKS}]+(?=[{SPACES}]|$)"
        if kind == "byte":
            self.pieces = re.compile(f" ?{word}|{marks}|[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
            self.simple = re.compile(f" ?[{LETTERS}]+|[{MARKS}]+").fullmatch
        elif kind == "word":
            self.pieces = re.compile(f"{word}|{marks}|[^{SPACES}]+").findall
            self.simple = re.compile(f"[{LETTERS}]+|[{MARKS}]+").fullmatch
        else:
            self.pieces = None
        self.memo = _Memo(self._piece, memo)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if not self.simple(piece):
            return self.whole(piece)
        if self.lower:
            piece = piece.lower()
        spelled = piece if piece.isascii() and piece[0] != " " else "".join(map(BYTE_LETTERS.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if self.pieces is None or ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.encode(t), dtype="<u4") for t in texts]


def _kind(spec: dict) -> str | None:
    """Which cutting rule a tokenizer file has, of those whose pieces are known to be independent."""
    cut, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if (spec.get("model") or {}).get("type") != "BPE":
        return None
    if norm is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
        return "byte"
    steps = [s.get("type") for s in cut.get("pretokenizers", [])]
    norms = [s.get("type") for s in (norm or {}).get("normalizers", [])]
    if steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and cut["pretokenizers"][0].get("behavior") == "Removed":
        return "word"
    return None


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return remembered(("encoder", path), lambda: Encoder(path))


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
