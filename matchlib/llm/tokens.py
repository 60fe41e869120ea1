"""Encoding whole texts with a public tokenizer, inside Spark tasks."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import only_cache

_CHUNK = re.compile(r"\s*\S+|\s+")
_ODD_SPACE = re.compile(r"[^\S \n\t\r]")
_NOT_SIMPLE = re.compile(r"[ \n]{2}|[^\S \n]")
_ASCII_SPACE = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
#: A space, letters that have one normal form and one lower case, then signs that are no apostrophe.
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?*%$&#|()=\"/-]*)")
_ENCODERS: dict = {}


def _byte_signs() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Cache(dict):
    """A dict that makes what it misses, and starts anew beyond a bound."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian uint32 bytes.

    No pre-token of the two families of pre-tokenizer used here (byte-level
    words with one leading space; words without white space) runs from a
    visible character over to white space. So a text is the concatenation of
    its chunks "white space, then visible characters", and a chunk is encoded
    once per Python worker, as long as a bounded cache holds it. Chunks of
    plain letters and signs are cut by rule and go to the vocabulary's merges at
    once; all others, and texts with unusual white space or what may be a special
    token's string, take the tokenizer's whole way. Such strings become their ids,
    as the tokenizer has it; with special_as_text they are ordinary text.
    """

    def __init__(self, path: str, cache_entries: int = 450_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        # how the special tokens' strings begin
        self.special = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.drops_space = self.tokenizer.normalizer is not None
        self.signs = _byte_signs()
        self.pieces = _Cache(self._piece, cache_entries)
        self.chunks = _Cache(self._chunk, cache_entries)
        spaced = (lambda c: self._chunk(c)) if self.drops_space else (lambda c: self._chunk(c if c[:1] == "\n" else " " + c))
        self.spaced = _Cache(spaced, cache_entries)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """One pre-token."""
        signs = self.signs
        if piece.isascii() and piece != "\n":  # printable, but for the space before it
            mapped = piece.replace(" ", signs[32])
        else:
            mapped = "".join([signs[b] for b in piece.encode()])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if plain is None:
            return self._whole(chunk)
        lead, letters, marks = plain.groups()
        if not letters and not marks:
            return self._whole(chunk)
        if self.drops_space:
            letters, lead = letters.lower(), ""
        out = b""
        if lead == "\n":
            out, lead = self.pieces["\n"], ""
        if letters:
            out, lead = out + self.pieces[lead + letters], ""
        return out + self.pieces[lead + marks] if marks else out

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self._whole(text)
        if any(map(text.__contains__, _ASCII_SPACE)) if text.isascii() else _NOT_SIMPLE.search(text):
            if _ODD_SPACE.search(text):
                return self._whole(text)
            return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))
        if not text:
            return b""
        if self.drops_space:
            return b"".join(map(self.spaced.__getitem__, text.split()))
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.chunks[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches, path: str, text_column: str = "text", at_once: int = 256):
    """For Arrow batches: (batch, first row, ids of the rows from there) for at_once rows at a time. A null text is empty."""
    only_cache("ids", _ENCODERS.clear)
    enc = encoder(path)
    for batch in batches:
        column = batch.column(text_column)
        for i in range(0, batch.num_rows, at_once):
            yield batch, i, [enc.encode(t) if t else b"" for t in column.slice(i, at_once).to_pylist()]
