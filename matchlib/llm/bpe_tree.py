"""Byte-level BPE as a monoid: texts are encoded in halves, and halves are joined.

A text is cut at white space, where every split of it has a boundary; its pieces (the pattern's
matches) are independent of each other, and a long piece is cut anywhere, in
halves, down to leaves of a few bytes. Two encoded halves are joined by
re-encoding a window around the cut.

Why a join is exact. Merges go by rank, the leftmost of equal ones first. If a
row of tokens is the encoding of its bytes, no merge ever crosses one of its
boundaries, so two neighbours taken alone merge as they do within the row:
encode(a + b) = [a, b] for neighbours a, b. The other way round, let this hold
for all neighbours of a row of tokens, and suppose that some merge crosses a
boundary; take the first that does. Until then the two tokens beside it have
merged as they do alone, and the pair of lowest rank in the whole is that in the
two as well, so the two alone would merge across too. So a row of tokens is the
encoding if and only if all its neighbours are stable. Within either half they
are, and within a window just encoded they are; what is left are the pairs at the
window's two ends. An end that isn't stable doubles the window on its side.

Defined results: a null or empty text has no ids, and the digests are those of no
bytes; rows with a null doc_id and repeated rows are all kept; no special token is
known, so their strings are ordinary text; other columns are not read. A task
holds one Arrow batch; no row is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import _ASCII_SPACE, _NOT_SIMPLE, _Cache

IDS = "doc_id long, n_tokens long, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: A text longer than this is cut at white space that follows something visible.
BLOCK = 1 << 16
#: Bytes that are merged at once; longer pieces are cut in halves.
LEAF = 5
_CODERS: dict = {}


class Coder:
    """Encodes and decodes by a file of ranks: lines of a token's bytes in base 64 and its rank, which is its id. What it has encoded is kept up to a bound."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, block: int = BLOCK, cache_entries: int = 900_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lengths = np.array([len(t) for t in self.tokens])
        self.places = np.cumsum(self.lengths) - self.lengths
        # which two tokens make which
        self.single = [self.ranks.get(bytes([i]), -1) for i in range(256)]
        self.pairs = {self.ranks[t[:i]] << 32 | self.ranks[t[i:]]: rank for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.pieces_of = regex.compile(pattern).findall
        self.next_cut = regex.compile(r"\S(?=\s)").search
        self.chunks_of = regex.compile(r"\s*\S+|\s+").findall
        self.leaf, self.block = leaf, block
        self.stable = _Cache(lambda pair: self._merged(self.tokens[pair[0]] + self.tokens[pair[1]]) == list(pair), cache_entries)
        self.merged = _Cache(self._merged, cache_entries)
        self.known = _Cache(lambda piece: array("I", self.piece(piece.encode())).tobytes(), cache_entries)
        self.chunks = _Cache(self._chunk, cache_entries)
        self.spaced = _Cache(lambda c: self._chunk(c if c[:1] == "\n" else " " + c), cache_entries)

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.pieces_of(chunk)
        return b"".join(map(self.known.__getitem__, pieces)) if len(pieces) > 1 else array("I", self.piece(chunk.encode())).tobytes()

    def _merged(self, data: bytes) -> list[int]:
        """Some bytes' ids: the neighbours whose union has the lowest rank merge first, the leftmost of equals."""
        if len(data) > 256:
            return self._merged_long(data)
        merge, none = self.pairs.get, 1 << 62
        ids = [self.single[x] for x in data]
        ranks = [merge(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [low]
            del ranks[i]
            if i:
                ranks[i - 1] = merge(ids[i - 1] << 32 | low, none)
            if i < len(ranks):
                ranks[i] = merge(low << 32 | ids[i + 1], none)
        return ids

    def _merged_long(self, data: bytes) -> list[int]:
        """The same by a heap of (rank, place), for a window that has grown large."""
        merge = self.pairs.get
        ids = [self.single[x] for x in data]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(rank, i) for i in range(len(ids) - 1) if (rank := merge(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or merge(ids[i] << 32 | ids[j]) != rank:
                continue  # what stood here has merged since
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (more := merge(rank << 32 | ids[after[i]])) is not None:
                    heappush(heap, (more, i))
            if before[i] >= 0 and (more := merge(ids[before[i]] << 32 | rank)) is not None:
                heappush(heap, (more, before[i]))
        return [x for x in ids if x >= 0]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the bytes of left and right together; either is the encoding of its own."""
        if self.stable[left[-1], right[0]]:
            return left + right
        a, b = min(1, len(left)), min(1, len(right))
        while True:
            window = b"".join([self.tokens[t] for t in left[len(left) - a :] + right[:b]])
            middle = self.merged[window] if len(window) < 16 else self._merged(window)
            before = a == len(left) or self.stable[left[-a - 1], middle[0]]
            after = b == len(right) or self.stable[middle[-1], right[b]]
            if before and after:
                return left[: len(left) - a] + middle + right[b:]
            a, b = a if before else min(2 * a, len(left)), b if after else min(2 * b, len(right))

    def piece(self, data: bytes) -> list[int]:
        """One piece's ids: halves, joined. A piece that is a token is that, as in the library."""
        if data in self.ranks:
            return [self.ranks[data]]
        return self._halved(data)

    def _halved(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.merged[data]
        half = len(data) // 2
        return self.joined(self._halved(data[:half]), self._halved(data[half:]))

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian uint32. No match of the pattern runs from something visible to white space, so a cut there joins by concatenation: of blocks, and of chunks "white space, then something visible"."""
        if len(text) > self.block:
            cut = self.next_cut(text, len(text) // 2) or self.next_cut(text, len(text) // 4)
            if cut and cut.end() < len(text):
                return self.encode(text[: cut.end()]) + self.encode(text[cut.end() :])
        if not text:
            return b""
        if any(map(text.__contains__, _ASCII_SPACE)) if text.isascii() else _NOT_SIMPLE.search(text):
            return b"".join(map(self.chunks.__getitem__, self.chunks_of(text)))
        # one space or line end between any two words
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.chunks[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: those of its halves, one after the other."""
        if len(ids) > self.block:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.places[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def coder(path: str, pattern: str) -> Coder:
    """The coder of a rank file, one for each Python worker."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian uint32) of docs(doc_id, text)."""

    def run(batches):
        code = coder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [code.encode(t) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, IDS)


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows(doc_id, n_tokens, ids) with the bytes they stand for, as decoded."""

    def run(batches):
        code = coder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [code.decode(np.frombuffer(x, "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"{IDS}, decoded binary")


def coded_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of what they decode to; encoded and decoded in one pass."""

    def run(batches):
        code = coder(path, pattern)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [code.encode(t) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array(map(digest, ids), pa.string()), "decoded_sha256": pa.array([digest(code.decode(np.frombuffer(x, "<u4"))) for x in ids], pa.string()),
                })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGESTS)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over documents."""
    import public_tokenizers

    return coded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
