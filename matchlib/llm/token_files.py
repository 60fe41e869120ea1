"""Token ids in binary files: fixed-width bit packing with block offsets.

A shard file holds, in this order:

* the magic bytes ``TIDS0001``;
* blocks of ``BLOCK`` ids (the last one may be shorter), each id in as many
  bits as the largest id of the vocabulary needs, 64 ids to ``bits`` words of
  64 bits, little-endian;
* the doc table: for each document its id (int64) and the place of its first
  id in the shard (uint64), then one byte each that says whether the id is null;
* the byte offset of each block (uint64);
* a JSON footer, its length (uint32) and the magic bytes again.

Any range of ids is read by seeking to its blocks and unpacking them with
numpy; nothing before them is touched.

Defined results: a null text is empty; an empty text gives the end id alone;
the string of a special token in a text becomes its id; rows with a null doc_id
come first; repeated rows are all kept, those of one doc_id in the order of their
texts; an empty table gives no shard and no rows;
other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_dir
from .tokens import encoded, encoder

MAGIC = b"TIDS0001"
BLOCK = 1 << 16
MANIFEST = "shard string, part int, seq int, first_doc long, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def bits_for(vocab_size: int) -> int:
    """The least bits that hold every id below vocab_size."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits bits each; 64 ids fill a whole number of 64-bit words, and the rest is zeros."""
    rows = -(-len(ids) // 64)
    lanes = np.zeros(rows * 64, dtype=np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(rows, 64)
    words = np.zeros((rows, bits), dtype=np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of a packed block."""
    words = np.frombuffer(data, dtype="<u8").reshape(-1, bits)
    lanes = np.empty((len(words), 64), dtype=np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, lane] = value & mask
    return lanes.reshape(-1)[:n].astype("<u4")


class ShardWriter:
    """Writes one shard, under a name that no other attempt of its task has; which attempt counts is what Spark commits to the manifest."""

    def __init__(self, uri: str, bits: int):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri = uri
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.bits, self.at, self.n = bits, len(MAGIC), 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, dtype="<u4")
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            data = pack(ids[i : min(i + BLOCK, full)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        null = np.array([d is None for d in self.docs], dtype=np.uint8)
        footer = json.dumps({"bits": self.bits, "block": BLOCK, "n_ids": self.n, "n_docs": len(self.docs), "n_blocks": len(self.offsets), "tables_at": self.at}).encode()
        self.out.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes() + np.array(self.starts, dtype="<u8").tobytes() + null.tobytes() + np.array(self.offsets, dtype="<u8").tobytes())
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()


class ShardReader:
    """Random access to a shard."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no whole shard")
        (n,) = struct.unpack("<I", tail[:4])
        self.meta = m = json.loads(self.file.read_at(n, size - 12 - n))
        docs, blocks = m["n_docs"], m["n_blocks"]
        raw = self.file.read_at(docs * 17 + blocks * 8, m["tables_at"])
        self.docs = np.frombuffer(raw, "<i8", docs)
        self.starts = np.append(np.frombuffer(raw, "<u8", docs, docs * 8).astype(np.int64), m["n_ids"])
        self.null = np.frombuffer(raw, np.uint8, docs, docs * 16).astype(bool)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks, docs * 17).astype(np.int64), m["tables_at"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop, counted from the shard's first."""
        if stop <= start:
            return np.empty(0, dtype="<u4")
        block = self.meta["block"]
        first, last = start // block, (stop - 1) // block
        raw = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = [unpack(raw[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]], min(block, self.meta["n_ids"] - b * block), self.meta["bits"]) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * block : stop - first * block]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, ids_per_shard: int = 1 << 26) -> DataFrame:
    """Encodes docs(doc_id, text), each with end_id at its end, to shard files in ascending doc_id order. Returns the written manifest, a row for each shard; (part, seq) is the shards' order.

    A range partitioning by doc_id is the only shuffle; a task holds one batch
    of texts and one block of ids.
    """
    folder = folder or new_dir(docs.sparkSession, "token-files")

    def write(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        bits = bits_for(encoder(tokenizer).vocab_size)
        if end_id >> bits:
            raise ValueError(f"the end id {end_id} needs more than {bits} bits")
        end = np.array([end_id], dtype="<u4").tobytes()
        shard, seq = None, 0

        def closed():
            shard.close()
            row = {"shard": [shard.uri], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first_doc": pa.array(shard.docs[:1], pa.int64()), "n_docs": [len(shard.docs)], "n_ids": [shard.n]}
            return pa.RecordBatch.from_pydict(row)

        for batch, i, found in encoded(batches, tokenizer):
            for doc_id, ids in zip(batch.column("doc_id").slice(i, len(found)).to_pylist(), found):
                if shard is None:
                    shard = ShardWriter(f"{folder}/shards/{part:06d}-{seq:04d}-{attempt}.tids", bits)
                shard.add(doc_id, np.frombuffer(ids + end, dtype="<u4"))
                if shard.n >= ids_per_shard:
                    yield closed()
                    shard, seq = None, seq + 1
        if shard is not None:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, digest_only: bool = False) -> DataFrame:
    """The documents of the shards: doc_id, start (ids of all documents before it), n_tokens, and ids as little-endian uint32, or with digest_only their crc32 as ids_crc32."""
    order = Window.orderBy("part", "seq")  # a row for each shard, not for each document
    shards = manifest.withColumn("base", F.sum("n_ids").over(order) - F.col("n_ids")).select("shard", "base").repartition(max(1, manifest.count()), "shard")

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                shard = ShardReader(uri)
                i = 0
                while i < len(shard.docs):
                    # as many documents as fill some blocks, one at least
                    j = max(i + 1, int(np.searchsorted(shard.starts, shard.starts[i] + 16 * BLOCK, side="right")) - 1)
                    first = int(shard.starts[i])
                    raw = shard.ids(first, int(shard.starts[j])).tobytes()
                    at = (shard.starts[i : j + 1] - first) * 4
                    ids = [raw[at[k] : at[k + 1]] for k in range(j - i)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(shard.docs[i:j], pa.int64(), mask=shard.null[i:j]),
                        "start": pa.array(shard.starts[i:j] + base, pa.int64()),
                        "n_tokens": pa.array(np.diff(shard.starts[i : j + 1]), pa.int64()),
                        **({"ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())} if digest_only else {"ids": pa.array(ids, pa.binary())}),
                    })
                    i = j

    return shards.mapInArrow(read, ROWS.replace("ids binary", "ids_crc32 long") if digest_only else ROWS)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: doc_id, start, n_tokens and ids_crc32, from the files."""
    import public_tokenizers

    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(manifest, digest_only=True)
