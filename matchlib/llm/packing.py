"""Best-two-fit packing of tokenized documents into sequences of fixed capacity.

The packing is planned on the histogram of piece lengths, which has at most
``capacity`` rows however many pieces there are: a bin is filled greedily with
the longest lengths that fit, then its shortest piece is replaced by two
unpacked ones that fit the gap it leaves more tightly, if there are such. The
bin found is repeated as often as the counts allow, so that the plan is a short
list of (bin, times). Pieces find their places by their rank among the pieces
of their length; ranks come from counts by (part, length), so no length, however
common, is gathered in one task.

Defined results: a null or empty text is its end id alone; repeated rows and
repeated doc_ids are packed each for itself; an empty table gives no pieces; a
null doc_id is kept; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import with_fields, written
from .tokens import encoded, encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, local_rank long"


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, times)] that use up counts (length: pieces), by best-two-fit."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    plan = []

    def largest(limit: int, used: Counter) -> int:
        lo, hi = 0, len(lengths)
        while lo < hi:
            mid = (lo + hi) // 2
            if lengths[mid] <= limit:
                lo = mid + 1
            else:
                hi = mid
        while lo and left[lengths[lo - 1]] <= used[lengths[lo - 1]]:
            lo -= 1
        return lengths[lo - 1] if lo else 0

    def two(target: int, used: Counter) -> tuple[int, int]:
        """The two lengths with the largest sum up to target."""
        best, i, j = (0, 0), 0, len(lengths) - 1
        while i <= j:
            a, b = lengths[i], lengths[j]
            if left[b] <= used[b] or a + b > target:
                j -= 1
            elif left[a] <= used[a] or (i == j and left[a] - used[a] < 2):
                i += 1
            else:
                if a + b > sum(best):
                    best = (a, b)
                if a + b == target:
                    break
                i += 1
        return best

    while lengths:
        used: Counter = Counter()
        room = capacity
        while room and (n := largest(room, used)):
            used[n] += 1
            room -= n
        if room and used.total() > 1:
            small = min(used)
            used[small] -= 1
            a, b = two(room + small, used)
            if a + b > small:
                used[a] += 1
                used[b] += 1
                room += small - a - b
                while room and (n := largest(room, used)):
                    used[n] += 1
                    room -= n
            else:
                used[small] += 1
        used = +used
        times = min(left[k] // n for k, n in used.items())
        plan.append((sorted(used.elements(), reverse=True), times))
        for k, n in used.items():
            left[k] -= n * times
        lengths = [k for k in lengths if left[k]]
    return plan


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of docs(doc_id, text), each document with end_id at its end; written to the shared folder.

    Only a document longer than capacity is cut; its first piece takes the
    remainder. ids are little-endian, of 2 bytes if the vocabulary allows,
    else 4. (part, local_rank) numbers the pieces of one length within a task.
    """

    def cut(batches):
        part = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        kind = np.dtype("<u2" if max(encoder(tokenizer).vocab_size - 1, end_id) < 1 << 16 else "<u4")
        seen: Counter = Counter()
        for batch, i, found in encoded(batches, tokenizer):
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").slice(i, len(found)).to_pylist(), found):
                ids = np.frombuffer(raw + end, dtype="<u4").astype(kind)
                at, stop, piece = 0, len(ids) % capacity or capacity, 0
                while at < len(ids):
                    n = stop - at
                    rows.append((doc_id, piece, at, n, ids[at:stop].tobytes(), part, seen[n]))
                    seen[n] += 1
                    at, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids", "part", "local_rank"])

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES), "pieces")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces(part, local_rank, length, ...) with sequence_id and offset: sequences of at most capacity, without gaps from 0."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most capacity rows
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_bins(counts, capacity)

    # For each length: from which rank on which bin takes its pieces.
    taken: Counter = Counter()
    rules: dict[int, list[tuple[int, int, int, int]]] = {}
    first_sequence = 0
    for lengths, times in plan:
        at = 0
        for length, n in Counter(lengths).items():
            rules.setdefault(length, []).append((taken[length], n, first_sequence, at))
            taken[length] += n * times
            at += n * length
        first_sequence += times
    rules = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in rules.items()})

    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank")).drop("base")

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine = length == n
                r = rules.value[int(n)]
                rule = r[np.searchsorted(r[:, 0], rank[mine], side="right") - 1]
                bin_, slot = np.divmod(rank[mine] - rule[:, 0], rule[:, 1])
                sequence[mine] = rule[:, 2] + bin_
                offset[mine] = rule[:, 3] + slot * n
            yield batch.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return ranked.mapInArrow(place, with_fields(ranked, "sequence_id long, offset long")).drop("rank")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, doc_ids and ids (joined in the order of their offsets). packed has doc_id, ids, sequence_id and offset."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return whole.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def with_crc32(pieces: DataFrame) -> DataFrame:
    """ids_crc32, over ids as little-endian uint32, in the place of ids."""

    def digest(batches):
        for batch in batches:
            crc = []
            for ids, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist()):
                crc.append(zlib.crc32(np.frombuffer(ids, dtype=f"<u{len(ids) // n}").astype("<u4").tobytes()))
            yield batch.drop_columns(["ids"]).append_column("ids_crc32", pa.array(crc, pa.int64()))

    return pieces.mapInArrow(digest, with_fields(pieces.drop("ids"), "ids_crc32 long"))


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs, by the 50k byte-level vocabulary and end id 0."""
    import public_tokenizers

    pieces = tokenized_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, capacity)
    return pack(with_crc32(pieces), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
