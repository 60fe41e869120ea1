"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word n-grams. Texts with equal sets form one class, which is
represented once. Classes that share a band of MinHash values are compared in
tiles: their MinHash values are compared some at a time, and a pair is dropped
as soon as the posterior probability that its similarity reaches the threshold
(uniform prior) falls below a tolerance. What is left joins classes to
candidate clusters; within each, in tiles again, the pairs that pass the same
pruning are verified on their whole n-gram sets. Each class gets its number of
links, and the tiles' spanning forests make the components.

A pair at the threshold escapes all bands with a probability of
``(1 - threshold**BAND_ROWS) ** BANDS`` = 5e-8 at 0.8.

Defined results: a text without words (null, empty, punctuation) links with
nothing; a text of fewer than n words is one n-gram; repeated rows are members
of one class, each a row of the result; class_id is the least doc_id of the
component, null if all are null; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, only_cache, written
from .components import components, stars
from .tiles import dealt, pair_chunks, whole_tiles
from .words import WORDS, mixed, ngrams

N = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
STEP = 16
BLOCK = 512
#: Of signatures alone.
CANDIDATE_BLOCK = 2048
_SALTS = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_XOR = (_SALTS[:HASHES] >> np.uint64(32)).astype(np.uint32)
_TIMES = (_SALTS[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(grams: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits of a set of n-grams."""
    x = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    low = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, ((x[i : i + 2048, None] ^ _XOR) * _TIMES).min(axis=0))
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number k of values compared: the least matches with which P(similarity >= threshold) is still at least tolerance, under a uniform prior."""
    out = {}
    for k in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= k:
            # P(J >= t | m of k) = P(Binomial(k + 1, t) <= m)
            total += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[k] = m
    return out


def survivors(signatures: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) that no step of the incremental comparison drops."""
    matches = np.zeros(len(a), dtype=np.int64)
    for k in range(0, HASHES, STEP):
        matches += (signatures[a, k : k + STEP] == signatures[b, k : k + STEP]).sum(axis=1)
        keep = matches >= least[k + STEP]
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


def fingerprints(docs: DataFrame, n: int = N) -> DataFrame:
    """Of docs(doc_id, text), written: doc_id, text_hash, set_id (16 bytes of the n-gram set; null without words) and signature."""

    def of(batches):
        only_cache("words", WORDS.clear)
        for batch in in_slices(batches, 256):
            ids, signatures = [], []
            for text in batch.column("text").to_pylist():
                grams = np.unique(ngrams(WORDS.of(text), n))
                ids.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                signatures.append(signature(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(ids, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "text_hash", "set_id", "signature"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return written(rows.mapInArrow(of, "doc_id long, text_hash long, set_id binary, signature binary"), "fingerprints")


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)


def candidate_links(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """u, v: spanning forests of the pairs of classes(set_id, signature) that share a band and outlive the pruning."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("signature", k * (2 * BAND_ROWS) + 1, F.lit(2 * BAND_ROWS))))
    keyed = classes.select("set_id", F.explode(bands).alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(shared, "band").join(classes.select("set_id", "signature"), "set_id")
    least = least_matches(threshold, tolerance)

    def link(batches):
        for table, tile, side in whole_tiles(batches):
            signatures, u, v = _signatures(table), [], []
            for a, b in pair_chunks(tile, side):
                a, b = survivors(signatures, a, b, least)
                u.append(a)
                v.append(b)
            yield from forest(table, u, v)

    return dealt(rows, "band", "n", "set_id", CANDIDATE_BLOCK).mapInArrow(link, "u binary, v binary").distinct()


def forest(table: pa.Table, u: list[np.ndarray], v: list[np.ndarray]):
    """Batches of (u, v), the links of each row with the least row it is joined to."""
    if not u:
        return
    label = stars(table.num_rows, np.concatenate(u), np.concatenate(v))
    mine = np.flatnonzero(label != np.arange(len(label)))
    ids = table.column("set_id").combine_chunks()
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine)), ids.take(pa.array(label[mine]))], names=["u", "v"])


def _verified(sets: list[np.ndarray], sizes: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (sorted by a) have at least the threshold, exactly."""
    out = np.zeros(len(a), dtype=bool)
    for i in np.unique(a):
        at = slice(*np.searchsorted(a, [i, i + 1]))
        mine = np.flatnonzero(np.minimum(sizes[b[at]], sizes[i]) >= threshold * np.maximum(sizes[b[at]], sizes[i]))
        if not len(mine):
            continue
        others = b[at][mine]
        n = sizes[others]
        grams = np.concatenate([sets[j] for j in others])
        place = np.minimum(np.searchsorted(sets[i], grams), sizes[i] - 1)
        common = np.add.reduceat(sets[i][place] == grams, np.cumsum(n) - n, dtype=np.int64)
        # integers on both sides: 0.8 is 4/5
        out[at.start + mine] = common * 10_000 >= round(threshold * 10_000) * (sizes[i] + n - common)
    return out


def verified_links(docs: DataFrame, members: DataFrame, n: int, threshold: float, tolerance: float) -> DataFrame:
    """Written: rows (set_id, links, u, v) of the tiles of members(set_id, doc_id, text_hash, copies, cluster, n): how many documents a class links with, or a link of the spanning forest."""
    least = least_matches(threshold, tolerance)
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"), "text")
    joined = members.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))).dropDuplicates(["doc_id", "text_hash"])

    def sets_of(batches):
        only_cache("words", WORDS.clear)
        for batch in in_slices(batches, 256):
            grams = [np.unique(ngrams(WORDS.of(t), n)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("set_id", "copies", "cluster", "n")), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array([signature(g).tobytes() for g in grams], pa.binary())], names=["set_id", "copies", "cluster", "n", "grams", "signature"])

    rows = joined.select("set_id", "copies", "cluster", "n", "text").mapInArrow(sets_of, "set_id binary, copies long, cluster binary, n long, grams binary, signature binary")

    def verify(batches):
        for table, tile, side in whole_tiles(batches, 512):
            signatures, u, v = _signatures(table), [], []
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            copies = table.column("copies").to_numpy()
            links = np.zeros(len(sets), dtype=np.int64)
            for a, b in pair_chunks(tile, side):
                a, b = survivors(signatures, a, b, least)
                ok = _verified(sets, sizes, a, b, threshold)
                a, b = a[ok], b[ok]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                u.append(a)
                v.append(b)
            mine = np.flatnonzero(links)
            none = pa.nulls(len(mine), pa.binary())
            yield pa.RecordBatch.from_arrays([table.column("set_id").combine_chunks().take(pa.array(mine)), pa.array(links[mine]), none, none], names=["set_id", "links", "u", "v"])
            for x in forest(table, u, v):
                yield pa.RecordBatch.from_arrays([pa.nulls(x.num_rows, pa.binary()), pa.nulls(x.num_rows, pa.int64()), *x.columns], names=["set_id", "links", "u", "v"])

    tiled = dealt(rows, "cluster", "n", "set_id", BLOCK)
    return written(tiled.mapInArrow(verify, "set_id binary, links long, u binary, v binary"), "verified")


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, text_hash, class_id (the least doc_id that links lead to) and n_links (other documents with at least the threshold, copies included)."""
    prints = fingerprints(docs, n)
    known = prints.where("set_id is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = written(known.groupBy("set_id").agg(F.count("*").alias("copies"), first, F.first("signature").alias("signature")).select("set_id", "copies", "first.doc_id", "first.text_hash", "signature"), "classes")
    clusters = written(components(candidate_links(classes, threshold, tolerance)).select(F.col("node").alias("set_id"), F.col("component").alias("cluster")), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    members = clusters.join(sizes, "cluster").join(classes.drop("signature"), "set_id")
    found = verified_links(docs, members, n, threshold, tolerance)

    links = found.where("set_id is not null").groupBy("set_id").agg(F.sum("links").alias("links"))
    joined = components(found.where("u is not null").select("u", "v")).select(F.col("node").alias("set_id"), "component")
    whole = classes.select("set_id", "copies", "doc_id").join(links, "set_id", "left").join(joined, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    ids = whole.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    per_class = whole.join(ids, "component").select("set_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    in_class = prints.select("doc_id", "text_hash", "set_id").join(per_class, "set_id", "left")
    alone = F.col("set_id").isNull()
    return in_class.select("doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that with the least doc_id; of repeated rows, one. Documents without words all stay."""
    found = written(jaccard_join(docs).select("doc_id", "text_hash", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("first")), "classified")
    # rows that go, and rows that are there several times; the texts are shuffled once
    marked = found.groupBy("doc_id", "text_hash").agg(F.bool_or(~F.col("first")).alias("gone"), F.count("*").alias("n")).where("gone or n > 1").hint("merge").alias("g")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.text_hash") == F.col("g.text_hash"))
    kept = rows.join(marked, same, "left").where("not coalesce(gone, false)").select("row", "r.doc_id", "r.text_hash", "n")
    once = kept.where("n > 1").dropDuplicates(["doc_id", "text_hash"])
    return kept.where("n is null").unionByName(once).select("row.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


OP8_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {N} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {N - 1}], ' ') END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k * 10 >= 8 * (x.n + y.n - k)
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach
)
SELECT doc_id, min(reach) AS class_id, (SELECT count(*) FROM l WHERE l.a = r.doc_id) AS n_links FROM r GROUP BY doc_id
"""
