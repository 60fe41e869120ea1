"""Near-duplicate embeddings by int8 tile products with quantisation error bounds.

Vectors are compared only with vectors of an equal, non-null label. Equal
vectors of a label are one node. Nodes of a label are dealt into tiles; in a
tile unit vectors are rounded to int8 and multiplied. For x = s_x q_x + e_x the
product of two unit vectors differs from ``s_x s_y q_x.q_y`` by at most
``|e_y| + |e_x| (1 + |e_y|)``, so only pairs whose int8 product reaches the
threshold less that bound are recomputed, in double precision from the vectors
as given. A tile returns a count for each row and a spanning forest.

Work grows with the square of a label's distinct vectors, spread over tiles.

Defined results: a vector that is null, empty, zero or holds a null, NaN or
infinity, or whose label is null, links with nothing and is its own component;
vectors of unequal lengths never link; equal vectors link with one another (if
the threshold is at most 1); rows with a repeated vec_id count as so many
vectors; a null vec_id is never a component's id unless all its are null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, written
from .components import components, stars
from .tiles import dealt, whole_tiles

THRESHOLD = 0.98
BLOCK = 2048
#: Vectors of equal label and components, by the least vec_id.
NODE = "struct<none:boolean,vec_id:long,hash:binary>"


def nodes_of(vectors: DataFrame) -> DataFrame:
    """Of vectors(vec_id, label, embedding), written: vec_id, hash (16 bytes of label and vector; null if it links with nothing), grp (16 bytes of label and length) and vector (float64, little-endian)."""

    def of(batches):
        for batch in batches:
            nodes, groups, data = [], [], []
            for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist()):
                v = None
                if label is not None and values and None not in values:
                    v = np.array(values, dtype="<f8") + 0.0  # no negative zero
                    if not (np.isfinite(v).all() and v.any()):
                        v = None
                key = f"{label}/{0 if v is None else len(v)}/".encode()
                nodes.append(None if v is None else hashlib.blake2b(key + v.tobytes(), digest_size=16).digest())
                groups.append(None if v is None else hashlib.blake2b(key, digest_size=16).digest())
                data.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(x, pa.binary()) for x in (nodes, groups, data))], names=["vec_id", "hash", "grp", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return written(rows.mapInArrow(of, "vec_id long, hash binary, grp binary, vector binary"), "vectors")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 values, the scale of each, and the norm of each one's error."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - scale[:, None] * q) ** 2).sum(axis=1))
    return q, scale, error


def tile_links(vectors: np.ndarray, rows: range, others: range, threshold: float, at_once: int = 512):
    """(a, b) row numbers of the pairs with cosine >= threshold, a of rows, b of others; a < b where these are the same range."""
    # by a power of two, which changes no digit, so that squares neither overflow nor vanish
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    q, scale, error = quantised(vectors / norms[:, None])
    # float32 holds sums of d products of int8 exactly up to 2**24
    exact = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = np.ascontiguousarray(q[others.start : others.stop].astype(exact).T)
    same = rows == others
    for i in range(rows.start, rows.stop, at_once):
        mine = slice(i, min(i + at_once, rows.stop))
        product = (q[mine].astype(exact) @ right) * scale[mine, None] * scale[None, others.start : others.stop]
        bound = error[None, others.start : others.stop] + error[mine, None] * (1 + error[None, others.start : others.stop]) + 1e-6
        a, b = np.nonzero(product >= threshold - bound)
        a, b = a + i, b + others.start
        if same:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 1 << 18):
            x, y = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
            cosine = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norms[x] * norms[y])
            ok = cosine >= threshold
            yield x[ok], y[ok]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of vectors(vec_id, label, embedding): vec_id, n_links and component_id."""
    known = nodes_of(vectors)
    # nodes are ordered by their least vec_id, so that a component's least node has its id
    least = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "hash")).alias("node")
    nodes = written(known.where("hash is not null").groupBy("hash", "grp").agg(F.count("*").alias("copies"), least, F.first("vector").alias("vector")), "nodes")
    n = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"), F.count("*").alias("size"))
    rows = by_key(nodes.drop("hash"), sizes, "grp", n["n"])

    def compare(batches):
        for table, tile, side in whole_tiles(batches):
            ids, copies = table.column("node").combine_chunks(), table.column("copies").to_numpy()
            raw = table.column("vector").to_pylist()
            ends = np.flatnonzero(np.diff(tile, append=-1)) + 1
            for start, stop in zip(np.concatenate([[0], ends[:-1]]), ends):
                n = int(stop - start)
                twos = int((side[start:stop] == 2).sum())
                if n < 2 or (side[start] and twos in (0, n)):
                    continue
                part = np.frombuffer(b"".join(raw[start:stop]), dtype="<f8").reshape(n, -1)
                left = range(n - twos)
                found = list(tile_links(part, left, range(n - twos, n) if twos else left, threshold))
                a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
                links = np.bincount(a, copies[start + b], n).astype(np.int64) + np.bincount(b, copies[start + a], n).astype(np.int64)
                label = stars(n, a, b)
                mine = np.flatnonzero(links)
                if len(mine):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(start + mine)), pa.array(links[mine]), ids.take(pa.array(start + label[mine]))], names=["node", "links", "least"])

    found = written(dealt(rows, "grp", "size", "node", BLOCK).mapInArrow(compare, f"node {NODE}, links long, least {NODE}"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    whole = nodes.select("hash", "node", F.col("copies").alias("n")).join(links, "node", "left").join(joined, "node", "left")
    copies = F.col("n") - 1 if threshold <= 1 else F.lit(0)
    per_node = whole.select("hash", "n", F.coalesce("component", "node")["vec_id"].alias("component_id"), (F.coalesce("links", F.lit(0)) + copies).alias("n_links"))
    out = by_key(known.where("hash is not null").select("vec_id", "hash"), per_node, "hash", n["rows"]).select("vec_id", "n_links", "component_id")
    return out.unionByName(known.where("hash is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP6_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), ok AS (
  SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM e
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), r(vec_id, reach) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach
), c AS (
  SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
