"""The trie of conversations' prefixes, with a count-min screen before the shuffle.

A node is a distinct sequence of first turns; the conversations that begin with it
are its members. A turn is reduced to a digest of its role and text in the scan, so
texts are never shuffled. A prefix's digest is a polynomial in its turns' digests
modulo a prime of 255 bits, hence a monoid: those of two parts give that of the
whole. So

* a conversation may lie in several tasks. Turns are sorted over all tasks by a
  range partitioning; each task numbers its turns and takes their prefix digests as
  if conversations began with it, and what precedes a task's first conversation is
  added afterwards (two rows for each task come to the driver for that);
* conversations are rebuilt from digests: the first turns of one and the later turns
  of another.

Then

1. every task counts its prefixes in a count-min sketch; the sketches are added.
   A prefix whose estimate is one has one member, as estimates are never too low:
   its row is final where it stands, up to the name of its parent.
2. Only prefixes that may be shared are shuffled, and grouped by their digests.
   What turns out to have one member joins the others.
3. Sums over subtrees by doubling: after round i each node has the sum over those
   less than 2^i levels below; it is sent to the ancestor 2^i levels above. So as many rounds
   as the depth of the deepest shared node has binary digits, and only shared nodes
   take part; a tail counts as one leaf of its parent and saves nothing.
4. Members that end at a shared node are sorted by a range partitioning over node
   and id and written in chunks of text, so that the task that hashes a node's
   list, which is sequential, reads a row for each 64 KB of it.

The sketch has ``ROWS`` rows of at least 8 cells for each prefix, but at most
``MOST_CELLS`` cells in all, one byte each. Beyond that more prefixes are shuffled
than need be; results are the same. Digests of different prefixes would have to
agree in 255 bits to be taken for one.

Defined results: null role or text is empty; rows without a conv_id belong to no
conversation; turns with equal numbers come in the order of their digests (SHA-256
of the role's length, a colon, role and text), null numbers first; repeated rows are
turns of their own; without conversations there is no node; other columns are not
read. conv_id % 100 has the sign of conv_id.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

PRIME = (1 << 255) - 19
BASE = int.from_bytes(hashlib.sha256(b"prefixes of conversations").digest(), "big") % PRIME
ROOT = bytes(32)
ROWS = 3
MOST_CELLS = 1 << 26
_BLOCK = 1 << 15
_CHUNK = 1 << 16
#: A rebuilt conversation takes at most so many turns of another, less one.
HEADS = 6
GROUP = 100
NOTHING = hashlib.sha256(b"").hexdigest()


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text) and n_chars (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars"))


def numbered(turns: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int, int]]]:
    """Each turn of digested() with its number k (from 1) and the digests of the turns up to it and before it, as counted within its task (part); and for tasks that begin inside a conversation (conv_id, turns before, their digest)."""

    def run(batches):
        part = TaskContext.get().partitionId()
        conv, k, h, first, held = None, 0, 0, None, None

        def out(rows):
            conv_id, number, node, before, n_chars, edge = zip(*rows)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(rows), pa.int32()), "conv_id": pa.array(conv_id, pa.int64()), "k": pa.array(number, pa.int64()),
                "node": pa.array(node, pa.binary()), "parent": pa.array(before, pa.binary()), "n_chars": pa.array(n_chars, pa.int64()), "edge": pa.array(edge, pa.bool_()),
            })

        for batch in batches:
            rows = []
            for c, x, n in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "digest", "n_chars"))):
                if held:  # the last turn of the task's first conversation
                    rows.append((*held, c != conv and held[0] == first))
                if c != conv:
                    conv, k, h = c, 0, 0
                first = c if first is None else first
                before, k = h, k + 1
                h = (h * BASE + int.from_bytes(x, "big") + 1) % PRIME
                held = (c, k, h.to_bytes(32, "big"), before.to_bytes(32, "big"), n)
            if rows:
                yield out(rows)
        if held:
            yield out([(*held, True)])

    order = (F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"))
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.mapInArrow(run, "part int, conv_id long, k long, node binary, parent binary, n_chars long, edge boolean"), "turns")
    carried: dict[int, tuple[int, int, int]] = {}
    conv, count, total = None, 0, 0
    for part, c, k, node in rows.where("edge").select("part", "conv_id", "k", "node").orderBy("part", "conv_id").toLocalIterator():
        h = int.from_bytes(node, "big")
        if c == conv:
            carried[part] = (c, count, total)
            count, total = count + k, (total * pow(BASE, k, PRIME) + h) % PRIME
        else:
            conv, count, total = c, k, h
    return rows.drop("edge"), carried


def with_carried(rows: DataFrame, carried: dict[int, tuple[int, int, int]]) -> DataFrame:
    """rows of numbered() as counted over all tasks: conv_id, k, node, parent, n_chars."""
    if not carried:
        return rows.drop("part")

    def run(batches):
        for batch in batches:
            k, node, parent = (batch.column(c).to_pylist() for c in ("k", "node", "parent"))
            for i, (part, conv) in enumerate(zip(batch.column("part").to_pylist(), batch.column("conv_id").to_pylist())):
                c, count, total = carried.get(part, (None, 0, 0))
                if c == conv:
                    shift = total * pow(BASE, k[i] - 1, PRIME)
                    parent[i] = ((int.from_bytes(parent[i], "big") + shift) % PRIME).to_bytes(32, "big")
                    node[i] = ((int.from_bytes(node[i], "big") + shift * BASE) % PRIME).to_bytes(32, "big")
                    k[i] += count
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "k": pa.array(k, pa.int64()), "node": pa.array(node, pa.binary()), "parent": pa.array(parent, pa.binary()), "n_chars": batch.column("n_chars")})

    return rows.mapInArrow(run, "conv_id long, k long, node binary, parent binary, n_chars long")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, conversations) after each conversation c has the first h turns of c - c % 100 in place of its own first h, h = crc32(c) % 6. prefixes: conv_id, depth, node, parent, n_chars, total; conversations: conv_id, total."""
    head = F.when(F.col("k") < HEADS, F.struct("k", "node", "parent", "n_chars"))
    convs = own.groupBy("conv_id").agg(F.max("k").alias("n"), F.sort_array(F.collect_list(head)).alias("heads"))  # at most five heads
    convs = convs.withColumns({"drop": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("_heads"))
    taken = F.slice(F.coalesce("_heads", F.array().cast(convs.schema["heads"].dataType)), F.lit(1), F.col("drop").cast("int"))
    convs = convs.join(bases, "base", "left").withColumn("taken", taken)
    last = lambda c: F.when(F.size(c) > 0, F.element_at(c, -1)["node"]).otherwise(F.lit(ROOT))
    total = F.size("taken") + F.greatest(F.lit(0), F.col("n") - F.col("drop"))
    convs = written(convs.select("conv_id", "drop", "taken", total.cast("long").alias("total"), last(F.col("taken")).alias("to"), last(F.slice("heads", F.lit(1), F.col("drop").cast("int"))).alias("from")), "conversations")

    def moved(batches):
        for batch in batches:
            node, parent = [], []
            for k, old, new, x, y in zip(*(batch.column(c).to_pylist() for c in ("later", "from", "to", "node", "parent"))):
                shift = (int.from_bytes(new, "big") - int.from_bytes(old, "big")) * pow(BASE, k - 1, PRIME)
                parent.append(((int.from_bytes(y, "big") + shift) % PRIME).to_bytes(32, "big"))
                node.append(((int.from_bytes(x, "big") + shift * BASE) % PRIME).to_bytes(32, "big"))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("conv_id", "depth")} | {"node": pa.array(node, pa.binary()), "parent": pa.array(parent, pa.binary())} | {c: batch.column(c) for c in ("n_chars", "total")})

    schema = "conv_id long, depth long, node binary, parent binary, n_chars long, total long"
    begin = convs.select("conv_id", "total", F.explode("taken").alias("t")).select("conv_id", F.col("t.k").alias("depth"), "t.node", "t.parent", "t.n_chars", "total")
    later = own.where(f"k > crc32(cast(cast(conv_id as string) as binary)) % {HEADS}").join(convs, "conv_id")
    later = later.select("conv_id", (F.size("taken") + F.col("k") - F.col("drop")).alias("depth"), (F.col("k") - F.col("drop")).alias("later"), "from", "to", "node", "parent", "n_chars", "total")
    return written(begin.unionByName(later.mapInArrow(moved, schema)), "prefixes"), convs.select("conv_id", "total")


def cells_of(digests: pa.Array, width: int) -> np.ndarray:
    """The cells of digests, a row for each row of the sketch."""
    words = np.frombuffer(b"".join(digests.to_pylist()), dtype=">u8").reshape(-1, 4)
    return np.stack([r * width + (words[:, r + 1] & np.uint64(width - 1)).astype(np.int64) for r in range(ROWS)])


def sketched(prefixes: DataFrame, width: int) -> np.ndarray:
    """The count-min sketch of all prefixes; a cell counts up to two, which is all that is asked."""
    blocks = max(1, ROWS * width // _BLOCK)
    size = ROWS * width // blocks

    def count(batches):
        cells = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            if batch.num_rows:
                found, times = np.unique(cells_of(batch.column("node"), width), return_counts=True)
                cells[found] = np.minimum(2, cells[found] + np.minimum(times, 2))
        for b, part in enumerate(cells.reshape(blocks, size)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "cells": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def add(batches):
        at, cells = None, None
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                if b != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "cells": pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())})
                    at, cells = b, np.zeros(size, np.uint8)
                cells = np.minimum(2, cells + np.frombuffer(zlib.decompress(data), np.uint8))
        if at is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "cells": pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())})

    parts = prefixes.select("node").mapInArrow(count, "block int, cells binary").repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, cells binary")
    out = np.zeros((blocks, size), np.uint8)
    for row in parts.toLocalIterator():
        out[row["block"]] = np.frombuffer(zlib.decompress(row["cells"]), np.uint8)
    return out.reshape(-1)


def screened(prefixes: DataFrame, cells: np.ndarray) -> DataFrame:
    """prefixes with single and parent_single: whether the estimate of the prefix (of its parent) is one."""
    sketch = prefixes.sparkSession.sparkContext.broadcast(zlib.compress(cells.tobytes(), 1))
    width = len(cells) // ROWS

    def run(batches):
        known = np.frombuffer(zlib.decompress(sketch.value), np.uint8)
        for batch in batches:
            if batch.num_rows:
                one, above = (known[cells_of(batch.column(c), width)].min(axis=0) == 1 for c in ("node", "parent"))
                above &= np.array(batch.column("depth").to_numpy()) > 1  # the root is no tail
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one), pa.array(above)], names=[*batch.schema.names, "single", "parent_single"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema)
    return prefixes.mapInArrow(run, f"{schema}, single boolean, parent_single boolean")


def below(shared: DataFrame, paths: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """shared(node, conv_id, depth, sums) with the sums over each node's subtree; paths(conv_id, depth, node) has the ancestors."""
    step = 1
    while step < deepest:
        sent = shared.where(F.col("depth") > step).select("conv_id", (F.col("depth") - step).alias("depth"), *sums)
        got = sent.join(paths, ["conv_id", "depth"]).groupBy("node").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
        shared = shared.join(got, "node", "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}).drop(*(f"_{c}" for c in sums))
        shared, step = written(shared, "subtrees"), 2 * step
    return shared


def ends_digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256, the digest of its ends(node, conv_id): ids in ascending order, joined by commas."""

    def chunks(batches):
        part, seq = TaskContext.get().partitionId(), itertools.count()
        at, ids, size = None, [], 0

        def out():
            return pa.RecordBatch.from_pydict({"node": pa.array([at], pa.binary()), "part": pa.array([part], pa.int32()), "seq": pa.array([next(seq)], pa.int64()), "ids": pa.array([",".join(ids)], pa.string())})

        for batch in batches:
            for node, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if at is not None and (node != at or size >= _CHUNK):
                    yield out()
                    ids, size = [], 0
                at = node
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield out()

    def hashed(batches):
        at, state, found = None, None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), pa.string()))], names=["node", "ends_sha256"])

        for batch in batches:
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node != at:
                    if at is not None:
                        found.append((at, state.hexdigest()))
                    at, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(found) >= 1000:
                yield out()
                found = []
        if at is not None:
            found.append((at, state.hexdigest()))
        if found:
            yield out()

    parts = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(chunks, "node binary, part int, seq long, ids string")
    return parts.repartition("node").sortWithinPartitions("node", "part", "seq").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the rebuilt conversations' trie."""
    spark = conversations.sparkSession
    prefixes, convs = rebuilt(with_carried(*numbered(digested(conversations))))
    n = prefixes.count()
    width = min(1 << max(10, (8 * n).bit_length()), 1 << ((most_cells // ROWS).bit_length() - 1))
    flagged = written(screened(prefixes, sketched(prefixes, width)), "screened")

    maybe = flagged.where("not single")
    nodes = maybe.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"), F.max("total").alias("total")
    )
    nodes = written(nodes, "nodes")
    shared = nodes.where("n_convs > 1")
    alone = ["conv_id", "depth", "parent", "total"]
    tails = flagged.where("single").select(*alone, "parent_single").unionByName(nodes.where("n_convs = 1").select(*alone, F.lit(False).alias("parent_single")))

    child = shared.select("parent", F.lit(0).alias("tail")).unionByName(tails.where("not parent_single").select("parent", F.lit(1).alias("tail")))
    children = child.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("tail").alias("tails"))
    values = shared.join(children.withColumnRenamed("parent", "node"), "node", "left").fillna(0, ["n_children", "tails"])
    values = values.select("node", "parent", "conv_id", "depth", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("tails")).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    values = written(values, "shared")
    deepest = values.agg(F.max("depth")).first()[0] or 0
    values = below(values, maybe.select("conv_id", "depth", "node"), ["n_leaves", "saved_tokens"], deepest)

    # a parent's name: of few parents with many children by a broadcast, of the others by a join
    names = values.select(F.col("node").alias("parent"), F.col("conv_id").alias("_name"), "n_children")
    often = F.col("n_children") > n // 1000
    top = convs.agg(F.min("conv_id").alias("_top"), F.count("*").alias("_n_convs"))

    def named(rows: DataFrame) -> DataFrame:
        """rows(parent, conv_id, depth) with parent_conv_id; a parent that isn't shared has the row's own."""
        hot = F.broadcast(names.where(often).select("parent", F.col("_name").alias("_hot")))  # fewer than a thousand
        found = rows.join(hot, "parent", "left")
        rest = found.where("_hot is null and depth > 1").join(names.where(~often).select("parent", "_name"), "parent", "left").withColumn("parent_conv_id", F.coalesce("_name", "conv_id")).drop("_name")
        first = found.where("depth = 1").crossJoin(F.broadcast(top.select("_top"))).withColumnRenamed("_top", "parent_conv_id")  # one row
        hots = found.where("_hot is not null and depth > 1").withColumn("parent_conv_id", F.col("_hot"))
        return rest.unionByName(first).unionByName(hots).drop("_hot")

    ends = maybe.where("depth = total").select("node", "conv_id").unionByName(convs.where("total = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    digests = written(ends_digests(ends), "ends")
    digest: Column = F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = named(values).join(digests, "node", "left").select(*columns, digest)
    known = tails.where("parent_single").withColumn("parent_conv_id", F.col("conv_id")).unionByName(named(tails.where("not parent_single")))
    own = F.when(F.col("depth") == F.col("total"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING)
    outer = known.select("conv_id", "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("total")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), own.alias("ends_sha256"))

    firsts = values.where("depth = 1").select("n_leaves", "saved_tokens").unionByName(tails.where("depth = 1").select(F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
    sums = firsts.agg(F.count("*").alias("n_children"), F.greatest(F.lit(1), F.coalesce(F.sum("n_leaves"), F.lit(0))).cast("long").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).cast("long").alias("saved_tokens"))
    root = top.where("_n_convs > 0").crossJoin(sums).withColumn("node", F.lit(ROOT)).join(digests, "node", "left")
    root = root.select(F.col("_top").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("_n_convs").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", digest)
    return root.unionByName(inner).unionByName(outer)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = """
with recursive entry(i, v, k) as (
  select i, i, 0 from range(256) t(i)
  union all select i, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from entry where k < 8),
crc as (select list(v order by i) as t from entry where k = 8),
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as k
  from conversations where conv_id is not null),
ids as (select distinct conv_id from turns),
summed as (
  select conv_id, list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::int, 1))::bigint)),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])) as c from ids, crc),
convs as (select conv_id, xor(c, 4294967295) % 6 as h, conv_id - conv_id % 100 as base from summed),
rebuilt as (
  select c.conv_id, t.k as pos, t.role, t.text from convs c join turns t on t.conv_id = c.base and t.k <= c.h
  union all select c.conv_id, t.k as pos, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.k > c.h),
placed as (
  select conv_id, text, sha256(length(role) || ':' || role || text) as x, row_number() over (partition by conv_id order by pos) as depth, count(*) over (partition by conv_id) as total
  from rebuilt),
chained as (select conv_id, text, depth, total, string_agg(x, '') over (partition by conv_id order by depth) as path from placed),
member as (
  select conv_id, depth, total, sha256(path) as node, length(text) as n_chars from chained
  union all select c.conv_id, 0, (select count(*) from rebuilt r where r.conv_id = c.conv_id), '', 0 from convs c),
node as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(n_chars) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = total), '')) as ends_sha256
  from member group by node, depth),
edge as (
  select n.node, n.conv_id, n.depth, m.node as up, m.depth as up_depth from node n join member m on m.conv_id = n.conv_id and m.depth <= n.depth),
kids as (select up as node, count(*) as n_children from edge where up_depth = depth - 1 group by up),
tree as (
  select e.up as node, sum(n.saved) as saved_tokens, count(*) filter (k.node is null) as n_leaves
  from edge e join node n using (node) left join kids k using (node) group by e.up)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, t.n_leaves, t.saved_tokens::bigint as saved_tokens, n.ends_sha256
from node n left join kids k using (node) join tree t using (node)
left join edge e on e.node = n.node and e.up_depth = n.depth - 1 left join node p on p.node = e.up
"""
