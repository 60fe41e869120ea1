"""All pairs within groups, by tiles of bounded size.

A group of n rows is dealt into about n/T blocks by a hash of its nodes, and
each pair of blocks is a tile. A task meets one tile of at most about 2T rows
at a time, whatever the size of the group, and returns what it has found per
row or as a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, group: str, size: str, node: str, rows_per_block: int) -> DataFrame:
    """rows with tile (a number for a pair of blocks of the group) and side (1 or 2; 0 in a tile of one block), dealt out by tile and sorted."""
    blocks = F.ceil(F.col(size) / rows_per_block)
    other = rows.withColumn("_block", F.pmod(F.xxhash64(node), blocks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    tiled = other.withColumn("tile", F.xxhash64(group, low, high)).withColumn("side", F.when(F.col("_block") < F.col("_other"), 1).when(F.col("_block") > F.col("_other"), 2).otherwise(0))
    return tiled.drop("_block", "_other").repartition("tile").sortWithinPartitions("tile", group, "side")


def whole_tiles(batches: Iterator[pa.RecordBatch], at_least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, tile numbers from 0, sides) with whole tiles only, from batches sorted by tile."""
    held: list[pa.RecordBatch] = []
    n = 0

    def out(table: pa.Table):
        tile = table.column("tile").to_numpy()
        number = np.concatenate([[0], np.cumsum(tile[1:] != tile[:-1])]) if len(tile) else np.empty(0, np.int64)
        return table, number.astype(np.int64), table.column("side").to_numpy()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < at_least:
            continue
        tile = batch.column("tile").to_numpy()
        starts = np.flatnonzero(tile[1:] != tile[:-1]) + 1
        if len(starts):
            cut = int(starts[-1])
            yield out(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held, n = [batch.slice(cut)], batch.num_rows - cut
        elif len(held) > 1 and held[-2].column("tile")[-1].as_py() != tile[0]:
            yield out(pa.Table.from_batches(held[:-1]))
            held, n = [batch], batch.num_rows
    if n:
        yield out(pa.Table.from_batches(held))


def pair_chunks(tile: np.ndarray, side: np.ndarray, at_once: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of row numbers of each tile: of both sides in a tile that has two, else of any two rows; about at_once at a time."""
    n = len(tile)
    rows = np.arange(n)
    start = np.searchsorted(tile, tile, side="left")
    stop = np.searchsorted(tile, tile, side="right")
    twos = np.concatenate([[0], np.cumsum(side == 2)])
    # rows of a tile are sorted by side; a block may be empty, then there is nothing to compare
    first = np.where(side == 0, rows + 1, np.where(side == 1, stop - (twos[stop] - twos[start]), stop))
    many = stop - first
    ends = np.cumsum(many)
    i = 0
    while i < n:
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + at_once, side="right")))
        m = many[i:j]
        a = np.repeat(rows[i:j], m)
        if len(a):
            within = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
            yield a, first[a] + within
        i = j
