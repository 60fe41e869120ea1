"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written_to


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node that the links a-b join it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node of it) for every node of links(u, v).

    Each round joins every node to the least node that it knows of; a node with
    very many links is a key that adaptive execution may split, since only minima
    are taken of it. Rounds grow with the logarithm of the size,
    and each is written, so that no lineage builds up. Links from a node to
    itself are ignored; an empty table has no components.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    links, path = written_to(links.where("u <> v").select(high, low).distinct(), "links")
    state = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state or not now["n"]:
            break
        state = now
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = path
        links, path = written_to(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        removed(before)
    return links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
