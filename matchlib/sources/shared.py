"""Tables in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A folder not used before, below spark.checkpoint.dir. Where that is unset: in local mode a temporary folder, on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what a write has shuffled leaves the disks as soon as the write is done. Else it stays until the driver collects its garbage, and the shuffles of all writes before add up."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet and read again by all that branches from it; what was shuffled for it is dropped."""
    path = scratch(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a part, where parts follow the rows, and rows up to which they needn't.
PART_ROWS, FEW = 250_000, 2_000_000


def dealt(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """rows, n of them, dealt by key into as many parts as hold some PART_ROWS each, however well they compress: what a task sorts or holds doesn't grow with the rows. Without n they are counted; few rows stay as they are. Parts are no fewer than those of other shuffles, else a join would shuffle again."""
    n = rows.count() if n is None else n
    if n <= FEW:
        return rows
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // PART_ROWS)), key)
