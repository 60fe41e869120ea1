"""Reading inputs and cutting lineage in the folder that a cluster shares."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: in local mode a temporary folder of the session, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def new_dir(spark: SparkSession, label: str) -> str:
    """The URI of a folder not used before, in the shared folder."""
    base = shared_dir(spark)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return f"{base}/{label}-{uuid.uuid4().hex}"


def written_to(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """written(df, label), and where it stands."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs no more than a re-read."""
    return written_to(df, label)[0]


def removed(path: str) -> None:
    """Removes a table of written_to that nothing reads any more."""
    fs, at = pafs.FileSystem.from_uri(path)
    fs.delete_dir(at)


def with_fields(df: DataFrame, more: str) -> StructType:
    """df's schema and more, a schema in DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def in_slices(batches: Iterable, rows: int) -> Iterator:
    """Arrow batches in slices of at most rows rows, so that few of their texts are Python strings at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_HELD: dict[str, Callable[[], None]] = {}


def only_cache(name: str, clear: Callable[[], None]) -> None:
    """Called by a task that uses a cache of its Python worker: the caches of other operators, which the worker has kept from tasks before, are emptied, so that a worker holds one of them at a time, and the system gets back what no object needs."""
    others = [x for x in _HELD if x != name]
    for other in others:
        _HELD.pop(other)()
    _HELD[name] = clear
    if others:
        gc.collect()  # encoders hold themselves by their caches
    give_back()


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_key(rows: DataFrame, values: DataFrame, key: str, n_rows: int, parts: int = 1000) -> DataFrame:
    """rows joined with values, which has a row for each key and in n (dropped) how many of the n_rows rows have it.

    Keys with more than a share 1/parts of the rows are fewer than parts: their
    values are broadcast. So no task of the join that is left gets more than such a
    share of the rows from one key, however hot a key is.
    """
    hot = F.col("n") > n_rows // parts
    left = F.broadcast(values.where(hot).drop("n").select(key, F.struct(*(c for c in values.columns if c not in (key, "n"))).alias("_hot")))
    marked = rows.join(left, key, "left")
    found = marked.where("_hot is not null").select(*rows.columns, "_hot.*")
    return found.unionByName(marked.where("_hot is null").drop("_hot").join(values.where(~hot).drop("n"), key))
