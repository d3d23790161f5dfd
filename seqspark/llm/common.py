"""What the training-data operators share: tables, stored intermediates, Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqspark.session import scratch_dir

# Texts are turned into Python objects in slices of at most this many rows and (after the
# first row) bytes, so that a batch of long texts does not double in memory.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: str) -> Column:
    """crc32 of the key as text mod 3; 1 is held out. A null key counts as 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3, F.lit(0))


def sampled(df: DataFrame, columns: list[str], bound: int, salt: int) -> DataFrame:
    """At most ``bound`` distinct rows, those with the smallest hashes of ``columns``.

    Hashes alone are sorted (``bound`` from each partition); the rows are then picked by
    a broadcast of at most ``bound`` numbers.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*columns, F.lit(salt)))
    picked = stored(hashed.select("_hash").orderBy("_hash").limit(bound), "sample")
    return hashed.join(F.broadcast(picked), "_hash", "left_semi").dropDuplicates(["_hash"]).drop("_hash")


_KEPT: dict[str, object] = {}


def kept(name: str, make):
    """What an operator remembers in a worker process from task to task. Only the last one that
    asked has something there: a worker serves one operator after the other."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Give back what other operators remember in this worker process."""
    _KEPT.clear()


def trim() -> None:
    """Hand freed memory back to the system. The allocator would keep it for this worker, idle or
    not, while others of the executor need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.pythonapi, "malloc_trim"):  # glibc
        ctypes.pythonapi.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over the batches of a task, in a worker that gives back before it what others
    remember and after it what it freed."""

    def task(batches):
        release()
        yield from run(batches)
        trim()

    return task


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch bounded by rows and by bytes of ``column``."""
    at, rows = 0, batch.num_rows
    while at < rows:
        n, size = 0, 0
        data = batch.column(column)
        while at + n < rows and n < SLICE_ROWS:
            value = data[at + n]
            size += len(value.as_buffer()) if value.is_valid else 0
            if n and size > SLICE_BYTES:
                break
            n += 1
        yield batch.slice(at, n)
        at += n
