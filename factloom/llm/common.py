"""Shared helpers: scratch tables in the cluster's shared folder and skew-proof joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest Arrow batch handed to a Python worker, whatever the length of the texts in it.
ARROW_BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a private one for a local session only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("a cluster must name its shared folder in spark.checkpoint.dir")
        local = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote; nothing that reads them may run later."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/factloom-" in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def arrow_limits(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def fixed_width(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a binary column without nulls, all of one length, as a matrix over its buffer."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32, n + 1, column.offset * (8 if pa.types.is_large_binary(column.type) else 4))
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


_resident: list[tuple] = []


def resident(key: tuple, make: Callable[[], object]) -> object:
    """The one large object that this Python worker keeps between tasks; asking for another key frees the one before.

    Workers outlive operators, so tables kept in modules would pile up over the stages of a pipeline.
    """
    if not _resident or _resident[0][0] != key:
        _resident.clear()
        _resident.append((key, make()))
    return _resident[0][1]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives freed memory back to the system when a partition ends; idle workers stay small."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: A key with more than 1/HOT_PARTS of all rows is hot, so at most HOT_PARTS keys can be.
HOT_PARTS = 128


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left", least: int = 1000) -> DataFrame:
    """Join many ``rows`` to the one ``lookup`` row of their key, whatever the skew of ``key``.

    ``lookup`` must hold each key at most once. Keys with more than ``1/HOT_PARTS`` of the rows (and more than
    ``least`` rows) are hot; there are at most ``HOT_PARTS`` of them, so their lookup rows are broadcast, and only
    the other rows, of which no key has many, are shuffled. ``rows`` is read twice and should be slim or written.
    A null key matches nothing.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    total = rows.count()
    hot = counts.where(F.col("count") > max(least, total // HOT_PARTS)).select(F.col(key).alias("_hot"))
    hot_keys = [r[0] for r in hot.collect()]  # at most HOT_PARTS values
    if not hot_keys:
        return rows.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot_keys), F.lit(False))
    few = F.broadcast(lookup.where(F.col(key).isin(hot_keys)))
    cold = rows.where(~is_hot).join(lookup, key, how)
    return cold.unionByName(rows.where(is_hot).join(few, key, how))
