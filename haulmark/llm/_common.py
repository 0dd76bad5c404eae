"""What the operators share: the shared folder, staged tables, Arrow batch sizes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.sources.folders import mark, new_folder, remove_since, remove_staged, shared_dir

__all__ = ["frugal", "give_back", "kept", "mark", "new_folder", "remove_since", "remove_staged", "shared_dir", "small_batches", "staged", "staged_at", "table", "text_or_empty"]

#: Of one Arrow batch; a row with more is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and what Python computed
    is not computed again. Survives lost executors, unlike a local checkpoint. remove_staged() takes such tables away."""
    return staged_at(df, label)[0]


def staged_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The staged table and its folder."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bounds the bytes of an Arrow batch, so that one of long texts still fits a Python worker. A frame that is run later is
    planned by the session's setting of that time, so the bound stays; it is only ever lowered."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > size:
        spark.conf.set(name, str(size))


_kept: dict[tuple, object] = {}


def kept(make: Callable, *args):
    """make(*args), made once per Python worker. What another maker made goes: workers outlive the stages of a pipeline, and one
    stage's memos would fill the memory of the next."""
    if (make, *args) not in _kept:
        for key in [k for k in _kept if k[0] is not make]:
            del _kept[key]
        _kept[make, *args] = make(*args)
    return _kept[make, *args]


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system; workers live on between tasks, beside the JVM's own needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for mapInArrow that gives memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
