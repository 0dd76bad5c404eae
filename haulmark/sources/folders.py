"""The folder that all executors see, and what is staged there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, as in tests, a local session gets an own folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/haulmark-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir() or folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/haulmark-{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def remove_since(spark: SparkSession, mark: int, keep: tuple[str, ...] = ()) -> None:
    """Removes what was made after mark() told how much there was, but for the folders to keep."""
    made = _made.get(spark.sparkContext.applicationId, [])
    _remove(spark, [p for p in made[mark:] if p not in keep])
    made[mark:] = [p for p in made[mark:] if p in keep]


def mark(spark: SparkSession) -> int:
    return len(_made.get(spark.sparkContext.applicationId, []))


def remove_staged(spark: SparkSession) -> int:
    """Removes every folder that this driver has had made so far; returns how many there were. Results of operators read from
    them, so call it once those have been written or are no longer needed."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    _remove(spark, paths)
    return len(paths)
