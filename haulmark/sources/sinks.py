"""Writers: appends, versioned tables, objects, messages."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators.access import upsert_latest


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def events_for(ids: DataFrame, stage: str, lane: str | None, detail: str | None, now: Column) -> DataFrame:
    """One event an id. Its id is unique and rises with the run, not without gaps."""
    stamp = F.unix_micros(now) * 1024
    return ids.select(
        (stamp + F.monotonically_increasing_id() % 1024 + F.shiftright(F.monotonically_increasing_id(), 10)).alias("id"), "source_id", F.lit(stage).alias("stage"),
        F.lit(lane).cast("string").alias("lane"), F.lit(detail).cast("string").alias("detail"), now.alias("created_at"),
    )


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Versions:
    """A table as numbered folders: a write is a new folder, readers use the greatest that is complete. What MERGE does
    where a catalog offers it. The last KEPT complete ones stay, for readers that began earlier. Of two writers with the same
    number the second fails, as the folder is there."""

    KEPT = 3

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folders(self):
        """The file system, and number -> path of the complete versions and of all."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        paths = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        known = {int(p.getName().removeprefix("v")): p for p in paths}
        return fs, {n: p for n, p in known.items() if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}, known

    def _numbers(self) -> list[int]:
        return sorted(self._folders()[1])

    def read(self) -> DataFrame:
        numbers = self._numbers()
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{numbers[-1]}")

    def replace(self, rows: DataFrame) -> None:
        fs, done, known = self._folders()
        rows.write.parquet(f"{self.path}/v{max(known, default=-1) + 1}")
        for n in sorted(done)[: -self.KEPT + 1]:
            fs.delete(known[n], True)

    def upsert(self, rows: DataFrame, key: str, order: Column) -> None:
        self.replace(upsert_latest(self.read(), rows, key, order))


def put_objects(rows: DataFrame, put: Callable[[str, bytes], None]) -> None:
    """Every (object_key, bytes) through a client's put, on the executors; put overwrites, so retries do no harm."""

    def send(part: Iterable) -> None:
        for r in part:
            put(r.object_key, bytes(r.bytes))

    rows.select("object_key", "bytes").foreachPartition(send)


def delete_objects(keys: DataFrame, delete: Callable[[str], None]) -> None:
    keys.select("object_key").foreachPartition(lambda part: [delete(r.object_key) for r in part] and None)


def publish(rows: DataFrame, servers: str, topic: str, key: Column, value: Column) -> None:
    """To a topic, keyed so that one key's messages stay in order. Untested here: needs the connector."""
    rows.select(key.cast("string").alias("key"), value.alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
