"""Events as a tail by id, as a stream, and throughput over sliding windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators import analytics
from haulmark.schemas import EVENT


class Tailer:
    """What comes after the greatest id passed on so far, in order of ids, a bounded number of rows a tick. What a tick leaves
    over comes with the next; an event with a smaller id that is written later is not seen, so ids must rise."""

    def __init__(self, events: Callable[[], DataFrame], since: int = 0, fetch: int = analytics.FETCH, emit: int = analytics.EMIT):
        self.events, self.mark, self.fetch, self.emit = events, since, fetch, emit

    def tick(self) -> list:
        rows = analytics.tail(self.events(), self.mark, self.fetch, self.emit).collect()
        self.mark = max([self.mark, *(r.id for r in rows)])
        return rows


def read_events(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """All that is new in a micro-batch, or so many files of it. Files come in order of their time of writing, which says
    nothing about the order of ids in different files."""
    reader = spark.readStream.schema(EVENT)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def follow(events: DataFrame, checkpoint: str, pass_on: Callable[[DataFrame, int], None]) -> None:
    """Every event once to pass_on, in order of ids within each micro-batch; the offset log remembers how far it came. Use
    Tailer where ids must rise from one call to the next."""
    events.writeStream.foreachBatch(lambda batch, n: pass_on(batch.orderBy("id"), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def throughput(events: DataFrame, window: str = "10 seconds", slide: str = "1 second", late: str = "1 minute") -> DataFrame:
    """(start, lane, files_per_second) of STORED events; windows close once the watermark passes them. Events that come in a
    later micro-batch and more than ``late`` behind the newest are not counted: take it as wide as writers may lag, and
    everything that is there in one micro-batch (read_events without a number of files)."""
    stored = events.where("stage = 'STORED' and lane is not null").withWatermark("created_at", late)
    counted = stored.groupBy(F.window("created_at", window, slide), "lane").agg(F.count("*").alias("n"))
    span = F.unix_seconds(F.col("window.end")) - F.unix_seconds(F.col("window.start"))
    return counted.select(F.col("window.start").alias("start"), "lane", (F.col("n") / span).alias("files_per_second"))
