"""Backfill plans: id ranges, batches in them, and the claims on ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Ids a range, ids a batch, seconds until a range claim expires.
RANGE_SIZE, BATCH_SIZE, RANGE_LEASE_S = 1000, 25, 300


def ranges(max_id: DataFrame, size: int = RANGE_SIZE) -> DataFrame:
    """(range_start, range_end): from 1 without gaps; the last may pass the largest id. None for a max_id under 1."""
    if size <= 0:
        raise ValueError("a range holds at least one id")
    last = max_id.first()["max_id"] or 0
    starts = max_id.sparkSession.range(1, max(1, last + 1), size).select(F.col("id").alias("range_start"))
    return starts.withColumn("range_end", F.col("range_start") + size - 1)


def batches(files: DataFrame, range_size: int = RANGE_SIZE, size: int = BATCH_SIZE) -> DataFrame:
    """(range_start, batch, lane, sourceIds): each range's ids in order, size at a time, the remainder last."""
    if size <= 0:
        raise ValueError("a batch holds at least one id")
    start = F.floor((F.col("id") - 1) / range_size) * range_size + 1
    in_range = Window.partitionBy("range_start").orderBy("id")
    numbered = files.where("id >= 1").select("id", start.alias("range_start")).withColumn("batch", F.floor((F.row_number().over(in_range) - 1) / size))
    grouped = numbered.groupBy("range_start", "batch").agg(F.array_sort(F.collect_list("id")).alias("sourceIds"))
    return grouped.select("range_start", "batch", F.lit("backfill").alias("lane"), "sourceIds")


def claim_next(checkpoints: DataFrame, now: Column) -> DataFrame:
    """The lowest PENDING range becomes CLAIMED; the others stay."""
    lowest = checkpoints.where("status = 'PENDING'").agg(F.min(F.struct("range_start", "range_end")).alias("next"))
    hit = F.struct("range_start", "range_end").eqNullSafe(F.col("next")) & F.col("next").isNotNull()
    joined = checkpoints.crossJoin(F.broadcast(lowest))
    return joined.select("range_start", "range_end", F.when(hit, "CLAIMED").otherwise(F.col("status")).alias("status"), F.when(hit, now).otherwise(F.col("claimed_at")).alias("claimed_at"))


def reap_expired(checkpoints: DataFrame, now: Column, lease_s: int = RANGE_LEASE_S) -> DataFrame:
    """CLAIMED ranges whose lease is over become PENDING again."""
    late = (F.col("status") == "CLAIMED") & (F.col("claimed_at") < now - F.expr(f"INTERVAL {lease_s} SECONDS"))
    return checkpoints.withColumns({"status": F.when(late, "PENDING").otherwise(F.col("status")), "claimed_at": F.when(~late, F.col("claimed_at"))})


def mark_range_done(checkpoints: DataFrame, done: DataFrame) -> DataFrame:
    keys = ["range_start", "range_end"]
    joined = checkpoints.join(done.select(*keys).distinct().withColumn("done", F.lit(True)), keys, "left")
    return joined.withColumn("status", F.when(F.col("done"), "DONE").otherwise(F.col("status"))).drop("done")


def messages(found: DataFrame) -> DataFrame:
    """batches as they are published: (key, value), keyed by the first id so that a batch's redeliveries stay in order."""
    return found.select(F.element_at("sourceIds", 1).cast("string").alias("key"), F.to_json(F.struct("lane", "sourceIds")).alias("value"))


def plan(checkpoints: DataFrame, max_id: DataFrame, size: int = RANGE_SIZE) -> DataFrame:
    """checkpoints with a PENDING row for each range that is new; known ones stay as they are."""
    keys = ["range_start", "range_end"]
    fresh = ranges(max_id, size).join(checkpoints.select(*keys), keys, "left_anti")
    return checkpoints.unionByName(fresh.withColumns({"status": F.lit("PENDING"), "claimed_at": F.lit(None).cast("timestamp")}))


def claim_all(checkpoints: DataFrame, now: Column) -> DataFrame:
    """Every PENDING range becomes CLAIMED: what claiming the next until there is none comes to, for a job that drains them
    all at once."""
    free = F.col("status") == "PENDING"
    return checkpoints.withColumns({"claimed_at": F.when(free, now).otherwise(F.col("claimed_at")), "status": F.when(free, "CLAIMED").otherwise(F.col("status"))})


def in_ranges(files: DataFrame, claimed: DataFrame, size: int = RANGE_SIZE) -> DataFrame:
    """Files whose id is in one of the ranges."""
    start = F.floor((F.col("id") - 1) / size) * size + 1
    return files.withColumn("range_start", start).join(claimed.select("range_start"), "range_start", "left_semi").drop("range_start")


def range_events(checkpoints: DataFrame) -> DataFrame:
    """One event a range, without a source id."""
    detail = F.to_json(F.struct(F.col("range_start").alias("rangeStart"), F.col("range_end").alias("rangeEnd")))
    return checkpoints.select(F.lit(None).cast("long").alias("source_id"), F.lit("QUEUED").alias("stage"), F.lit("backfill").alias("lane"), detail.alias("detail"))


def chunked(ids: list, size: int = BATCH_SIZE) -> list[list]:
    """A list in pieces, for callers at the driver."""
    if size <= 0:
        raise ValueError("a chunk holds at least one element")
    return [ids[i : i + size] for i in range(0, len(ids), size)]


def max_of(spark: SparkSession, value: int) -> DataFrame:
    return spark.range(1).select(F.lit(value).cast("long").alias("max_id"))
