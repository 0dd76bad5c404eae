"""Change envelopes: parsing, routing, and the fold of a whole log into the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.schemas import ENVELOPE, OPS


def parse(log: DataFrame) -> DataFrame:
    """log with envelope, id, version and created_at.

    The envelope is exploded from an array of one: a filter on what is in it, such as its route, then stays above and doesn't
    parse the text anew for each part of its condition."""
    parsed = F.from_json("value", ENVELOPE, {"columnNameOfCorruptRecord": "_corrupt_record"})
    e = log.select("*", F.explode_outer(F.array(parsed)).alias("envelope"))
    op = F.col("envelope.op")
    return e.withColumns({
        "op": op, "id": F.when(op == "d", F.col("envelope.before.id")).otherwise(F.col("envelope.after.id")),
        "version": F.coalesce("envelope.ts_ms", F.lit(0)).cast("long"), "created_at": F.timestamp_millis("envelope.after.created_at"),
    })


def route() -> Column:
    """Where a parsed record goes: tombstone, malformed, no_id, unknown_op (captured all the same) or its op."""
    return (
        F.when(F.col("value").isNull(), "tombstone").when(F.col("envelope").isNull() | F.col("envelope._corrupt_record").isNotNull(), "malformed").when(F.col("id").isNull(), "no_id")
        .when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "unknown_op").otherwise(F.col("op"))
    )


def routed(log: DataFrame) -> DataFrame:
    return parse(log).withColumn("route", route())


def changes(log: DataFrame) -> DataFrame:
    """(seq, id, op, version, created_at) of records that change something."""
    return routed(log).where(F.col("route").isin(*OPS)).select("seq", "id", "op", "version", "created_at")


def fold(rows: DataFrame) -> DataFrame:
    """changes -> the ledger after all of them, sources present and the vendor well: (source_id, lane, status, attempts,
    source_version, last_seq).

    An id whose last change is a deletion has no row. Else only changes after its last deletion count: each update is an
    attempt, and so is a first create or read; the version is the last update's. Two aggregations with partial sums and
    one join, which AQE can split for a hot id, rather than a window over each id's history."""
    gone = rows.where("op = 'd'").groupBy("id").agg(F.max("seq").alias("gone"))
    live = rows.join(gone, "id", "left").where("gone is null or seq > gone")
    update = F.col("op") == "u"
    folded = live.groupBy("id").agg(
        F.count(F.when(update, 1)).alias("updates"), F.min_by("op", "seq").alias("first"), F.max_by(F.when(update, F.col("version")), F.when(update, F.col("seq"))).alias("version"), F.max("seq").alias("last_seq"),
    )
    attempts = F.col("updates") + F.when(F.col("first").isin("c", "r"), 1).otherwise(0)
    return folded.select(
        F.col("id").alias("source_id"), F.lit("cdc").alias("lane"), F.lit("DONE").alias("status"), attempts.alias("attempts"), F.coalesce("version", F.lit(0)).alias("source_version"), "last_seq"
    )


def with_created_at(rows: DataFrame, files: DataFrame) -> DataFrame:
    """created_at from the envelope, else from the source row, else null."""
    own = files.select("id", F.col("created_at").alias("own"))
    return rows.join(own, "id", "left").withColumn("created_at", F.coalesce("created_at", "own")).drop("own")
