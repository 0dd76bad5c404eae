"""Operational questions: counts, depth, lag, breaker, recent documents, traces, throughput, tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions import text as fn
from haulmark.operators.ledger import outstanding

# Seconds of the throughput window, events fetched and passed on a tick, alert and target lag.
WINDOW_S, FETCH, EMIT, ALERT_S, TARGET_S = 10, 500, 200, 1800, 3600


def count_by_status(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def queue_depth(state: DataFrame) -> DataFrame:
    return state.where(outstanding()).groupBy("lane").agg(F.count("*").alias("n"))


def lag_seconds(state: DataFrame, now: Column) -> DataFrame:
    """Age of the oldest cdc row that isn't DONE; 0 where none has a time."""
    oldest = state.where((F.col("lane") == "cdc") & outstanding()).agg(F.min("source_created_at").alias("t"))
    return oldest.select(F.coalesce(fn.seconds_between(F.col("t"), now), F.lit(0.0)).alias("lag_seconds"))


def totals(files: DataFrame, state: DataFrame, document: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(files, "source").crossJoin(count(state, "ledger")).crossJoin(count(document, "document"))


def breaker_state(events: DataFrame) -> DataFrame:
    """By the latest of the two breaker stages; CLOSED before any."""
    last = events.where(F.col("stage").isin("BREAKER_OPEN", "BREAKER_CLOSED")).agg(F.max_by("stage", "id").alias("s"))
    return last.select(F.when(F.col("s") == "BREAKER_OPEN", "OPEN").otherwise("CLOSED").alias("breaker_state"))


def snapshot(files: DataFrame, state: DataFrame, document: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """One row with everything, status and depth as maps."""
    as_map = lambda df, key, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))
    return (
        as_map(count_by_status(state), "status", "by_status").crossJoin(as_map(queue_depth(state), "lane", "depth"))
        .crossJoin(lag_seconds(state, now)).crossJoin(totals(files, state, document)).crossJoin(breaker_state(events))
    )


def recent_documents(document: DataFrame, events: DataFrame, limit: int) -> DataFrame:
    """Newest first, with how long each took. The limit is taken before the join, and only its events are read on."""
    columns = ["source_id", "filename", "object_key", "byte_size", fn.preview(F.col("ocr_text")).alias("ocr_text"), "ocr_confidence", "ocr_page_count", "migrated_at"]
    newest = document.select(*columns).orderBy(F.desc("migrated_at"), "source_id").limit(limit)
    span = events.join(F.broadcast(newest.select("source_id")), "source_id", "left_semi").groupBy("source_id").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    out = newest.join(span, "source_id", "left").withColumn("duration_seconds", fn.seconds_between(F.col("a"), F.col("b")))
    return out.drop("a", "b").orderBy(F.desc("migrated_at"), "source_id")


def shaped(rows: DataFrame) -> DataFrame:
    """recent_documents as they are handed out: the id as text, numbers finite or their fallback."""
    number = lambda name, fallback: fn.to_finite_number(F.col(name), fallback)
    known = lambda name: F.when(F.col(name).isNotNull(), F.col(name).cast("double"))
    span = F.when(F.col("duration_seconds").isNotNull() & ~F.isnan("duration_seconds") & (F.abs("duration_seconds") < float("inf")), F.col("duration_seconds"))
    return rows.select(
        F.col("source_id").cast("string").alias("source_id"), "filename", "object_key", number("byte_size", 0).alias("byte_size"), "ocr_text",
        known("ocr_confidence").alias("ocr_confidence"), known("ocr_page_count").alias("ocr_page_count"), "migrated_at", span.alias("duration_seconds"),
    )


def trace(events: DataFrame) -> DataFrame:
    """Each source's history in order, stages repeated as they came."""
    order = Window.partitionBy("source_id").orderBy("id")
    return events.where("source_id is not null").select("source_id", F.row_number().over(order).alias("step"), "id", "stage", "lane", "detail", "created_at")


def tail(events: DataFrame, since: int, fetch: int = FETCH, emit: int = EMIT) -> DataFrame:
    """What one tick passes on; the next starts at its greatest id, so what is left over is only deferred."""
    return events.where(F.col("id") > since).orderBy("id").limit(fetch).orderBy("id").limit(emit)


def throughput(events: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """At each STORED event: its lane's events of the trailing window, a second.

    Lanes are few and hot, so the count is not a window over a lane. Seconds are counted first; an event then needs the
    whole seconds inside its window and the parts at either end, which differ by microseconds: rows are dealt by lane and
    stretch of time, each event to its own stretch and as context to the next."""
    micros = F.unix_micros("created_at")
    stretch = window_s * 1_000_000
    own = events.where("stage = 'STORED' and lane is not null").select("id", "lane", micros.alias("t"), F.floor(micros / stretch).alias("part"))
    both = own.withColumn("asks", F.lit(True)).union(own.select("id", "lane", "t", F.col("part") + 1, F.lit(False)))
    near = Window.partitionBy("lane", "part").orderBy("t").rangeBetween(-stretch, 0)
    counted = both.withColumn("n", F.count("*").over(near)).where("asks")
    return counted.select("id", "lane", (F.col("n") / window_s).alias("files_per_second"))


def captured(events: DataFrame) -> DataFrame:
    """How many sources stand in each column, by their latest stage."""
    latest = events.where("source_id is not null").groupBy("source_id").agg(F.max_by("stage", "id").alias("stage"))
    return latest.groupBy(fn.stage_column(F.col("stage")).alias("place")).agg(F.count("*").alias("n"))


def stage_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("stage", "lane").agg(F.count("*").alias("n"))
