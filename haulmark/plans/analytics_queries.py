"""Operational questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.functions import text as fn
from haulmark.operators import analytics as an
from haulmark.plans.registry import query
from haulmark.plans.views import sql
from haulmark.sources import tables as t
from haulmark.sources.tables import AS_OF


@query("count_by_status", sql("SELECT status, count(*) AS n FROM state GROUP BY status", "state"))
def count_by_status(spark, d):
    return an.count_by_status(t.state(spark, d))


@query("queue_depth_by_lane", sql("SELECT lane, count(*) AS n FROM state WHERE status <> 'DONE' GROUP BY lane", "state"))
def queue_depth(spark, d):
    return an.queue_depth(t.state(spark, d))


@query("sla_lag_seconds", sql(f"SELECT coalesce(({AS_OF} - min(created_s))::DOUBLE, 0) AS lag_seconds FROM state WHERE lane = 'cdc' AND status <> 'DONE'", "state"))
def sla_lag(spark, d):
    return an.lag_seconds(t.state(spark, d), t.as_of())


@query("totals", sql("SELECT (SELECT count(*) FROM files) AS source, (SELECT count(*) FROM state) AS ledger, (SELECT count(*) FROM document) AS document", "files", "state", "document"))
def totals(spark, d):
    return an.totals(t.files(spark, d), t.state(spark, d), t.document(spark, d))


@query("breaker_state", sql("SELECT coalesce((SELECT CASE stage WHEN 'BREAKER_OPEN' THEN 'OPEN' ELSE 'CLOSED' END FROM mevents WHERE stage LIKE 'BREAKER%' ORDER BY id DESC LIMIT 1), 'CLOSED') AS breaker_state", "mevents"))
def breaker_state(spark, d):
    return an.breaker_state(t.migration_events(spark, d))


@query(
    "stats_snapshot",
    sql(
        f"""SELECT (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM state GROUP BY 1)) AS by_status,
  (SELECT string_agg(lane || '=' || n, ',' ORDER BY lane) FROM (SELECT lane, count(*) AS n FROM state WHERE status <> 'DONE' GROUP BY 1)) AS depth,
  (SELECT coalesce(({AS_OF} - min(created_s))::DOUBLE, 0) FROM state WHERE lane = 'cdc' AND status <> 'DONE') AS lag_seconds,
  (SELECT count(*) FROM files) AS source, (SELECT count(*) FROM state) AS ledger, (SELECT count(*) FROM document) AS document,
  coalesce((SELECT CASE stage WHEN 'BREAKER_OPEN' THEN 'OPEN' ELSE 'CLOSED' END FROM mevents WHERE stage LIKE 'BREAKER%' ORDER BY id DESC LIMIT 1), 'CLOSED') AS breaker_state""",
        "files", "state", "document", "mevents",
    ),
)
def stats_snapshot(spark, d):
    one = an.snapshot(t.files(spark, d), t.state(spark, d), t.document(spark, d), t.migration_events(spark, d), t.as_of())
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return one.withColumns({"by_status": text("by_status"), "depth": text("depth")})


@query(
    "recent_documents",
    sql(
        """WITH newest AS (SELECT * FROM document ORDER BY migrated_s DESC, source_id LIMIT 50),
span AS (SELECT source_id, (max(t) - min(t)) / 1e6 AS duration_seconds FROM mevents WHERE source_id IS NOT NULL GROUP BY source_id)
SELECT n.source_id, filename, object_key, byte_size, left(ocr_text, 200) AS ocr_text, ocr_confidence::DOUBLE AS ocr_confidence, ocr_page_count, migrated_s, duration_seconds
FROM newest n LEFT JOIN span USING (source_id)""",
        "document", "mevents",
    ),
)
def recent_documents(spark, d):
    rows = an.recent_documents(t.document(spark, d), t.migration_events(spark, d), 50)
    return rows.withColumns({"migrated_s": F.unix_seconds("migrated_at"), "ocr_confidence": F.col("ocr_confidence").cast("double")}).drop("migrated_at")


@query("trace", sql("SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY id)::INTEGER AS step, id, stage, lane, detail, t FROM mevents WHERE source_id IS NOT NULL", "mevents"))
def trace(spark, d):
    return an.trace(t.migration_events(spark, d)).withColumn("t", F.unix_micros("created_at")).drop("created_at")


@query("event_tail", sql("SELECT id, source_id, stage, lane, detail, t FROM (SELECT * FROM mevents WHERE id > 0 ORDER BY id LIMIT 500) ORDER BY id LIMIT 200", "mevents"))
def event_tail(spark, d):
    return an.tail(t.migration_events(spark, d), 0).withColumn("t", F.unix_micros("created_at")).drop("created_at")


@query(
    "throughput_rolling",
    sql("SELECT id, lane, count(*) OVER (PARTITION BY lane ORDER BY t RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) / 10.0 AS files_per_second FROM mevents WHERE stage = 'STORED' AND lane IS NOT NULL", "mevents"),
)
def throughput(spark, d):
    return an.throughput(t.migration_events(spark, d))


@query("captured_by_column", sql("""SELECT CASE stage WHEN 'CDC_CAPTURED' THEN 'captured' WHEN 'QUEUED' THEN 'queued' WHEN 'CLAIMED' THEN 'claimed' WHEN 'OCR_DONE' THEN 'ocr' WHEN 'STORED' THEN 'stored' END AS place, count(*) AS n
FROM (SELECT arg_max(stage, id) AS stage FROM mevents WHERE source_id IS NOT NULL GROUP BY source_id) GROUP BY 1""", "mevents"))
def captured(spark, d):
    return an.captured(t.migration_events(spark, d))


@query("stage_counts", sql("SELECT stage, lane, count(*) AS n FROM mevents GROUP BY ALL", "mevents"))
def stage_counts(spark, d):
    return an.stage_counts(t.migration_events(spark, d))


@query(
    "gauge_state",
    sql("""WITH g AS (SELECT event_id, value * 10 AS lag, greatest(3600 * 1.15::DOUBLE, value * 10 * 1.05::DOUBLE, 1) AS scale FROM events)
SELECT event_id, CASE WHEN lag >= 3600 THEN 'red' WHEN lag >= 1800 THEN 'amber' ELSE 'calm' END AS state,
  round(least(100, lag / scale * 100), 6) AS fill_pct, round(least(100, 1800::DOUBLE / scale * 100), 6) AS alert_pct, round(least(100, 3600::DOUBLE / scale * 100), 6) AS target_pct FROM g"""),
)
def gauge_state(spark, d):
    state, *pct = fn.gauge(F.col("value") * 10, an.ALERT_S, an.TARGET_S)
    names = ["fill_pct", "alert_pct", "target_pct"]
    return t.table(spark, d, "events").select("event_id", state, *(F.round(p, 6).alias(n) for p, n in zip(pct, names, strict=True)))


_ONE = "round(({})::DECIMAL(24,6), 1)::DECIMAL(24,1)::VARCHAR"
_DURATION = f"""CASE WHEN v IS NULL OR v < 0 THEN 'unknown' WHEN v < 1 THEN floor(v * 1000 + 0.5)::BIGINT || 'ms' WHEN v < 60 THEN {_ONE.format("v")} || 's'
  ELSE floor(v / 60)::BIGINT || 'm ' || floor(v - floor(v / 60) * 60 + 0.5)::BIGINT || 's' END"""


@query(
    "format_helpers",
    sql(f"""WITH e AS (SELECT event_id, value AS v, greatest(0, floor(coalesce(value * 37, 0) + 0.5))::BIGINT AS s, floor(value * 3000)::BIGINT AS b FROM events)
SELECT event_id, {_DURATION} AS duration,
  CASE WHEN s < 60 THEN s || 's' WHEN s // 60 < 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS seconds,
  CASE WHEN b IS NULL THEN 'unknown size' WHEN b < 1024 THEN b || ' B' WHEN b / 1024.0::DOUBLE < 1024 THEN {_ONE.format("b / 1024::DOUBLE")} || ' KB' ELSE {_ONE.format("b / 1024::DOUBLE / 1024")} || ' MB' END AS bytes FROM e"""),
)
def format_helpers(spark, d):
    v = F.col("value")
    size = F.floor(v * 3000).cast("long")
    return t.table(spark, d, "events").select("event_id", fn.format_duration(v).alias("duration"), fn.format_seconds(v * 37).alias("seconds"), fn.format_bytes(size).alias("bytes"))


@query(
    "indicators",
    sql("""WITH m AS (SELECT event_id, ['healthy', 'slow', 'rate_limited', 'erroring', 'down', 'unknown'][(event_id % 6 + 1)::INTEGER] AS mode FROM events)
SELECT event_id, mode, CASE WHEN mode IN ('slow', 'rate_limited') THEN 'amber' WHEN mode IN ('erroring', 'down') THEN 'red' WHEN mode = 'healthy' THEN 'calm' END AS colour FROM m"""),
)
def indicators(spark, d):
    modes = F.array(*map(F.lit, ["healthy", "slow", "rate_limited", "erroring", "down", "unknown"]))
    rows = t.table(spark, d, "events").select("event_id", F.element_at(modes, (F.col("event_id") % 6 + 1).cast("int")).alias("mode"))
    return rows.withColumn("colour", fn.vendor_colour(F.col("mode")))


@query(
    "recent_shaped",
    sql(
        """WITH newest AS (SELECT * FROM document ORDER BY migrated_s DESC, source_id LIMIT 50),
span AS (SELECT source_id, (max(t) - min(t)) / 1e6 AS duration_seconds FROM mevents WHERE source_id IS NOT NULL GROUP BY source_id)
SELECT n.source_id::VARCHAR AS source_id, filename, object_key, byte_size::DOUBLE AS byte_size, left(ocr_text, 200) AS ocr_text, ocr_confidence::DOUBLE AS ocr_confidence,
  ocr_page_count::DOUBLE AS ocr_page_count, migrated_s, duration_seconds FROM newest n LEFT JOIN span USING (source_id)""",
        "document", "mevents",
    ),
)
def recent_shaped(spark, d):
    rows = an.shaped(an.recent_documents(t.document(spark, d), t.migration_events(spark, d), 50))
    return rows.withColumn("migrated_s", F.unix_seconds("migrated_at")).drop("migrated_at")
