"""Change envelopes: routing, folding, and flow control over an event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.operators import cdc
from haulmark.plans.registry import query
from haulmark.plans.views import sql
from haulmark.sources import tables as t
from haulmark.sources.folders import new_folder


@query("cdc_route", sql("SELECT seq, route FROM routed", "routed"))
def cdc_route(spark, d):
    return cdc.routed(t.change_log(spark, d)).select("seq", "route")


@query("cdc_bad_records", sql("SELECT seq, route FROM routed WHERE route IN ('tombstone', 'malformed', 'no_id', 'unknown_op')", "routed"))
def cdc_bad_records(spark, d):
    return cdc.routed(t.change_log(spark, d)).where("route in ('tombstone', 'malformed', 'no_id', 'unknown_op')").select("seq", "route")


@query(
    "cdc_ledger_fold",
    sql("""WITH g AS (SELECT *, max(CASE WHEN op = 'd' THEN seq END) OVER (PARTITION BY id) AS gone FROM changes)
SELECT id AS source_id, 'cdc' AS lane, 'DONE' AS status, count(*) FILTER (op = 'u') + CASE WHEN arg_min(op, seq) IN ('c', 'r') THEN 1 ELSE 0 END AS attempts,
  coalesce(arg_max(version, seq) FILTER (op = 'u'), 0) AS source_version, max(seq) AS last_seq FROM g WHERE gone IS NULL OR seq > gone GROUP BY id""", "changes"),
)
def cdc_ledger_fold(spark, d):
    return cdc.fold(cdc.changes(t.change_log(spark, d)))


@query("cdc_created_at_fallback", sql("SELECT seq, c.id, created_s FROM changes c LEFT JOIN files f ON f.id = c.id", "changes", "files"))
def cdc_created_at(spark, d):
    rows = cdc.with_created_at(cdc.changes(t.change_log(spark, d)), t.files(spark, d))
    return rows.select("seq", "id", F.unix_seconds("created_at").alias("created_s"))


@query(
    "cdc_stream_fold",
    sql("""WITH g AS (SELECT *, max(CASE WHEN op = 'd' THEN seq END) OVER (PARTITION BY id) AS gone FROM changes)
SELECT id AS source_id, 'cdc' AS lane, 'DONE' AS status, (count(*) FILTER (op = 'u') + CASE WHEN arg_min(op, seq) IN ('c', 'r') THEN 1 ELSE 0 END)::INTEGER AS attempts,
  coalesce(arg_max(version, seq) FILTER (op = 'u'), 0) AS source_version, max(seq) AS last_seq FROM g WHERE gone IS NULL OR seq > gone GROUP BY id""", "changes"),
)
def cdc_stream_fold(spark, d):
    """The same fold by the streaming job: the log comes in two parts, and the job is started anew for the second."""
    from haulmark.streaming import changes

    folder, log = new_folder(spark, "stream"), t.change_log(spark, d)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    for part in (log.where(F.col("seq") <= half), log.where(F.col("seq") > half)):
        part.write.mode("append").parquet(f"{folder}/log")
        changes.run(spark, f"{folder}/log", f"{folder}/out", files_a_batch=1_000)
    return changes.ledger_of(spark, f"{folder}/out")
