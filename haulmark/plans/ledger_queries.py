"""Ledger transitions and enrichment outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.functions import text as fn
from haulmark.operators import enrich, ledger
from haulmark.plans.registry import query
from haulmark.plans.views import sql
from haulmark.sources import tables as t

_NOW = t.AS_OF
_CAN = f"(status IN ('PENDING', 'FAILED_RETRYABLE') OR (status IN ('IN_FLIGHT', 'OCR_DONE') AND updated_s < {_NOW} - 60))"
_CAP = "(status IN ('PENDING', 'FAILED_RETRYABLE') AND consecutive_failures >= 5)"
_COLUMNS = ["source_id", "lane", "status", "attempts", "consecutive_failures", "source_version", "checksum_sha256", "has_payload", "last_error", "updated_s"]


def _plain(state):
    return state.withColumns({"updated_s": F.unix_seconds("updated_at"), "has_payload": F.col("ocr_payload").isNotNull()}).select(*_COLUMNS)


def _asked(spark, d):
    """Every id of labels is asked for."""
    return t.table(spark, d, "labels").select(F.col("doc_id").alias("source_id")).distinct()


def _changed(guard: str, **new: str) -> str:
    """The state after a change of the asked rows that meet the guard."""
    new["updated_s"] = str(_NOW)
    out = ", ".join(f"CASE WHEN hit THEN {new[c]} ELSE {c} END AS {c}" if c in new else c for c in _COLUMNS)
    return sql(f"SELECT {out} FROM (SELECT *, coalesce(source_id IN (SELECT doc_id FROM labels) AND {guard}, false) AS hit FROM state)", "state")


@query("claimable_ids", sql(f"SELECT source_id FROM state WHERE {_CAN}", "state"))
def claimable_ids(spark, d):
    return t.state(spark, d).where(ledger.claimable(t.as_of())).select("source_id")


@query("exceeded_attempts", sql(f"SELECT source_id, last_error FROM state WHERE {_CAP}", "state"))
def exceeded_attempts(spark, d):
    return t.state(spark, d).where(ledger.at_cap()).select("source_id", "last_error")


@query("unresolved_ids", sql("SELECT source_id FROM state WHERE status NOT IN ('DONE', 'FAILED_PERMANENT')", "state"))
def unresolved_ids(spark, d):
    return t.state(spark, d).where(ledger.unresolved()).select("source_id")


@query("cached_ids", sql("SELECT source_id FROM state WHERE has_payload", "state"))
def cached_ids(spark, d):
    return t.state(spark, d).where("ocr_payload is not null").select("source_id")


@query("ledger_claim", _changed(_CAN, status="'IN_FLIGHT'", attempts="attempts + 1"))
def ledger_claim(spark, d):
    return _plain(ledger.claim(t.state(spark, d), _asked(spark, d), t.as_of()))


@query("ledger_condemn", _changed(_CAP, status="'FAILED_PERMANENT'"))
def ledger_condemn(spark, d):
    return _plain(ledger.condemn(t.state(spark, d), _asked(spark, d), t.as_of()))


@query("ledger_renew", _changed("status = 'IN_FLIGHT'"))
def ledger_renew(spark, d):
    return _plain(ledger.renew(t.state(spark, d), _asked(spark, d), t.as_of()))


@query("ledger_save_payload", _changed("true", status="'OCR_DONE'", consecutive_failures="0", has_payload="true"))
def ledger_save_payload(spark, d):
    files = t.files(spark, d).select(F.col("id").alias("source_id"), fn.ocr_payload(F.col("id"), F.col("content")).alias("payload"))
    return _plain(ledger.save_payload(t.state(spark, d), _asked(spark, d).join(files, "source_id"), t.as_of()))


@query("ledger_mark_done", _changed("true", status="'DONE'", consecutive_failures="0", checksum_sha256="sha1('sum' || source_id)"))
def ledger_mark_done(spark, d):
    ids = _asked(spark, d).withColumn("checksum", F.sha1(F.concat(F.lit("sum"), "source_id")))
    return _plain(ledger.mark_done(t.state(spark, d), ids, t.as_of()))


@query(
    "mark_failed",
    _changed(
        "true", status="CASE WHEN source_id % 4 = 0 THEN 'FAILED_PERMANENT' ELSE 'FAILED_RETRYABLE' END",
        consecutive_failures="CASE WHEN source_id % 4 IN (1, 2) THEN consecutive_failures + 1 ELSE consecutive_failures END", last_error="'failed ' || source_id",
    ),
)
def mark_failed(spark, d):
    i = F.col("source_id")
    ids = _asked(spark, d).select("source_id", (i % 4 == 0).alias("permanent"), (i % 4 < 3).alias("counts"), F.concat(F.lit("failed "), i).alias("error"))
    return _plain(ledger.mark_failed(t.state(spark, d), ids, t.as_of()))


@query(
    "reset_for_update",
    _changed(
        "true", status="'PENDING'", consecutive_failures="CASE WHEN source_id % 3 > 1 THEN 0 ELSE consecutive_failures END", source_version="source_version + source_id % 3 - 1",
        has_payload="false", last_error="NULL",
    ),
)
def reset_for_update(spark, d):
    i = F.col("source_id")
    return _plain(ledger.reset_for_update(t.state(spark, d), _asked(spark, d).withColumn("version", F.lit(1_700_000_000_000) + i + i % 3 - 1), t.as_of()))


@query("ledger_tombstone", sql(f"SELECT {', '.join(_COLUMNS)} FROM state WHERE source_id NOT IN (SELECT doc_id FROM labels)", "state"))
def ledger_tombstone(spark, d):
    return _plain(ledger.tombstone(t.state(spark, d), _asked(spark, d)))


@query(
    "seed_pending_insert_ignore",
    sql("SELECT user_id AS source_id, 'cdc' AS lane, 'PENDING' AS status, 0 AS attempts FROM (SELECT DISTINCT user_id + 500 AS user_id FROM events) WHERE user_id NOT IN (SELECT source_id FROM state WHERE lane = 'cdc')", "state"),
)
def seed_pending(spark, d):
    ids = t.table(spark, d, "events").select((F.col("user_id") + 500).alias("source_id"))
    return ledger.seed(t.state(spark, d).where("lane = 'cdc'"), ids, "cdc", t.as_of()).select("source_id", "lane", "status", "attempts")


@query("attempts_lookup", sql("SELECT source_id, coalesce(attempts, 0) AS attempts FROM (SELECT DISTINCT user_id * 20 AS source_id FROM events) LEFT JOIN state USING (source_id)", "state"))
def attempts_lookup(spark, d):
    return ledger.attempts_of(t.state(spark, d), t.table(spark, d, "events").select((F.col("user_id") * 20).alias("source_id")).distinct())


def _outcomes(spark, d):
    asked = t.table(spark, d, "labels").select(F.col("doc_id").alias("source_id"))
    asked = asked.union(asked.where("source_id % 10 = 0")).union(t.table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("source_id")))
    files = t.files(spark, d).where("id % 13 <> 0").withColumn("content", F.when(F.col("id") % 17 == 0, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("content")))
    return enrich.outcomes(asked, t.state(spark, d), files, ledger.claimable(t.as_of()), ledger.at_cap())


_OUTCOMES = f"""WITH asked AS (SELECT doc_id AS source_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 0 UNION ALL SELECT o_orderkey + 1 FROM orders),
once AS (SELECT source_id, count(*) AS n FROM asked GROUP BY 1),
v AS (SELECT once.source_id, n, CASE WHEN coalesce({_CAP}, false) THEN ['permanent', 'MAX_RETRY_ATTEMPTS_EXCEEDED'] WHEN NOT coalesce({_CAN}, false) THEN ['skipped', 'not claimed']
    WHEN once.source_id % 13 = 0 THEN ['retryable', 'source row missing'] WHEN has_payload THEN ['done', 'cached'] WHEN once.source_id % 17 = 0 OR byte_size = 0 THEN ['permanent', 'PERMANENT'] ELSE ['done', 'fresh'] END AS r
  FROM once LEFT JOIN state USING (source_id) LEFT JOIN files ON id = once.source_id),
outcomes AS (SELECT source_id, r[1] AS outcome, r[2] AS reason FROM v UNION ALL SELECT source_id, 'skipped', 'repeated' FROM v, unnest(range(n - 1)) WHERE n > 1)
"""


@query("enrichment_outcomes", sql(_OUTCOMES + "SELECT source_id, outcome, reason FROM outcomes", "state", "files"))
def enrichment_outcomes(spark, d):
    return _outcomes(spark, d)


@query("outcome_tally", sql(_OUTCOMES + "SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome", "state", "files"))
def outcome_tally(spark, d):
    return enrich.tally(_outcomes(spark, d))


@query(
    "dlq_records",
    sql(_OUTCOMES + """SELECT source_id, 'DLQ' AS stage, lane, '{"sourceId":' || source_id || ',"lane":"' || lane || '","errorClass":"' || reason || '","attempts":' || attempts || ',"lastError":"' || coalesce(last_error, '') || '"}' AS detail
FROM outcomes JOIN state USING (source_id) WHERE outcome = 'permanent'""", "state", "files"),
)
def dlq_records(spark, d):
    failed = _outcomes(spark, d).where("outcome = 'permanent'").join(t.state(spark, d), "source_id")
    return enrich.dead_letters(failed)


@query(
    "retry_delay",
    sql("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN event_id % 5000 ELSE 100 * (1 << (event_id % 5)::INTEGER) END AS delay_ms FROM events"""),
)
def retry_delay(spark, d):
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "RATE_LIMITED").when(e % 3 == 1, "TRANSIENT").otherwise("TRANSIENT")
    after = F.when(e % 2 == 0, e % 5000)
    return t.table(spark, d, "events").select("event_id", fn.retry_delay_ms(kind, after, e % 5 + 1, 100).alias("delay_ms"))
