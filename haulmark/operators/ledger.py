"""The ledger's transitions as expressions over whole tables: each takes the state and the ids it is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.schemas import TERMINAL

# Seconds until a claim expires, failures in a row that condemn.
LEASE_S, MAX_FAILURES = 60, 5


def lease_over(now: Column, lease_s: int = LEASE_S) -> Column:
    return F.col("updated_at") < now - F.expr(f"INTERVAL {lease_s} SECONDS")


def claimable(now: Column, lease_s: int = LEASE_S) -> Column:
    return F.col("status").isin("PENDING", "FAILED_RETRYABLE") | (F.col("status").isin("IN_FLIGHT", "OCR_DONE") & lease_over(now, lease_s))


def at_cap(cap: int = MAX_FAILURES) -> Column:
    return F.col("status").isin("PENDING", "FAILED_RETRYABLE") & (F.col("consecutive_failures") >= cap)


def unresolved() -> Column:
    return ~F.col("status").isin(*TERMINAL)


def outstanding() -> Column:
    """Everything but DONE: condemned rows count."""
    return F.col("status") != "DONE"


def change(state: DataFrame, ids: DataFrame, guard: Column, now: Column, **new: Column) -> DataFrame:
    """Rows with an id of the set for which the guard holds get the new values and a new updated_at. Columns of ids other
    than source_id can be used in the values."""
    extra = [c for c in ids.columns if c != "source_id"]
    marked = ids.dropDuplicates(["source_id"]).withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit") & guard, F.lit(False))
    joined = state.join(marked, "source_id", "left").withColumn("_apply", hit)
    new = {**new, "updated_at": now}
    return joined.withColumns({c: F.when(F.col("_apply"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_hit", "_apply", *extra)


def seed(state: DataFrame, ids: DataFrame, lane: str, now: Column) -> DataFrame:
    """New PENDING rows for ids (source_id, source_created_at) that have none; rows that are there keep even their lane."""
    fresh = ids.dropDuplicates(["source_id"]).join(state.select("source_id"), "source_id", "left_anti")
    values = {"lane": F.lit(lane), "status": F.lit("PENDING"), "attempts": F.lit(0), "consecutive_failures": F.lit(0), "source_version": F.lit(0).cast("long"), "updated_at": now}
    kinds = dict(state.dtypes)
    row = [F.col(c) if c in fresh.columns else values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in state.columns]
    return fresh.select(*row)


def condemn(state: DataFrame, ids: DataFrame, now: Column, cap: int = MAX_FAILURES) -> DataFrame:
    return change(state, ids, at_cap(cap), now, status=F.lit("FAILED_PERMANENT"))


def claim(state: DataFrame, ids: DataFrame, now: Column, lease_s: int = LEASE_S) -> DataFrame:
    return change(state, ids, claimable(now, lease_s), now, status=F.lit("IN_FLIGHT"), attempts=F.col("attempts") + 1)


def renew(state: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return change(state, ids, F.col("status") == "IN_FLIGHT", now)


def save_payload(state: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """ids (source_id, payload)."""
    return change(state, ids, F.lit(True), now, status=F.lit("OCR_DONE"), consecutive_failures=F.lit(0), ocr_payload=F.col("payload"))


def mark_done(state: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """ids (source_id, checksum); an earlier error stays to be seen."""
    return change(state, ids, F.lit(True), now, status=F.lit("DONE"), consecutive_failures=F.lit(0), checksum_sha256=F.col("checksum"))


def mark_failed(state: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """ids (source_id, permanent, counts, error)."""
    status = F.when(F.col("permanent"), "FAILED_PERMANENT").otherwise("FAILED_RETRYABLE")
    more = F.when(~F.col("permanent") & F.col("counts"), F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures"))
    return change(state, ids, F.lit(True), now, status=status, consecutive_failures=more, last_error=F.col("error"))


def reset_for_update(state: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """ids (source_id, version): back to PENDING from any status. The version is overwritten even by a lower one; only a
    higher one clears the failures."""
    failures = F.when(F.col("version") > F.col("source_version"), F.lit(0)).otherwise(F.col("consecutive_failures"))
    kind = dict(state.dtypes)["ocr_payload"]
    return change(
        state, ids, F.lit(True), now, status=F.lit("PENDING"), consecutive_failures=failures, source_version=F.col("version"),
        ocr_payload=F.lit(None).cast(kind), last_error=F.lit(None).cast("string"),
    )


def tombstone(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select("source_id"), "source_id", "left_anti")


def attempts_of(state: DataFrame, ids: DataFrame) -> DataFrame:
    """(source_id, attempts): 0 without a row."""
    return ids.join(state.select("source_id", "attempts"), "source_id", "left").select("source_id", F.coalesce("attempts", F.lit(0)).alias("attempts"))
