"""Enrichment of claimed files: outcomes, tallies, dead letters, and calls to a vendor in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions import text as fn
from haulmark.operators import ledger

# Documents a vendor call, seconds until a message that is not acknowledged comes again.
VENDOR_BATCH = 25
REDELIVER_S = {"cdc": 10, "backfill": 30}


# What a vendor in these modes answers with.
TROUBLE = {"rate_limited": "RATE_LIMITED", "erroring": "TRANSIENT", "down": "TRANSIENT"}


class VendorError(Exception):
    def __init__(self, error_class: str, message: str = "", retry_after_ms: int | None = None):
        super().__init__(message)
        self.error_class, self.retry_after_ms = error_class, retry_after_ms


def outcomes(asked: DataFrame, state: DataFrame, files: DataFrame, claimable, at_cap) -> DataFrame:
    """(source_id, outcome, reason) for every id asked for; repeated ids count as skipped from the second on.

    Condemned before claimed; then cached results need no vendor; a missing source row is retryable and counts; an empty
    file can't be processed by anyone."""
    once = asked.groupBy("source_id").agg(F.count("*").alias("n"))
    known = state.select("source_id", at_cap.alias("cap"), claimable.alias("can"), F.col("ocr_payload").isNotNull().alias("cached"))
    source = files.select(F.col("id").alias("source_id"), (F.octet_length("content") == 0).alias("empty"))
    rows = once.join(known, "source_id", "left").join(source, "source_id", "left")
    verdict = (
        F.when(F.coalesce("cap", F.lit(False)), F.struct(F.lit("permanent").alias("outcome"), F.lit("MAX_RETRY_ATTEMPTS_EXCEEDED").alias("reason")))
        .when(~F.coalesce("can", F.lit(False)), F.struct(F.lit("skipped").alias("outcome"), F.lit("not claimed").alias("reason")))
        .when(F.col("empty").isNull(), F.struct(F.lit("retryable").alias("outcome"), F.lit("source row missing").alias("reason")))
        .when(F.col("cached"), F.struct(F.lit("done").alias("outcome"), F.lit("cached").alias("reason")))
        .when(F.col("empty"), F.struct(F.lit("permanent").alias("outcome"), F.lit("PERMANENT").alias("reason")))
        .otherwise(F.struct(F.lit("done").alias("outcome"), F.lit("fresh").alias("reason")))
    )
    first = rows.select("source_id", "n", verdict.alias("v"))
    again = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.when(i == 1, F.col("v")).otherwise(F.struct(F.lit("skipped").alias("outcome"), F.lit("repeated").alias("reason"))))
    return first.select("source_id", F.explode(again).alias("v")).select("source_id", "v.*")


def acknowledged(messages: DataFrame, state: DataFrame) -> DataFrame:
    """messages (message, lane, sourceIds) -> (message, lane, ack, redeliver_s): acknowledged if none of its ids is unresolved in
    the ledger (an id without a row is not); else it comes again after its lane's wait."""
    ids = messages.select("message", "lane", F.explode_outer("sourceIds").alias("source_id"))
    open_ = state.where(ledger.unresolved()).select("source_id", F.lit(1).alias("open"))
    found = ids.join(open_, "source_id", "left").groupBy("message", "lane").agg(F.count("open").alias("open"))
    wait = F.create_map(*(F.lit(x) for pair in REDELIVER_S.items() for x in pair))[F.col("lane")]
    return found.select("message", "lane", (F.col("open") == 0).alias("ack"), F.when(F.col("open") > 0, wait).alias("redeliver_s"))


def requests(rows: DataFrame) -> DataFrame:
    """rows (id, contentBase64) as a vendor takes them: (id, content, processable); one without bytes can't be processed."""
    return rows.select("id", fn.decoded(F.col("contentBase64")).alias("content")).withColumn("processable", F.octet_length("content") > 0)


def tally(rows: DataFrame) -> DataFrame:
    """(outcome, n): sums to what was asked for."""
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def dead_letters(failed: DataFrame) -> DataFrame:
    """failed (source_id, lane, reason, attempts, last_error) -> one row for both the event and the topic."""
    value = F.struct(F.col("source_id").alias("sourceId"), "lane", F.col("reason").alias("errorClass"), "attempts", F.coalesce("last_error", F.lit("")).alias("lastError"))
    return failed.select("source_id", F.lit("DLQ").alias("stage"), "lane", F.to_json(value).alias("detail"))


def extracted(files: DataFrame) -> DataFrame:
    """Documents as they are stored: (source_id, …), for files that hold something."""
    i, content = F.col("id"), F.col("content")
    return files.where(F.octet_length(content) > 0).select(
        i.alias("source_id"), "filename", "content_type", fn.object_key(i).alias("object_key"), "byte_size", fn.sha256_hex(content).alias("checksum_sha256"),
        fn.extract_text(content).alias("ocr_text"), fn.ocr_confidence(content).alias("ocr_confidence"), fn.ocr_page_count(content).alias("ocr_page_count"), fn.ocr_job_id(i).alias("ocr_vendor_job_id"),
    )


RESULT = "source_id long, outcome string, reason string, text string, calls int"
#: Rows and characters of text that are passed on at once: a frame costs far more than a row, and long answers take memory.
OUT_ROWS, OUT_CHARS = 10_000, 4_000_000


def call_vendor(files: DataFrame, vendor: Callable[[list[tuple[int, bytes]]], dict[int, str]], batch: int = VENDOR_BATCH, governed: Callable | None = None) -> DataFrame:
    """files(id, content) through an outside service, some at a time.

    ``governed`` makes, for each task, what a call goes through: a function of the call, such as governor.for_lane(). Limits
    are a task's own, so give each its share of what the service takes.

    A batch that fails for good is sent again one by one, so that one bad file doesn't fail its neighbours; any other
    failure makes what is left retryable without counting against it. An id the answer leaves out is retryable."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        through = governed() if governed else None
        send = (lambda rows: through(lambda: vendor(rows))) if through else vendor
        told = lambda rows: pd.DataFrame(rows, columns=["source_id", "outcome", "reason", "text", "calls"])
        out, chars = [], 0
        for frame in frames:
            rows = list(zip(frame["id"].tolist(), (bytes(x) for x in frame["content"]), strict=True))
            for at in range(0, len(rows), batch):
                sent = _send(rows[at : at + batch], send)
                out += sent
                chars += sum(len(text) for *_, text, _ in sent if text)
                if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield told(out)
                    out, chars = [], 0
        if out:
            yield told(out)

    return files.select("id", "content").mapInPandas(run, RESULT)


def _send(rows: list[tuple[int, bytes]], vendor) -> list[tuple]:
    def told(answer: dict[int, str], asked: list[tuple[int, bytes]]) -> list[tuple]:
        return [(i, "done", "fresh", answer[i], 1) if i in answer else (i, "retryable", "omitted", None, 1) for i, _ in asked]

    try:
        return told(vendor(rows), rows)
    except VendorError as e:
        if e.error_class != "PERMANENT":
            return [(i, "retryable", e.error_class, None, 1) for i, _ in rows]
        if len(rows) == 1:
            return [(rows[0][0], "permanent", "PERMANENT", None, 1)]
    out: list[tuple] = []
    for n, row in enumerate(rows):
        try:
            out += told(vendor([row]), [row])
        except VendorError as e:
            if e.error_class != "PERMANENT":
                return out + [(i, "retryable", e.error_class, None, 1) for i, _ in rows[n:]]
            out.append((row[0], "permanent", "PERMANENT", None, 1))
    return out
