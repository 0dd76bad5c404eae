"""Scans, scalars, plans and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.functions import limits
from haulmark.functions import text as fn
from haulmark.functions.text import WHITE_SPACE
from haulmark.operators import access, enrich, governor, planning
from haulmark.plans.registry import query
from haulmark.plans.views import TEXT, sql
from haulmark.sources import tables as t


@query("ocr_extract_text", sql(f"SELECT id, {TEXT} AS ocr_text FROM files", "files"))
def ocr_extract_text(spark, d):
    return t.files(spark, d).select("id", fn.extract_text(F.col("content")).alias("ocr_text"))


@query(
    "ocr_metadata",
    sql("""SELECT id, sha256(content) AS checksum_sha256, ((900 + ('0x' || substr(sha256(content), 1, 2))::INTEGER % 100) / 1000.0)::DECIMAL(4,3)::DOUBLE AS ocr_confidence,
  greatest(1, ceil(strlen(content) / 1800.0))::INTEGER AS ocr_page_count, 'job_' || substr(sha1(id::VARCHAR), 1, 12) AS ocr_vendor_job_id, 'files/' || id AS object_key FROM files""", "files"),
)
def ocr_metadata(spark, d):
    c, i = F.col("content"), F.col("id")
    return t.files(spark, d).select(
        "id", fn.sha256_hex(c).alias("checksum_sha256"), fn.ocr_confidence(c).cast("double").alias("ocr_confidence"), fn.ocr_page_count(c).alias("ocr_page_count"),
        fn.ocr_job_id(i).alias("ocr_vendor_job_id"), fn.object_key(i).alias("object_key"),
    )


@query(
    "build_document",
    sql("""WITH p AS (SELECT id, CASE WHEN length(id::VARCHAR) >= 8 THEN id::VARCHAR ELSE lpad(id::VARCHAR, 8, '0') END AS padded, (id * 37) % 100000 AS cents, byte_size AS target FROM files),
h AS (SELECT *, 'INVOICE ' || padded || chr(10) || 'VENDOR ' || ['ACME SUPPLY CO', 'NORTHWIND TRADING', 'GLOBEX INDUSTRIES', 'INITECH LLC'][(id % 4 + 1)::INTEGER] || chr(10) || 'AMOUNT DUE ' || (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') || chr(10) AS head FROM p)
SELECT id, 'invoice-' || padded || '.txt' AS filename, left(head || repeat('LINE ITEM REFERENCE ' || id || ' ', greatest(0, ceil((target - length(head)) / 24.0))::BIGINT), greatest(length(head), target)) AS text FROM h""", "files"),
)
def build_document(spark, d):
    rows = t.files(spark, d)
    return rows.select("id", fn.generated_name(F.col("id")).alias("filename"), fn.generated_text(F.col("id"), F.col("byte_size")).alias("text"))


@query("extracted_documents", sql(f"""SELECT id AS source_id, filename, content_type, 'files/' || id AS object_key, byte_size, sha256(content) AS checksum_sha256, {TEXT} AS ocr_text FROM files WHERE byte_size > 0""", "files"))
def extracted_documents(spark, d):
    return enrich.extracted(t.files(spark, d)).select("source_id", "filename", "content_type", "object_key", "byte_size", "checksum_sha256", "ocr_text")


@query("max_id", sql("SELECT coalesce(max(id), 0) AS max_id FROM files", "files"))
def max_id(spark, d):
    return access.max_id(t.files(spark, d))


@query("range_scan", sql("SELECT id, created_s FROM files WHERE id BETWEEN 101 AND 350", "files"))
def range_scan(spark, d):
    return access.in_range(t.files(spark, d), 101, 350).select("id", F.unix_seconds("created_at").alias("created_s"))


@query("keyset_page", sql("SELECT id FROM files WHERE id > 100 ORDER BY id LIMIT 500", "files"))
def keyset_page(spark, d):
    return access.page_after(t.files(spark, d), 100, 500, "id")


@query("fetch_by_ids", sql("SELECT id, filename, byte_size, sha256(content) AS checksum FROM files WHERE id IN (SELECT doc_id FROM labels)", "files"))
def fetch_by_ids(spark, d):
    ids = t.table(spark, d, "labels").select("doc_id")
    return access.by_ids(t.files(spark, d), ids).select("id", "filename", "byte_size", fn.sha256_hex(F.col("content")).alias("checksum"))


@query("existing_ids", sql("SELECT 'document' AS place, source_id AS id FROM document WHERE source_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'ledger', source_id FROM ledger WHERE source_id IN (SELECT doc_id FROM labels)", "document", "ledger"))
def existing_ids(spark, d):
    ids = t.table(spark, d, "labels").select("doc_id")
    part = lambda df, name: access.by_ids(df.select("source_id"), ids, "source_id").select(F.lit(name).alias("place"), F.col("source_id").alias("id"))
    return part(t.document(spark, d), "document").union(part(t.ledger(spark, d), "ledger"))


@query("backfill_ranges", sql("SELECT unnest(range(1, (SELECT max(id) FROM files) + 1, 1000)) AS range_start, range_start + 999 AS range_end", "files"))
def backfill_ranges(spark, d):
    return planning.ranges(access.max_id(t.files(spark, d)))


_BATCHES = """SELECT range_start, batch, 'backfill' AS lane, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
  SELECT id, (id - 1) // 1000 * 1000 + 1 AS range_start, (row_number() OVER (PARTITION BY (id - 1) // 1000 ORDER BY id) - 1) // 25 AS batch FROM files) GROUP BY ALL"""


@query("backfill_batches", sql(_BATCHES, "files"))
def backfill_batches(spark, d):
    rows = planning.batches(t.files(spark, d))
    return rows.select("range_start", "batch", "lane", F.size("sourceIds").cast("long").alias("n"), F.array_min("sourceIds").alias("first_id"), F.array_max("sourceIds").alias("last_id"))


def _checkpoints(spark, d):
    rows = planning.ranges(access.max_id(t.files(spark, d)), 100)
    number = F.floor(F.col("range_start") / 100)
    status = F.when(number % 3 == 0, "CLAIMED").when(number % 3 == 1, "DONE").otherwise("PENDING")
    return rows.withColumns({"status": status, "claimed_at": F.when(number % 3 == 0, F.timestamp_seconds(F.lit(t.AS_OF) - number * 20))})


_POINTS = f"""WITH points AS (SELECT *, CASE range_start // 100 % 3 WHEN 0 THEN 'CLAIMED' WHEN 1 THEN 'DONE' ELSE 'PENDING' END AS status,
  CASE WHEN range_start // 100 % 3 = 0 THEN {t.AS_OF} - range_start // 100 * 20 END AS claimed_s
  FROM (SELECT unnest(range(1, (SELECT max(id) FROM files) + 1, 100)) AS range_start, range_start + 99 AS range_end))
"""


def _plain(rows):
    return rows.select("range_start", "range_end", "status", F.unix_seconds("claimed_at").alias("claimed_s"))


@query("range_claim", sql(_POINTS + f"""SELECT range_start, range_end, CASE WHEN hit THEN 'CLAIMED' ELSE status END AS status, CASE WHEN hit THEN {t.AS_OF} ELSE claimed_s END AS claimed_s
FROM (SELECT *, coalesce(range_start = (SELECT min(range_start) FROM points WHERE status = 'PENDING'), false) AS hit FROM points)""", "files"))
def range_claim(spark, d):
    return _plain(planning.claim_next(_checkpoints(spark, d), t.as_of()))


@query("range_reap", sql(_POINTS + f"""SELECT range_start, range_end, CASE WHEN late THEN 'PENDING' ELSE status END AS status, CASE WHEN NOT late THEN claimed_s END AS claimed_s
FROM (SELECT *, coalesce(status = 'CLAIMED' AND claimed_s < {t.AS_OF} - 300, false) AS late FROM points)""", "files"))
def range_reap(spark, d):
    return _plain(planning.reap_expired(_checkpoints(spark, d), t.as_of()))


_PLAN = "SELECT unnest(range(1, (SELECT max({0}) FROM {1}) + 1, 100)) AS range_start, range_start + 99 AS range_end"


@query("plan_insert_ignore", sql(f"SELECT * FROM ({_PLAN.format('id', 'files')}) WHERE range_start NOT IN (SELECT range_start FROM ({_PLAN.format('vec_id', 'embeddings')}))", "files"))
def plan_insert_ignore(spark, d):
    """New ranges over a plan that was made when there were as many files as there are embeddings."""
    old = planning.ranges(access.max_id(t.table(spark, d, "embeddings"), "vec_id"), 100)
    return access.insert_ignore(old, planning.ranges(access.max_id(t.files(spark, d)), 100), ["range_start", "range_end"])


@query("range_events", sql(_POINTS + """SELECT 'QUEUED' AS stage, 'backfill' AS lane, '{"rangeStart":' || range_start || ',"rangeEnd":' || range_end || '}' AS detail FROM points""", "files"))
def range_events(spark, d):
    return planning.range_events(_checkpoints(spark, d)).drop("source_id")


@query("document_upsert_latest", sql("""SELECT source_id, arg_max(name, seq) AS filename FROM (
  SELECT user_id AS source_id, 'v' || event_id AS name, event_id AS seq FROM events UNION ALL SELECT id, filename, -1 FROM files) GROUP BY source_id""", "files"))
def document_upsert_latest(spark, d):
    old = t.files(spark, d).select(F.col("id").alias("source_id"), "filename")
    new = t.table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.concat(F.lit("v"), "event_id").alias("filename"), "event_id")
    return access.upsert_latest(old, new, "source_id", F.col("event_id"))


@query("document_page", sql("SELECT source_id, checksum_sha256, ocr_text, object_key FROM document WHERE source_id > 100 ORDER BY source_id LIMIT 500", "document"))
def document_page(spark, d):
    return access.page_after(t.document(spark, d), 100, 500, "source_id", ("checksum_sha256", "ocr_text", "object_key"))


@query("ledger_page", sql("SELECT source_id FROM ledger WHERE source_id > 100 ORDER BY source_id LIMIT 500", "ledger"))
def ledger_page(spark, d):
    return access.page_after(t.ledger(spark, d), 100, 500, "source_id")


@query(
    "build_insert",
    sql(
        f"""WITH given AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN chr(160) || '  ' ELSE ' ' || chr(9) || 'my file ' || id || chr(10) END AS name,
  CASE WHEN id % 11 <> 0 THEN content END AS text FROM files)
SELECT id, coalesce(nullif(regexp_replace(regexp_replace(name, '^{WHITE_SPACE}', ''), '{WHITE_SPACE}$', ''), ''), 'upload-' || {t.AS_OF * 1000} || '.txt') AS filename,
  'text/plain' AS content_type, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::INTEGER AS byte_size FROM given""",
        "files",
    ),
)
def build_insert(spark, d):
    i = F.col("id")
    blank = F.lit("\u00a0  ")
    name = F.when(i % 7 == 0, F.lit(None)).when(i % 5 == 0, blank).otherwise(F.concat(F.lit(" \tmy file "), i.cast("string"), F.lit("\n")))
    given = t.files(spark, d).select("id", name.alias("name"), F.when(i % 11 != 0, F.col("content").cast("string")).alias("text"))
    rows = given.select("id", *fn.upload(F.col("name"), F.col("text"), t.as_of()))
    return rows.select("id", "filename", "content_type", fn.sha256_hex(F.col("content")).alias("sha256"), "byte_size")


@query(
    "vendor_requests",
    sql(
        """WITH given AS (SELECT id, CASE WHEN id % 17 = 0 THEN '' WHEN id % 19 = 0 THEN NULL ELSE content END AS text FROM files)
SELECT id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::INTEGER AS byte_size, coalesce(text, '') <> '' AS processable FROM given""",
        "files",
    ),
)
def vendor_requests(spark, d):
    i = F.col("id")
    plain = F.base64(F.col("content"))
    other = F.translate(F.regexp_replace(plain, "=+$", ""), "+/", "-_")  # the other alphabet, without padding
    text = F.when(i % 17 == 0, "").when(i % 19 == 0, F.lit(None)).when(i % 2 == 0, other).otherwise(plain)
    rows = enrich.requests(t.files(spark, d).select("id", text.alias("contentBase64")))
    return rows.select("id", fn.sha256_hex(F.col("content")).alias("sha256"), F.octet_length("content").alias("byte_size"), "processable")


@query(
    "ack_messages",
    sql(
        """WITH ids AS (SELECT id, (id - 1) // 1000 * 1000 + 1 AS range_start, row_number() OVER (PARTITION BY (id - 1) // 1000 ORDER BY id) - 1 AS n FROM files),
m AS (SELECT range_start || ':' || (n // 3) AS message, CASE WHEN n // 3 % 2 = 0 THEN 'cdc' ELSE 'backfill' END AS lane, id FROM ids)
SELECT message, m.lane, count(*) FILTER (status NOT IN ('DONE', 'FAILED_PERMANENT')) = 0 AS ack,
  CASE WHEN count(*) FILTER (status NOT IN ('DONE', 'FAILED_PERMANENT')) > 0 THEN CASE m.lane WHEN 'cdc' THEN 10 ELSE 30 END END::INTEGER AS redeliver_s
FROM m LEFT JOIN state ON state.source_id = m.id AND m.id % 7 <> 0 GROUP BY message, m.lane""",
        "files", "state",
    ),
)
def ack_messages(spark, d):
    found = planning.batches(t.files(spark, d), size=3)
    lane = F.when(F.col("batch") % 2 == 0, "cdc").otherwise("backfill")
    messages = found.select(F.concat_ws(":", "range_start", "batch").alias("message"), lane.alias("lane"), "sourceIds")
    return enrich.acknowledged(messages, t.state(spark, d).where("source_id % 7 <> 0"))


@query(
    "range_lifecycle",
    sql(
        f"""WITH r AS (SELECT unnest(range(1, (SELECT max(id) FROM files) + 1, 100)) AS range_start),
old AS (SELECT range_start, range_start % 500 = 1 AS known, CASE WHEN range_start % 1000 = 1 THEN 'CLAIMED' ELSE 'DONE' END AS status FROM r)
SELECT range_start, range_start + 99 AS range_end, CASE WHEN range_start % 300 = 1 THEN 'DONE' WHEN known AND status = 'DONE' THEN 'DONE' ELSE 'CLAIMED' END AS status,
  CASE WHEN NOT known OR status = 'CLAIMED' THEN {t.AS_OF}::BIGINT END AS claimed_s FROM old""",
        "files",
    ),
)
def range_lifecycle(spark, d):
    now, top = t.as_of(), access.max_id(t.files(spark, d))
    start = F.col("range_start")
    old = planning.ranges(top, 100).where("range_start % 500 = 1")
    old = old.withColumn("status", F.when(start % 1000 == 1, "CLAIMED").otherwise("DONE"))
    old = old.withColumn("claimed_at", F.when(F.col("status") == "CLAIMED", now - F.expr("INTERVAL 301 SECONDS")))
    claimed = planning.claim_all(planning.reap_expired(planning.plan(old, top, 100), now), now)
    done = planning.mark_range_done(claimed, claimed.where("range_start % 300 = 1"))
    return done.select("range_start", "range_end", "status", F.unix_seconds("claimed_at").alias("claimed_s"))


@query(
    "finite_number",
    sql(
        "SELECT id, CASE id % 6 WHEN 0 THEN 0 WHEN 3 THEN id / 4 WHEN 4 THEN id * 1000 ELSE -1 END::DOUBLE AS n FROM files",
        "files",
    ),
)
def finite_number(spark, d):
    i = F.col("id")
    raw = F.when(i % 6 == 0, F.lit(None)).when(i % 6 == 1, "NaN").when(i % 6 == 2, "Infinity").when(i % 6 == 3, (i / 4).cast("string")).when(i % 6 == 4, F.concat(i.cast("string"), F.lit("e3"))).otherwise("words")
    return t.files(spark, d).select("id", fn.to_finite_number(raw, -1).alias("n"))


def _calls(spark, d):
    """The events as calls, an hour of them in a second."""
    e = t.table(spark, d, "events")
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600).cast("long"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("vendor"), F.when(F.col("user_id") % 2 == 0, "cdc").otherwise("backfill").alias("lane"), at.alias("at"), (F.col("event_id") % 7 < 3).alias("transient"))


@query(
    "rate_limiter_sim",
    """WITH calls AS (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'cdc' ELSE 'backfill' END AS lane, epoch_us(ts) // 3600 AS t FROM events),
own AS (SELECT *, t // 1000000 AS second, row_number() OVER (PARTITION BY t // 1000000, lane ORDER BY t, id) AS n FROM calls),
fits AS (SELECT *, n <= CASE lane WHEN 'cdc' THEN 10 ELSE 8 END AS f FROM own)
SELECT id, lane, second, f AND sum(f::INTEGER) OVER (PARTITION BY second ORDER BY t, id ROWS UNBOUNDED PRECEDING) <= 10 AS granted FROM fits""",
)
def rate_limiter_sim(spark, d):
    return governor.limited(_calls(spark, d), 10, 20)


@query("breaker_sim")
def breaker_sim(spark, d):
    """A sequential fold, for which there is no SQL; tested against a replay."""
    return governor.broken(_calls(spark, d))


@query(
    "backfill_messages",
    sql(
        """WITH n AS (SELECT id, (id - 1) // 1000 AS r, row_number() OVER (PARTITION BY (id - 1) // 1000 ORDER BY id) - 1 AS i FROM files)
SELECT min(id)::VARCHAR AS key, '{"lane":"backfill","sourceIds":[' || string_agg(id::VARCHAR, ',' ORDER BY id) || ']}' AS value FROM n GROUP BY r, i // 25""",
        "files",
    ),
)
def backfill_messages(spark, d):
    return planning.messages(planning.batches(t.files(spark, d)))


_RAW = "CASE id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN id::VARCHAR WHEN 3 THEN '-' || id WHEN 4 THEN ' ' || id || ' rows' WHEN 5 THEN 'rows' WHEN 6 THEN id || '.5' ELSE '1e' || id % 5 END"


def _raw(i):
    text = i.cast("string")
    odd = F.when(i % 8 == 2, text).when(i % 8 == 3, F.concat(F.lit("-"), text)).when(i % 8 == 4, F.concat(F.lit(" "), text, F.lit(" rows"))).when(i % 8 == 5, "rows")
    rest = F.when(i % 8 == 6, F.concat(text, F.lit(".5"))).when(i % 8 == 7, F.concat(F.lit("1e"), (i % 5).cast("string"))).when(i % 8 == 1, "")
    return F.coalesce(odd, rest)


@query(
    "clamp_limit",
    sql(
        f"""WITH raw AS (SELECT id, {_RAW} AS raw FROM files), n AS (SELECT id, coalesce(try_cast(regexp_extract(raw, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS n FROM raw)
SELECT id, CASE WHEN n > 0 THEN least(n, 50) ELSE 8 END::INTEGER AS rows FROM n""",
        "files",
    ),
)
def clamp_limit(spark, d):
    return t.files(spark, d).select("id", fn.clamped_limit(_raw(F.col("id")), limits.DEFAULT_LIMIT, limits.MAX_LIMIT).alias("rows"))


@query(
    "bulk_verdict",
    sql(
        f"""WITH raw AS (SELECT id, try_cast({_RAW} AS DOUBLE) AS n FROM files)
SELECT id, CASE WHEN n IS NULL OR n <= 0 OR n <> floor(n) THEN 'not whole' WHEN n > 1000 THEN 'too many' ELSE 'ok' END AS verdict FROM raw""",
        "files",
    ),
)
def bulk_verdict(spark, d):
    return t.files(spark, d).select("id", fn.bulk_verdict(_raw(F.col("id")), limits.MAX_BULK).alias("verdict"))


def _vendor(batch):
    """Takes no batch with a poisoned file in it, and leaves some files out of its answer."""
    if any(i % 41 == 0 for i, _ in batch):
        raise enrich.VendorError("PERMANENT", "Vendor rejected this file")
    return {i: f"{len(c)} bytes" for i, c in batch if i % 43}


@query(
    "vendor_calls",
    sql(
        """SELECT id AS source_id, CASE WHEN id % 41 = 0 THEN 'permanent' WHEN id % 43 = 0 THEN 'retryable' ELSE 'done' END AS outcome,
  CASE WHEN id % 41 = 0 THEN 'PERMANENT' WHEN id % 43 = 0 THEN 'omitted' ELSE 'fresh' END AS reason, CASE WHEN id % 41 <> 0 AND id % 43 <> 0 THEN strlen(content) || ' bytes' END AS text FROM files""",
        "files",
    ),
)
def vendor_calls(spark, d):
    return enrich.call_vendor(t.files(spark, d), _vendor).select("source_id", "outcome", "reason", "text")


def _down(batch):
    if any(i % 5 == 0 for i, _ in batch):
        raise enrich.VendorError("TRANSIENT" if batch[0][0] % 2 else "RATE_LIMITED", "try later")
    return {i: "read" for i, _ in batch}


@query(
    "vendor_outage",
    sql(
        """SELECT id AS source_id, CASE WHEN id % 5 = 0 THEN 'retryable' ELSE 'done' END AS outcome, CASE WHEN id % 5 <> 0 THEN 'fresh' WHEN id % 2 = 1 THEN 'TRANSIENT' ELSE 'RATE_LIMITED' END AS reason FROM files""",
        "files",
    ),
)
def vendor_outage(spark, d):
    return enrich.call_vendor(t.files(spark, d), _down, 1).select("source_id", "outcome", "reason")
