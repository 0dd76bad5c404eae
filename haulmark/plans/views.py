"""The derived views of haulmark.sources.tables as SQL, for the oracles."""

from __future__ import annotations

from haulmark.functions.text import WHITE_SPACE
from haulmark.schemas import STATUSES
from haulmark.sources.tables import AS_OF, EPOCH

TEXT = rf"trim(regexp_replace(upper(replace(content, 'ß', 'ss')), '{WHITE_SPACE}', ' ', 'g'), ' ')"
_CONFIDENCE = "((900 + ('0x' || substr(sha256(content), 1, 2))::INTEGER % 100) / 1000.0)::DECIMAL(4,3)"
_PAGES = "greatest(1, ceil(strlen(content) / 1800.0))::INTEGER"
_JOB = "'job_' || substr(sha1({}::VARCHAR), 1, 12)"
_LIST = ", ".join(f"'{s}'" for s in STATUSES)

VIEWS = {
    "files": f"""SELECT doc_id + 1 AS id, 'doc-' || (doc_id + 1) || '.txt' AS filename, 'text/plain' AS content_type, text AS content,
      strlen(text)::INTEGER AS byte_size, {EPOCH} + (doc_id + 1) * 60 AS created_s FROM documents""",
    "objects": "SELECT 'files/' || id AS object_key, CASE WHEN id % 73 = 0 THEN content || '!' ELSE content END AS bytes FROM files WHERE id % 79 <> 0",
    "document": f"""SELECT source_id, filename, content_type, 'files/' || source_id AS object_key, byte_size,
      CASE WHEN source_id = id AND id % 89 = 0 THEN repeat('0', 64) ELSE sha256(content) END AS checksum_sha256,
      {TEXT} || CASE WHEN source_id = id AND id % 83 = 0 THEN ' STALE' ELSE '' END AS ocr_text,
      {_CONFIDENCE} AS ocr_confidence, {_PAGES} AS ocr_page_count, {_JOB.format("source_id")} AS ocr_vendor_job_id, {EPOCH} + source_id % 100003 * 7 AS migrated_s
      FROM (SELECT *, id AS source_id FROM files WHERE id % 97 <> 0 UNION ALL SELECT *, id + 10000000 FROM files WHERE id % 101 = 0)""",
    "ledger": """SELECT source_id, CASE WHEN id % 71 = 0 AND source_id = id THEN 'FAILED_PERMANENT' ELSE 'DONE' END AS status
      FROM (SELECT id, id AS source_id FROM files WHERE id % 67 <> 0 UNION ALL SELECT id, id + 20000000 FROM files WHERE id % 61 = 0)""",
    "state": f"""SELECT id AS source_id, CASE WHEN id % 2 = 0 THEN 'cdc' ELSE 'backfill' END AS lane, [{_LIST}][(id % 6 + 1)::INTEGER] AS status,
      (id % 5)::INTEGER AS attempts, (id % 7)::INTEGER AS consecutive_failures, 1700000000000 + id AS source_version,
      CASE WHEN id % 11 <> 0 THEN {EPOCH} + id * 60 END AS created_s, CASE WHEN id % 6 = 3 THEN sha1(id::VARCHAR) END AS checksum_sha256,
      id % 3 = 0 AS has_payload, CASE WHEN id % 6 >= 4 THEN 'error ' || id END AS last_error, {AS_OF} - id % 120 AS updated_s FROM files""",
    "mevents": """SELECT event_id + 1 AS id, CASE WHEN event_type <> 'error' THEN user_id END AS source_id,
      CASE event_type WHEN 'signup' THEN 'CDC_CAPTURED' WHEN 'view' THEN 'CLAIMED' WHEN 'click' THEN 'OCR_DONE' WHEN 'purchase' THEN 'STORED'
        WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'BREAKER_OPEN' ELSE 'BREAKER_CLOSED' END END AS stage,
      CASE WHEN event_type <> 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'cdc' ELSE 'backfill' END END AS lane, props AS detail, epoch_us(ts) AS t FROM events""",
    "changelog": """SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' WHEN 'error' THEN 'd' ELSE 'u' END AS kind,
      user_id AS uid, epoch_us(ts) // 1000 AS ts_ms, event_id AS i FROM events""",
    "routed": """SELECT seq, CASE WHEN i % 109 = 0 THEN 'tombstone' WHEN i % 113 = 0 THEN 'malformed' WHEN i % 107 = 0 AND (kind <> 'd' OR i % 103 = 0) THEN 'no_id'
        WHEN i % 103 = 0 AND kind = 'd' THEN 'no_id' WHEN i % 103 = 0 THEN 'unknown_op' ELSE kind END AS route, uid AS id, ts_ms FROM changelog""",
    "changes": "SELECT seq, id, route AS op, ts_ms AS version FROM routed WHERE route IN ('c', 'r', 'u', 'd')",
}
_NEEDS = {
    "objects": ["files"], "document": ["files"], "ledger": ["files"], "state": ["files"], "routed": ["changelog"], "changes": ["routed"],
}


def sql(body: str, *views: str) -> str:
    """body with the views it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    joint = ", " if body.lstrip().startswith("WITH ") else " "
    return f"WITH {head}{joint}{body.lstrip().removeprefix('WITH ')}" if order else body
