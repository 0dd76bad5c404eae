"""Reconciliation: the flagship query, its parts and its summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.operators import reconcile as rec
from haulmark.plans.registry import query
from haulmark.plans.views import TEXT, sql
from haulmark.sources import tables as t

_DEFECTS = f"""WITH examined AS (
  SELECT d.source_id, d.checksum_sha256, d.ocr_text, f.id, sha256(f.content) AS sha, {TEXT.replace("content", "f.content")} AS text, o.object_key AS stored, sha256(o.bytes) AS osha
  FROM document d LEFT JOIN files f ON f.id = d.source_id LEFT JOIN objects o ON o.object_key = d.object_key),
defects AS (
  SELECT 'orphan_document' AS kind, source_id AS id FROM examined WHERE id IS NULL
  UNION ALL SELECT 'checksum', source_id FROM examined WHERE id IS NOT NULL AND (lower(checksum_sha256) <> lower(sha) OR (stored IS NOT NULL AND osha <> sha))
  UNION ALL SELECT 'ocr_text', source_id FROM examined WHERE id IS NOT NULL AND ocr_text IS DISTINCT FROM text
  UNION ALL SELECT 'missing_object', source_id FROM examined WHERE id IS NOT NULL AND stored IS NULL
  UNION ALL SELECT 'missing_document', id FROM files WHERE NOT EXISTS (SELECT 1 FROM document WHERE source_id = files.id)
  UNION ALL SELECT 'missing_ledger', id FROM files WHERE NOT EXISTS (SELECT 1 FROM ledger WHERE source_id = files.id)
  UNION ALL SELECT 'orphan_ledger', source_id FROM ledger WHERE NOT EXISTS (SELECT 1 FROM files WHERE id = ledger.source_id)
  UNION ALL SELECT 'permanent_failure', source_id FROM ledger WHERE status = 'FAILED_PERMANENT')
"""
_VIEWS = ("files", "document", "ledger", "objects")


def _tables(spark, d):
    return t.files(spark, d), t.document(spark, d), t.ledger(spark, d), t.objects(spark, d)


@query("reconcile_defects", sql(_DEFECTS + "SELECT kind, id FROM defects", *_VIEWS))
def reconcile_defects(spark, d):
    return rec.defects(*_tables(spark, d))


@query(
    "reconcile_summary",
    sql(
        _DEFECTS
        + """, s AS (SELECT (SELECT count(*) FROM files) AS source_rows, (SELECT count(*) FROM document) AS document_rows, (SELECT count(*) FROM ledger) AS ledger_rows,
  (SELECT count(*) FROM examined WHERE id IS NOT NULL) AS rows_examined, (SELECT count(*) FROM defects) AS defects)
SELECT *, source_rows = document_rows AND source_rows = ledger_rows AND defects = 0 AS clean FROM s""",
        *_VIEWS,
    ),
)
def reconcile_summary(spark, d):
    return rec.summary(*_tables(spark, d))


def _of_documents(kind):
    return lambda spark, d: rec.document_defects(rec.examined(t.document(spark, d), t.files(spark, d), t.objects(spark, d))).where(F.col("kind") == kind).select("id")


def _of_membership(kind):
    return lambda spark, d: rec.membership_defects(t.files(spark, d), t.document(spark, d), t.ledger(spark, d)).where(F.col("kind") == kind).select("id")


for _name, _kind, _make in (
    ("checksum_mismatches", "checksum", _of_documents), ("ocr_mismatches", "ocr_text", _of_documents), ("missing_objects", "missing_object", _of_documents), ("orphan_documents", "orphan_document", _of_documents),
    ("missing_documents", "missing_document", _of_membership), ("missing_ledger_rows", "missing_ledger", _of_membership), ("orphan_ledger_rows", "orphan_ledger", _of_membership),
):
    query(_name, sql(_DEFECTS + f"SELECT id FROM defects WHERE kind = '{_kind}'", *_VIEWS))(_make(_kind))


@query("permanent_failures", sql("SELECT source_id AS id FROM ledger WHERE status = 'FAILED_PERMANENT'", "ledger"))
def permanent_failures(spark, d):
    return rec.permanent_failures(t.ledger(spark, d)).select("id").orderBy("id")


def _with_errors(spark, d):
    number = F.substring("object_key", 7, 20).cast("long")
    return t.objects(spark, d).select("object_key", F.when(number % 59 != 0, F.col("bytes")).alias("bytes"), F.when(number % 59 == 0, "timed out").alias("error"))


@query(
    "object_outcomes",
    sql(
        """SELECT d.source_id, CASE WHEN o.object_key IS NULL THEN 'missing' WHEN substr(o.object_key, 7)::BIGINT % 59 = 0 THEN 'unreadable' ELSE 'read' END AS outcome
FROM document d LEFT JOIN objects o USING (object_key)""",
        "document", "objects",
    ),
)
def object_outcomes(spark, d):
    return rec.object_outcomes(t.document(spark, d), _with_errors(spark, d))


@query(
    "unreadable_objects",
    sql("SELECT 'unreadable_object' AS kind, d.source_id AS id FROM document d JOIN files f ON f.id = d.source_id JOIN objects o USING (object_key) WHERE f.id % 59 = 0", "document", "files", "objects"),
)
def unreadable_objects(spark, d):
    rows = rec.examined(t.document(spark, d), t.files(spark, d), _with_errors(spark, d))
    return rec.document_defects(rows).where("kind = 'unreadable_object'")
