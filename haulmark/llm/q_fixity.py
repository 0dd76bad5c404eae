"""op3: fixity audit of pages as WARC archives against a replica with known damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm._common import new_folder, table
from haulmark.llm.fixity import DATE, RECORDS, audit, bucket, read_archives, save, warc_records, write_archives

#: The replica has lost one in so many records, changed another, and holds a third twice.
DAMAGE = 64


def damaged(copy: DataFrame) -> DataFrame:
    """A replica of archives: by a hash of a record's place it is lost (0), its first bytes are changed (1), or another copy of
    it stands far behind the archive's end (2)."""
    fate = bucket(F.concat_ws("|", F.lit("damage"), "archive", "offset"), DAMAGE)
    changed = F.when(fate == 1, F.concat(F.lit("warc"), F.substring("record", F.lit(5), F.length("record")))).otherwise(F.col("record"))
    kept = copy.where(fate != 0).select("archive", "offset", changed.alias("record"))
    return kept.union(copy.where(fate == 2).select("archive", F.col("offset") + (1 << 40), "record"))


def op3_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, ours, theirs = table(spark, sf_dir, "pages"), new_folder(spark, "primary"), new_folder(spark, "replica")
    write_archives(warc_records(pages), max(1, -(-pages.count() // RECORDS)), ours)
    save(damaged(read_archives(spark, ours)), theirs)
    return audit(read_archives(spark, ours), read_archives(spark, theirs))


_RECORD = f"""'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || e || 'WARC-Date: {DATE}' || e
  || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e"""
SQL = f"""
WITH r AS (SELECT page_id, coalesce(url, '') AS url, {_RECORD} AS record FROM pages, (SELECT chr(13) || chr(10) AS e)),
h AS (SELECT page_id, url, record, strlen(record) AS length, sha256(record) AS sha256,
  (row_number() OVER (PARTITION BY page_id, url, record) - 1) // {RECORDS} AS block FROM r),
b AS (SELECT *, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '') || '|' || url || '|' || block), 1, 8))::BIGINT
  % (SELECT greatest(1, (count(*) + {RECORDS} - 1) // {RECORDS}) FROM pages) AS archive FROM h),
p AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, url, sha256, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM b),
f AS (SELECT *, ('0x' || substr(md5('damage|' || archive || '|' || "offset"), 1, 8))::BIGINT % {DAMAGE} AS fate FROM p)
SELECT page_id, archive, "offset", length, sha256, CASE fate WHEN 0 THEN 'missing' WHEN 1 THEN 'corrupt' ELSE 'ok' END AS status FROM f
UNION ALL SELECT page_id, archive, "offset" + {1 << 40}, length, sha256, 'extra' FROM f WHERE fate = 2
"""

QUERIES = {"op3_fixity": op3_fixity}
ORACLES = {"op3_fixity": SQL}
