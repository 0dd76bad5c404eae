"""Reconciliation of source files, documents, ledger and object store, by membership and content.

Everything is compared by hash, computed where a row is read: blobs and texts are never shuffled. One snapshot of each
table is read, so there are no transient defects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions import text as fn

KINDS = ["checksum", "ocr_text", "missing_object", "orphan_document", "missing_document", "missing_ledger", "orphan_ledger", "permanent_failure", "unreadable_object"]


def source_hashes(files: DataFrame) -> DataFrame:
    return files.select("id", fn.sha256_hex(F.col("content")).alias("source_sha"), fn.sha256_hex(fn.extract_text(F.col("content"))).alias("text_sha"))


def object_hashes(objects: DataFrame) -> DataFrame:
    """objects may have a column error: such objects are there but could not be read."""
    error = F.col("error") if "error" in objects.columns else F.lit(None).cast("string")
    return objects.select("object_key", fn.sha256_hex(F.col("bytes")).alias("stored_sha"), error.isNotNull().alias("unreadable"))


def examined(document: DataFrame, files: DataFrame, objects: DataFrame) -> DataFrame:
    """Every document with what its source and its object say."""
    ours = document.select("source_id", "object_key", "checksum_sha256", fn.sha256_hex(F.col("ocr_text")).alias("ocr_sha"))
    source = source_hashes(files).withColumnRenamed("id", "source_id")
    return ours.join(source, "source_id", "left").join(object_hashes(objects), "object_key", "left")


def document_kinds() -> Column:
    """What is wrong with an examined document. One that has no source is an orphan and nothing else."""
    there = F.col("source_sha").isNotNull()
    stored = F.col("unreadable").isNotNull()
    checks = {
        "orphan_document": ~there,
        "checksum": there & (fn.checksums_differ(F.col("checksum_sha256"), F.col("source_sha")) | (F.coalesce("stored_sha", "source_sha") != F.col("source_sha"))),
        "ocr_text": there & ~F.col("ocr_sha").eqNullSafe(F.col("text_sha")),
        "missing_object": there & ~stored,
        "unreadable_object": there & F.coalesce("unreadable", F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(bad, F.lit(kind)) for kind, bad in checks.items())))


def document_defects(rows: DataFrame) -> DataFrame:
    """(kind, id): of examined documents."""
    return rows.select(F.explode(document_kinds()).alias("kind"), F.col("source_id").alias("id"))


def membership_defects(files: DataFrame, document: DataFrame, ledger: DataFrame) -> DataFrame:
    """(kind, id): ids that one side has and another lacks, from one pass over the three id sets."""
    mark = lambda df, key, n: df.select(F.col(key).alias("id"), F.lit(n).alias("side"))
    sides = mark(files, "id", 1).union(mark(document, "source_id", 2)).union(mark(ledger, "source_id", 4))
    has = sides.groupBy("id").agg(F.bit_or("side").alias("has"))
    in_ = lambda n: F.col("has").bitwiseAND(n) != 0
    found = F.array_compact(
        F.array(F.when(in_(1) & ~in_(2), F.lit("missing_document")), F.when(in_(1) & ~in_(4), F.lit("missing_ledger")), F.when(~in_(1) & in_(4), F.lit("orphan_ledger")))
    )
    return has.select(F.explode(found).alias("kind"), "id")


def permanent_failures(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'FAILED_PERMANENT'").select(F.lit("permanent_failure").alias("kind"), F.col("source_id").alias("id"))


def defects(files: DataFrame, document: DataFrame, ledger: DataFrame, objects: DataFrame) -> DataFrame:
    """(kind, id): everything that is wrong."""
    return document_defects(examined(document, files, objects)).unionByName(membership_defects(files, document, ledger)).unionByName(permanent_failures(ledger))


def object_outcomes(document: DataFrame, objects: DataFrame) -> DataFrame:
    """(source_id, outcome): read, missing or unreadable, of each document's object."""
    joined = document.select("source_id", "object_key").join(object_hashes(objects), "object_key", "left")
    return joined.select("source_id", F.when(F.col("unreadable").isNull(), "missing").when(F.col("unreadable"), "unreadable").otherwise("read").alias("outcome"))


def summary(files: DataFrame, document: DataFrame, ledger: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: counts of the three tables, of documents that have a source, of defects, and whether all is well. Each table
    is read once for membership and once for content."""
    mark = lambda df, key, n, failed: df.select(F.col(key).alias("id"), F.lit(n).alias("side"), failed.alias("failed"))
    well = F.lit(False)
    sides = mark(files, "id", 1, well).union(mark(document, "source_id", 2, well)).union(mark(ledger, "source_id", 4, F.col("status") == "FAILED_PERMANENT"))
    rows = lambda n: F.count_if(F.col("side") == n)
    ids = sides.groupBy("id").agg(rows(1).alias("s"), rows(2).alias("d"), rows(4).alias("l"), F.count_if("failed").alias("failed"))
    gone = lambda one, other: F.when((F.col(one) > 0) & (F.col(other) == 0), 1).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    members = ids.agg(
        total("s").alias("source_rows"), total("d").alias("document_rows"), total("l").alias("ledger_rows"),
        total(gone("s", "d") + gone("s", "l") + gone("l", "s") + F.col("failed")).alias("apart"),
    )
    found = document_kinds()
    content = examined(document, files, objects).agg(F.count_if(F.col("source_sha").isNotNull()).alias("rows_examined"), total(F.size(found)).alias("wrong"))
    both = members.crossJoin(content).withColumn("defects", F.col("apart") + F.col("wrong"))
    equal = (F.col("source_rows") == F.col("document_rows")) & (F.col("source_rows") == F.col("ledger_rows"))
    return both.select("source_rows", "document_rows", "ledger_rows", "rows_examined", "defects", (equal & (F.col("defects") == 0)).alias("clean"))
