"""op9: personal data in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm._common import table
from haulmark.llm.pii import KINDS, joined, personal_spans


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_spans(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return rows.select("doc_id", *map(count, range(4)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op9_pii": op9_pii}
