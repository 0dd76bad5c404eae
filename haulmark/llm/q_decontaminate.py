"""op4: documents that leak benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulmark.llm._common import table
from haulmark.llm.decontaminate import leaks


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
