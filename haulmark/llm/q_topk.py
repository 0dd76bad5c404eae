"""op2: exact top 10 of embeddings for every hundredth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulmark.llm._common import staged, table
from haulmark.llm.topk import integer_vectors, top_k


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = staged(integer_vectors(table(spark, sf_dir, "embeddings"), 1024), "vectors")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

QUERIES = {"op2_topk": op2_topk}
ORACLES = {"op2_topk": SQL}
