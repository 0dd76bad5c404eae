"""op5: language of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm._common import table
from haulmark.llm.langid import fit, held_out, predict


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    learnable = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1
    langs, p = fit(docs.where(learnable), path)
    found = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), path, langs, p)
    return found.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op5_langid": op5_langid}
