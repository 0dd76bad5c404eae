"""op8: packing of documents into sequences of 1024 ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from haulmark.llm._common import table
from haulmark.llm.packing import pack_documents


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "leading", 0)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op8_packing": op8_packing}
