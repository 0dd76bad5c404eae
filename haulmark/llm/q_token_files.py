"""op1: token-id files over documents, written and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from haulmark.llm._common import new_folder, table
from haulmark.llm.token_files import read_token_files, write_token_files


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), "dropped", 2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op1_token_files": op1_token_files}
