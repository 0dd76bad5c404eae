"""Token-id files: each document's ids as one zstandard frame under a shared, trained dictionary.

Layout below the given folder (all Parquet, so that any store Spark writes to can hold it):

* ``dictionary``: one row (hash, dictionary); the hash is SHA-256 of the dictionary's bytes.
* ``blocks``: rows in ascending doc_id order over (part, block). ``payload`` holds the block's frames one
  after another; ``offsets`` is the index into it (one more entry than documents), ``doc_ids``, ``counts``
  and ``starts`` (ids of the part before each document) run beside it. ``first_doc``/``last_doc`` let a
  point lookup skip blocks by Parquet statistics; ``dict_hash`` names the dictionary.
* ``parts``: (part, base): ids in all parts before.

Defined cases: a null text counts as empty (only the end id is written); a null doc_id sorts first; repeated
rows are separate documents, next to each other; rows of one doc_id are ordered by a hash of their text;
an empty table gives files without blocks. Only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.llm._common import frugal, small_batches, text_or_empty
from haulmark.llm.chunked_tokens import encoded, encoder

#: Bounds of the sample the dictionary is trained on: documents, characters of each, ids of each.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_IDS = 400, 65_536, 8_192
DICT_BYTES, LEVEL = 65_536, 3
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 2_048

BLOCKS = (
    "part int, block int, dict_hash string, dtype string, first_doc long, last_doc long, n_tokens long,"
    " doc_ids array<long>, counts array<long>, starts array<long>, offsets array<long>, payload binary"
)
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long"


def _dtype(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer: str, boundary: str, end_id: int) -> bytes:
    """From a bounded sample: the SAMPLE_DOCS different texts of at most SAMPLE_CHARS characters with the smallest hashes.
    Too few samples to train on: their own bytes serve as the dictionary."""
    import zstandard

    short = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("text", F.xxhash64("text").alias("hash"))
    least = [r.hash for r in short.select("hash").distinct().orderBy("hash").limit(SAMPLE_DOCS).collect()]
    sample = short.where(F.col("hash").isin(least)).dropDuplicates(["hash"]).collect() if least else []
    sample.sort(key=lambda r: r.hash)
    enc = encoder(tokenizer, boundary)
    kind = _dtype(enc.vocabulary, end_id)
    ids = [np.frombuffer(enc.encode(r.text), "<u4")[:SAMPLE_IDS].astype(kind).tobytes() for r in sample]
    try:
        return zstandard.train_dictionary(DICT_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b"".join(ids)[:DICT_BYTES]


def _zdict(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, boundary: str, end_id: int, dictionary: bytes | None = None
) -> None:
    """One range shuffle by doc_id; each task encodes, compresses and lays out its own stretch."""
    spark = docs.sparkSession
    small_batches(spark)
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer, boundary, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        enc, end = encoder(tokenizer, boundary), np.array([end_id], "<u4").tobytes()
        kind = _dtype(enc.vocabulary, end_id)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(dictionary))
        ids, counts, starts, frames, held = [], [], [], [], 0

        def flush():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int64)
            real = [x for x in ids if x is not None]
            cols = [part, block, digest, kind, min(real, default=None), max(real, default=None), sum(counts)]
            cols += [ids, counts, starts, offsets.tolist(), b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3]
            kinds += [*[pa.list_(pa.int64())] * 4, pa.binary()]
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), encoded(enc, batch.column(1)), strict=True):
                raw = np.frombuffer(own + end, "<u4")
                frame = press.compress(raw.astype(kind).tobytes())
                ids.append(doc_id)
                counts.append(len(raw))
                starts.append(start)
                frames.append(frame)
                start += len(raw)
                held += len(frame)
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    ids, counts, starts, frames, held, block = [], [], [], [], 0, block + 1
        if ids:
            yield flush()

    order = ("doc_id", "_tie", "_row")  # the last, a row's place in the input, lets copies of a row stand in several parts
    (
        docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
        .withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(frugal(lay_out), BLOCKS)
        .write.parquet(f"{path}/blocks")
    )
    by_part = blocks(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task of the writer
    by_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(1).write.parquet(
        f"{path}/parts"
    )


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row.hash, bytes(row.dictionary)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per document, from the frames: doc_id, start, n_tokens, ids_crc32, frame_bytes."""
    digest, dictionary = _dictionary(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))
        for batch in batches:
            for b in range(batch.num_rows):
                block = {n: batch.column(n)[b].as_py() for n in batch.schema.names}
                if block["dict_hash"] != digest:
                    raise ValueError(f"block was written with dictionary {block['dict_hash']}, not {digest}")
                payload, at, out = memoryview(block["payload"]), block["offsets"], []
                for i, doc_id in enumerate(block["doc_ids"]):
                    ids = np.frombuffer(press.decompress(payload[at[i] : at[i + 1]]), block["dtype"]).astype("<u4")
                    if len(ids) != block["counts"][i]:
                        raise ValueError(f"document {doc_id}: {len(ids)} ids in its frame, {block['counts'][i]} in the index")
                    out.append((doc_id, block["base"] + block["starts"][i], len(ids), zlib.crc32(ids.tobytes()), at[i + 1] - at[i]))
                names = [c.split()[0] for c in ROWS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    columns = ["dict_hash", "dtype", "base", "doc_ids", "counts", "starts", "offsets", "payload"]
    spread = blocks(spark, path).join(parts, "part").select(*columns)
    return spread.mapInArrow(frugal(decode), ROWS)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each document with this doc_id: only blocks whose range covers it are read, and only its frames
    decompressed."""
    import zstandard

    _, dictionary = _dictionary(spark, path)
    press = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))
    found = blocks(spark, path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    hits = (
        found.select("part", "block", "dtype", "payload", F.posexplode("doc_ids").alias("i", "d"), "offsets")
        .where(F.col("d") == doc_id)
        .select("part", "block", "i", "dtype", F.expr("substring(payload, offsets[i] + 1, offsets[i + 1] - offsets[i])").alias("frame"))
        .orderBy("part", "block", "i")
    )
    return [np.frombuffer(press.decompress(bytes(r.frame)), r.dtype).tolist() for r in hits.toLocalIterator()]
