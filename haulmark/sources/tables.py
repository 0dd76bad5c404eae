"""Readers: files, objects, documents, ledger, events and change envelopes.

Production stores are read by Spark's own connectors (jdbc, kafka, binaryFile); here the same views are derived from
the standard tables, with known faults, so that every operator has whole-table input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark import schemas
from haulmark.functions import text as fn

#: "now" of every derived view and query, in seconds since 1970.
AS_OF = 1_706_745_600
EPOCH = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF))


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1) -> DataFrame:
    """A table of a database, read by key ranges in parallel. Untested here: needs the database's driver."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()


def kafka(spark: SparkSession, servers: str, topic: str, per_batch: int | None = None) -> DataFrame:
    """A topic from its start. Untested here: needs the connector."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return (reader.option("maxOffsetsPerTrigger", per_batch) if per_batch else reader).load()


def stored_objects(spark: SparkSession, root: str) -> DataFrame:
    """(object_key, bytes) of every object below a folder or bucket, keys relative to it. Spark passes over files without bytes;
    no file without content is ever stored."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.instr("path", root.rstrip("/").split("://")[-1])
    return found.select(F.expr("path"), F.col("content").alias("bytes")).select(
        F.expr("path").substr(at + F.lit(len(root.rstrip("/").split("://")[-1]) + 1), F.length("path")).alias("object_key"), "bytes"
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids start at 1."""
    docs = table(spark, sf_dir, "documents")
    made = F.timestamp_seconds(F.lit(EPOCH) + (F.col("doc_id") + 1) * 60)
    return docs.select(
        (F.col("doc_id") + 1).alias("id"), F.concat(F.lit("doc-"), F.col("doc_id") + 1, F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("content_type"),
        F.encode("text", "UTF-8").alias("content"), F.octet_length("text").alias("byte_size"), made.alias("created_at"), made.alias("updated_at"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).where("id % 79 <> 0")
    changed = F.concat("content", F.encode(F.lit("!"), "UTF-8"))
    return rows.select(fn.object_key(F.col("id")).alias("object_key"), F.when(F.col("id") % 73 == 0, changed).otherwise(F.col("content")).alias("bytes"))


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    good = rows.where("id % 97 <> 0")
    both = good.withColumn("source_id", F.col("id")).union(rows.where("id % 101 = 0").withColumn("source_id", F.col("id") + 10_000_000))
    i, content = F.col("id"), F.col("content")
    own = F.col("source_id") == i
    text = fn.extract_text(content)
    return both.select(
        "source_id", "filename", "content_type", fn.object_key(F.col("source_id")).alias("object_key"), "byte_size",
        F.when(own & (i % 89 == 0), F.repeat(F.lit("0"), 64)).otherwise(fn.sha256_hex(content)).alias("checksum_sha256"),
        F.when(own & (i % 83 == 0), F.concat(text, F.lit(" STALE"))).otherwise(text).alias("ocr_text"),
        fn.ocr_confidence(content).alias("ocr_confidence"), fn.ocr_page_count(content).alias("ocr_page_count"), fn.ocr_job_id(F.col("source_id")).alias("ocr_vendor_job_id"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("source_id") % 100_003 * 7).alias("migrated_at"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, status) as the reconciler reads it."""
    ids = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"))
    both = ids.where("id % 67 <> 0").select(F.col("id").alias("source_id"), "id").union(ids.where("id % 61 = 0").select(F.col("id") + 20_000_000, "id"))
    status = F.when((F.col("id") % 71 == 0) & (F.col("source_id") == F.col("id")), "FAILED_PERMANENT").otherwise("DONE")
    return both.select("source_id", status.alias("status"))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger with all statuses, lanes and counters, by id."""
    i = F.col("id")
    ids = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"))
    status = F.element_at(F.array(*map(F.lit, schemas.STATUSES)), (i % 6 + 1).cast("int"))
    payload = F.struct(i.alias("id"), F.lit("T").alias("text"), F.lit(0.9).alias("confidence"), F.lit(1).alias("pageCount"), fn.ocr_job_id(i).alias("jobId"))
    return ids.select(
        i.alias("source_id"), F.when(i % 2 == 0, "cdc").otherwise("backfill").alias("lane"), status.alias("status"), (i % 5).cast("int").alias("attempts"),
        (i % 7).cast("int").alias("consecutive_failures"), (F.lit(1_700_000_000_000) + i).alias("source_version"),
        F.when(i % 11 != 0, F.timestamp_seconds(F.lit(EPOCH) + i * 60)).alias("source_created_at"), F.when(i % 6 == 3, F.sha1(i.cast("string"))).alias("checksum_sha256"),
        F.when(i % 3 == 0, payload).alias("ocr_payload"), F.when(i % 6 >= 4, F.concat(F.lit("error "), i)).alias("last_error"),
        F.timestamp_seconds(F.lit(AS_OF) - i % 120).alias("updated_at"),
    )


def migration_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    error = kind == "error"
    stage = (
        F.when(kind == "signup", "CDC_CAPTURED").when(kind == "view", "CLAIMED").when(kind == "click", "OCR_DONE").when(kind == "purchase", "STORED")
        .when(error & (F.col("event_id") % 2 == 0), "BREAKER_OPEN").when(error, "BREAKER_CLOSED")
    )
    lane = F.when(~error, F.when(F.col("user_id") % 2 == 0, "cdc").otherwise("backfill"))
    return e.select((F.col("event_id") + 1).alias("id"), F.when(~error, F.col("user_id")).alias("source_id"), stage.alias("stage"), lane.alias("lane"), F.col("props").alias("detail"), F.col("ts").cast("timestamp").alias("created_at"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, value): change envelopes as JSON text, in commit order; some are tombstones, malformed or of other kinds."""
    e, kind, i = table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    op = F.when(kind == "signup", "c").when(kind == "view", "r").when(kind == "error", "d").otherwise("u")
    image = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("f"), "user_id").alias("filename"), F.lit(10).alias("byte_size"))
    gone = op == "d"
    envelope = F.to_json(
        F.struct(F.when(i % 103 == 0, F.lit("t")).otherwise(op).alias("op"), F.when(gone, image).alias("before"), F.when(~gone & (i % 107 != 0), image).alias("after"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    )
    value = F.when(i % 109 == 0, F.lit(None).cast("string")).when(i % 113 == 0, F.lit("this is not json")).otherwise(envelope)
    return e.select(i.alias("seq"), value.alias("value"))


def generated(spark: SparkSession, first: int, last: int, target_bytes: Column) -> DataFrame:
    """Invoices with ids first to last, where target_bytes may use the column id."""
    rows = spark.range(first, last + 1)
    return rows.select("id", fn.generated_name(F.col("id")).alias("filename"), fn.generated_text(F.col("id"), target_bytes).alias("text"))
