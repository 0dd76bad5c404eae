"""Explicit schemas and enumerations of everything that is read or written."""

from __future__ import annotations

STATUSES = ["PENDING", "IN_FLIGHT", "OCR_DONE", "DONE", "FAILED_RETRYABLE", "FAILED_PERMANENT"]
TERMINAL = ["DONE", "FAILED_PERMANENT"]
STAGES = ["CDC_CAPTURED", "QUEUED", "CLAIMED", "OCR_DONE", "STORED", "RETRY", "DLQ", "BREAKER_OPEN", "BREAKER_CLOSED"]
LANES = ["backfill", "cdc"]
OPS = ["c", "r", "u", "d"]
VENDOR_MODES = ["healthy", "slow", "rate_limited", "erroring", "down"]
ERROR_CLASSES = ["PERMANENT", "RATE_LIMITED", "TRANSIENT"]

FILES = "id long, filename string, content_type string, content binary, byte_size int, created_at timestamp, updated_at timestamp"
DOCUMENT = (
    "source_id long, filename string, content_type string, object_key string, byte_size int, checksum_sha256 string, ocr_text string,"
    " ocr_confidence decimal(4,3), ocr_page_count int, ocr_vendor_job_id string, migrated_at timestamp"
)
OCR_PAYLOAD = "struct<id:bigint,text:string,confidence:double,pageCount:int,jobId:string>"
STATE = (
    "source_id long, lane string, status string, attempts int, consecutive_failures int, source_version long, source_created_at timestamp,"
    f" checksum_sha256 string, ocr_payload {OCR_PAYLOAD}, last_error string, updated_at timestamp"
)
EVENT = "id long, source_id long, stage string, lane string, detail string, created_at timestamp"
CHECKPOINT = "range_start long, range_end long, status string, claimed_at timestamp"
OBJECTS = "object_key string, bytes binary"
ROW_IMAGE = "struct<id:bigint,filename:string,content_type:string,byte_size:int,created_at:bigint>"
ENVELOPE = f"op string, before {ROW_IMAGE}, after {ROW_IMAGE}, ts_ms long, _corrupt_record string"
BACKFILL_MESSAGE = "lane string, sourceIds array<bigint>"
DLQ = "sourceId long, lane string, errorClass string, attempts int, lastError string"
