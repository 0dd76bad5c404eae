"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that text extraction collapses.
WHITE_SPACE = r"[\t\n\x0B\f\r\x{20}\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# Bytes a page, preview length, confidence base.
PAGE_BYTES, PREVIEW_CHARS = 1800, 200


def utf8(content: Column) -> Column:
    """Text of bytes, each malformed sequence replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def extract_text(content: Column) -> Column:
    """Upper case, runs of white space as one space, stripped."""
    return F.btrim(F.regexp_replace(F.upper(utf8(content)), WHITE_SPACE, " "), F.lit(" "))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def ocr_confidence(content: Column) -> Column:
    first = F.conv(F.substring(F.sha2(content, 256), 1, 2), 16, 10).cast("int")
    return (F.lit(900).cast("int") + first % 100).cast("decimal(7,3)").__truediv__(F.lit(1000).cast("decimal(5,0)")).cast("decimal(4,3)")


def ocr_page_count(content: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(content) / PAGE_BYTES)).cast("int")


def ocr_job_id(source_id: Column) -> Column:
    return F.concat(F.lit("job_"), F.substring(F.sha1(source_id.cast("string")), 1, 12))


def ocr_payload(source_id: Column, content: Column) -> Column:
    return F.struct(
        source_id.alias("id"), extract_text(content).alias("text"), ocr_confidence(content).cast("double").alias("confidence"),
        ocr_page_count(content).alias("pageCount"), ocr_job_id(source_id).alias("jobId"),
    )


def object_key(source_id: Column) -> Column:
    return F.concat(F.lit("files/"), source_id.cast("string"))


def checksums_differ(ours: Column, theirs: Column) -> Column:
    return F.lower(ours) != F.lower(theirs)


def preview(text: Column) -> Column:
    return F.left(text, F.lit(PREVIEW_CHARS))


def seconds_between(first: Column, last: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", first, last) / 1e6


def to_finite_number(value: Column, fallback: float) -> Column:
    """A finite number or the fallback; null counts as 0."""
    number = F.coalesce(value.cast("string"), F.lit("0")).try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(float(fallback))).otherwise(number)


def _one_place(value: Column) -> Column:
    return F.round(value.cast("decimal(24,6)"), 1).cast("string")


def format_duration(seconds: Column) -> Column:
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    minutes = F.floor(seconds / 60)
    rest = F.floor(seconds - minutes * 60 + 0.5).cast("long")
    return (
        F.when(bad, "unknown")
        .when(seconds < 1, F.concat(F.floor(seconds * 1000 + 0.5).cast("long").cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(_one_place(seconds), F.lit("s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))
    )


def format_seconds(total: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(F.coalesce(F.nanvl(total, F.lit(0.0)), F.lit(0.0)) + 0.5)).cast("long")
    text = lambda c: c.cast("string")
    minutes = F.floor(s / 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return (
        F.when(s < 60, F.concat(text(s), F.lit("s")))
        .when(minutes < 60, F.concat(text(minutes), F.lit("m "), text(s % 60), F.lit("s")))
        .otherwise(F.concat(text(hours), F.lit("h "), text(minutes % 60), F.lit("m")))
    )


def format_bytes(size: Column) -> Column:
    kb = size / 1024
    return (
        F.when(size.isNull(), "unknown size")
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(kb < 1024, F.concat(_one_place(kb), F.lit(" KB")))
        .otherwise(F.concat(_one_place(kb / 1024), F.lit(" MB")))
    )


def gauge(lag: Column, alert: float, target: float) -> list[Column]:
    """state, fill_pct, alert_pct, target_pct of the lag gauge."""
    scale = F.greatest(F.lit(target * 1.15), lag * 1.05, F.lit(1.0))
    state = F.when(lag >= target, "red").when(lag >= alert, "amber").otherwise("calm")
    pct = lambda x: F.least(F.lit(100.0), x / scale * 100)
    return [state.alias("state"), pct(lag).alias("fill_pct"), pct(F.lit(float(alert))).alias("alert_pct"), pct(F.lit(float(target))).alias("target_pct")]


# Where a stage shows.
STAGE_COLUMN = {"CDC_CAPTURED": "captured", "QUEUED": "queued", "CLAIMED": "claimed", "OCR_DONE": "ocr", "STORED": "stored"}


def stage_column(stage: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in STAGE_COLUMN.items() for x in pair))[stage]


def vendor_colour(mode: Column) -> Column:
    return F.when(mode.isin("slow", "rate_limited"), "amber").when(mode.isin("erroring", "down"), "red").when(mode == "healthy", "calm")


def retry_delay_ms(error_class: Column, retry_after_ms: Column, attempt: Column, base_ms: int) -> Column:
    """The wait before the next attempt, without jitter (which adds up to half of it)."""
    return F.when((error_class == "RATE_LIMITED") & retry_after_ms.isNotNull(), retry_after_ms).otherwise(F.expr(f"{base_ms}L") * F.pow(F.lit(2), attempt - 1).cast("long"))


# Names on generated documents.
VENDORS = ["ACME SUPPLY CO", "NORTHWIND TRADING", "GLOBEX INDUSTRIES", "INITECH LLC"]


def padded(source_id: Column) -> Column:
    text = source_id.cast("string")
    return F.when(F.length(text) >= 8, text).otherwise(F.lpad(text, 8, "0"))


def generated_name(source_id: Column) -> Column:
    return F.concat(F.lit("invoice-"), padded(source_id), F.lit(".txt"))


def generated_text(source_id: Column, target_bytes: Column) -> Column:
    """An invoice with lines up to about the target size; its header is never cut."""
    cents = source_id * 37 % 100_000
    amount = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    vendor = F.element_at(F.array(*map(F.lit, VENDORS)), (source_id % 4 + 1).cast("int"))
    head = F.concat(F.lit("INVOICE "), padded(source_id), F.lit("\nVENDOR "), vendor, F.lit("\nAMOUNT DUE "), amount, F.lit("\n"))
    lines = F.greatest(F.lit(0), F.ceil((target_bytes - F.length(head)) / 24)).cast("int")
    filler = F.repeat(F.concat(F.lit("LINE ITEM REFERENCE "), source_id.cast("string"), F.lit(" ")), lines)
    return F.left(F.concat(head, filler), F.greatest(F.length(head), target_bytes.cast("int")))


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WHITE_SPACE}", ""), f"{WHITE_SPACE}$", "")


def upload(filename: Column, text: Column, now: Column) -> list[Column]:
    """filename, content_type, content, byte_size of an uploaded text: null is empty, a blank name is made from the time."""
    name, content = trimmed(filename), F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    own = F.concat(F.lit("upload-"), F.unix_millis(now).cast("string"), F.lit(".txt"))
    named = F.when(F.length(name) > 0, name).otherwise(own)
    return [named.alias("filename"), F.lit("text/plain").alias("content_type"), content.alias("content"), F.octet_length(content).alias("byte_size")]


def decoded(base64: Column) -> Column:
    """Bytes of base64 text: both alphabets, with or without padding; what is in neither alphabet is passed over, and null
    gives no bytes."""
    plain = F.regexp_replace(F.translate(F.coalesce(base64, F.lit("")), "-_", "+/"), "[^A-Za-z0-9+/]", "")
    whole = F.length(plain) - F.when(F.length(plain) % 4 == 1, 1).otherwise(0)
    cut = F.substring(plain, F.lit(1), whole)
    return F.unbase64(F.rpad(cut, (F.ceil(whole / 4) * 4).cast("int"), F.lit("=")))


def clamped_limit(raw: Column, default: int, most: int) -> Column:
    """The leading whole number of a text, the default if there is none above 0, most at most."""
    digits = F.regexp_extract(F.coalesce(raw, F.lit("")), r"^\s*([+-]?[0-9]+)", 1)
    value = F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0))
    return F.when(value > 0, F.least(value, F.lit(most))).otherwise(default).cast("int")


def bulk_verdict(raw: Column, most: int) -> Column:
    """Of what is given for a count: ok, not whole (or not positive, or no number) or too many."""
    value = raw.try_cast("double")
    whole = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value == F.floor(value))
    return F.when(~whole, "not whole").when(value > most, "too many").otherwise("ok")
