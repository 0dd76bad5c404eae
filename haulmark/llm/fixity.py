"""WARC archives, and a fixity audit of two copies of them with Merkle trees.

Pages become WARC records, laid out one after another in archives; an archive is written as rows (archive, offset, record),
so that any store Spark writes to can hold it. A copy's tree is made from its own bytes and nothing else: each record has a
leaf (its offset, length and SHA-256); a node is the hash of the leaves, in order, that start in a range of SPAN bytes of an
archive; FANOUT neighbouring ranges form the range above, up to one node an archive, and archives are joined in the same way
up to one root. Ranges are places in the archive and not ordinal numbers, so a record that a copy lacks or has beyond the
other leaves all other ranges as they are. Two trees are compared from the root: only below nodes that differ, or that one
side lacks, are the children compared, down to the records of damaged ranges.

Defined cases: null urls and html count as empty; a null page_id is written as an empty one; repeated rows are separate
records, next to each other, RECORDS of them an archive at most; very long pages are records like others, with a range of
their own; empty tables give no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm._common import staged

FANOUT, RECORDS, SPAN = 16, 256, 65_536
CRLF = "\r\n"
#: Pages have no time of capture; records need one.
DATE = "1970-01-01T00:00:00Z"
#: So many differing nodes (under 100 bytes each) are broadcast to the level below; beyond that the join shuffles.
BROADCAST_ROWS = 100_000
ARCHIVE = "archive long, offset long, record string"
NODE, LEAF = ["archive", "range"], ["archive", "offset"]


def bucket(key, buckets: int):
    """A whole number under buckets from a string's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % buckets


def warc_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, record): WARC resource records."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), text("page_id"), F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), text("url"),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(text("html")).cast("string"), F.lit(CRLF * 2),
    )
    return pages.select(F.col("page_id").cast("long"), text("url").alias("url"), F.concat(head, text("html"), F.lit(CRLF * 2)).alias("record"))


def layout(records: DataFrame, archives: int) -> DataFrame:
    """(page_id, url, sha256, copy, archive, offset): where each record lies. Only hashes and sizes are shuffled. Equal records
    are counted first and numbered (copy) once they have places, RECORDS of them to an archive, so that no task gets a row for
    each copy of a hot one."""
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    counted = records.select("page_id", "url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
    counted = counted.groupBy("page_id", "url", "sha256", "length").agg(F.count("*").alias("copies"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RECORDS))))
    blocks = blocks.withColumns({"n": F.least(F.lit(RECORDS).cast("long"), F.col("copies") - F.col("block") * RECORDS), "archive": bucket(F.concat_ws("|", key, "url", "block"), archives)})
    before = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "url", "sha256", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("base", F.coalesce(F.sum(F.col("length") * F.col("n")).over(before), F.lit(0)))
    each = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return each.select("page_id", "url", "sha256", (F.col("block") * RECORDS + F.col("i")).alias("copy"), "archive", (F.col("base") + F.col("i") * F.col("length")).alias("offset"))


def write_archives(records: DataFrame, archives: int, path: str) -> None:
    """Records by archive and offset, RECORDS an archive on average. Each distinct record's bytes are shuffled once."""
    places = staged(layout(records, archives), "places").withColumn("page", F.coalesce("page_id", F.lit(-(1 << 63))))
    distinct = records.withColumns({"sha256": F.sha2("record", 256), "page": F.coalesce("page_id", F.lit(-(1 << 63)))}).dropDuplicates(["page", "url", "sha256"])
    rows = distinct.select("page", "url", "sha256", "record").join(places, ["page", "url", "sha256"])
    save(rows.select("archive", "offset", "record").sortWithinPartitions("archive", "offset"), path)


def save(rows: DataFrame, path: str) -> None:
    """Archives hold much text; the stronger codec halves them."""
    rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)


def read_archives(spark, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE).parquet(path)


def leaves(copy: DataFrame) -> DataFrame:
    """(archive, offset, page_id, length, sha256) of a copy's records, from their bytes."""
    own = F.regexp_extract(F.substring("record", 1, 512), r"WARC-Record-ID: <urn:page:(-?[0-9]+)>", 1)
    return copy.select("archive", "offset", own.try_cast("long").alias("page_id"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))


def _parents(nodes: DataFrame, archive, range_, order, text) -> DataFrame:
    """A node for each group of children: the hash of what they say, in order."""
    children = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    joined = F.array_join(F.transform(children, lambda c: c["t"]), "")
    up = nodes.groupBy(archive.alias("g"), range_.alias("r")).agg(F.sha2(joined, 256).alias("hash"))
    return up.select(F.col("g").alias("archive"), F.col("r").alias("range"), "hash")


def depths(*sides: DataFrame) -> tuple[int, int]:
    """Levels above the ranges of SPAN bytes in an archive, and above archives, that hold all sides' leaves."""
    tops = [side.agg(F.max("offset"), F.max("archive")).first() for side in sides]

    def levels(n: int) -> int:
        out = 0
        while n > 0:
            n, out = n // FANOUT, out + 1
        return out

    return levels(max((t[0] or 0) // SPAN for t in tops)), levels(max(t[1] or 0 for t in tops))


def tree(own: DataFrame, depth: tuple[int, int]) -> list[DataFrame]:
    """leaves -> every level above them (archive, range, hash), the root last. Above archives' own roots, range stays 0."""
    said = F.concat_ws(":", "offset", "length", "sha256")
    out = [staged(_parents(own, F.col("archive"), F.expr(f"offset div {SPAN}"), F.struct("offset", "sha256"), F.concat(said, F.lit(","))), "nodes")]
    named = F.concat_ws(":", "range", "hash")
    for _ in range(depth[0]):
        out.append(staged(_parents(out[-1], F.col("archive"), F.expr(f"range div {FANOUT}"), F.col("range"), F.concat(named, F.lit(","))), "nodes"))
    named = F.concat_ws(":", "archive", "hash")
    for _ in range(depth[1]):
        out.append(staged(_parents(out[-1], F.expr(f"archive div {FANOUT}"), F.lit(0).cast("long"), F.col("archive"), F.concat(named, F.lit(","))), "nodes"))
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def differing(ours: list[DataFrame], theirs: list[DataFrame], depth: tuple[int, int]) -> DataFrame:
    """(archive, range) of the ranges of SPAN bytes that differ, found from the root by descending into differing nodes only."""
    bad = None
    for level in range(len(ours) - 1, -1, -1):
        joint = level >= depth[0]
        group, above = (F.expr(f"archive div {FANOUT}"), F.lit(0).cast("long")) if joint else (F.col("archive"), F.expr(f"range div {FANOUT}"))
        a, b = (x[level].withColumns({"g": group, "s": above}) for x in (ours, theirs))
        if bad is not None:
            wanted = _small(bad.select(F.col("archive").alias("g"), F.col("range").alias("s")))
            a, b = (x.join(wanted, ["g", "s"], "left_semi") for x in (a, b))
        pairs = a.select(*NODE, F.col("hash").alias("x")).join(b.select(*NODE, F.col("hash").alias("y")), NODE, "full")
        bad = staged(pairs.where(~F.col("x").eqNullSafe(F.col("y"))).select(*NODE), "differing")
    return bad


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Two copies (archive, offset, record) -> (page_id, archive, offset, length, sha256, status) of every record of either:
    ok, corrupt (other bytes there), missing (not in the replica) or extra (only in the replica)."""
    ours, theirs = (staged(leaves(x), "leaves") for x in (primary, replica))
    depth = depths(ours, theirs)
    bad = _small(differing(tree(ours, depth), tree(theirs, depth), depth))
    a, b = (x.withColumn("range", F.expr(f"offset div {SPAN}")) for x in (ours, theirs))
    columns = ["page_id", "length", "sha256"]
    well = a.join(bad, NODE, "left_anti").select(*LEAF, *columns, F.lit("ok").alias("status"))
    side = lambda x, name: x.join(bad, NODE, "left_semi").select(*LEAF, F.struct(*columns).alias(name))
    both = side(a, "x").join(side(b, "y"), LEAF, "full")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x.sha256") == F.col("y.sha256"), "ok").otherwise("corrupt")
    told = both.select(*LEAF, F.coalesce("x", "y").alias("z"), status.alias("status")).select(*LEAF, "z.*", "status")
    return well.unionByName(told).select("page_id", "archive", "offset", "length", "sha256", "status")
