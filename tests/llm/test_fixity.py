import hashlib

import pytest
from pyspark.sql import functions as F

from haulmark.llm import fixity
from haulmark.llm._common import new_folder
from haulmark.llm.fixity import audit, depths, differing, leaves, read_archives, tree, warc_records, write_archives
from haulmark.llm.q_fixity import SQL, op3_fixity
from tests.llm.oracle import connect, same

KIND = "page_id long, url string, html string, record string, sha256 string"


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    same(op3_fixity(spark, d), connect(d, ["pages"]), SQL)


def test_odd_pages_equal_sql(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "<p>" + "é" * (i % 50), "r", "s") for i in range(40)]
    rows += [(None, None, None, None, None), (7, None, "", "", ""), (8, "u", "x" * 1_000_000, "", ""), (None, "u", "-", "", "")]
    rows += [(99, "http://copied", "<p>again and again", "r", "s")] * 700
    spark.createDataFrame(rows, KIND).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same(op3_fixity(spark, str(tmp_path)), con, SQL)


def archives(spark, n=300, count=3):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * (i % 50), "r", "s") for i in range(n)]
    pages = spark.createDataFrame([*rows, (None, None, None, None, None), (5, "http://h/5", "<p>xxxxx", "r", "s")], KIND)
    path = new_folder(spark, "test")
    write_archives(warc_records(pages), count, path)
    return read_archives(spark, path)


def test_records_lie_one_after_another(spark):
    own = archives(spark)
    assert own.count() == 302 and own.select("archive").distinct().count() == 3
    for a in range(3):
        at = 0
        for r in own.where(F.col("archive") == a).orderBy("offset").collect():
            assert r.offset == at and r.record.startswith("WARC/1.0\r\n") and "\r\nWARC-Date: " in r.record
            head, _, body = r.record.partition("\r\n\r\n")
            assert int(head.rpartition("Content-Length: ")[2]) == len(body.removesuffix("\r\n\r\n"))
            at += len(r.record.encode())


def test_damage_is_located(spark, monkeypatch):
    monkeypatch.setattr(fixity, "SPAN", 1_000)
    own = archives(spark).cache()
    assert audit(own, own).where("status <> 'ok'").count() == 0
    rows = {a: own.where(F.col("archive") == a).orderBy("offset").collect() for a in range(3)}
    place = lambda r: F.struct("archive", "offset") == F.struct(F.lit(r.archive).cast("long"), F.lit(r.offset).cast("long"))
    other = own.where(~place(rows[1][40]))
    other = other.withColumn("record", F.when(place(rows[0][0]) | place(rows[0][17]), F.upper("record")).otherwise(F.col("record")))
    other = other.withColumn("offset", F.when(place(rows[2][3]), F.col("offset") + 1).otherwise(F.col("offset")))
    more = spark.createDataFrame([(0, 10_000_000, "more"), (9, 0, "an archive more")], fixity.ARCHIVE)
    found = audit(own, other.union(more)).where("status <> 'ok'").collect()
    want = {(1, rows[1][40].offset, "missing"), (0, 0, "corrupt"), (0, rows[0][17].offset, "corrupt"), (2, rows[2][3].offset, "missing"), (2, rows[2][3].offset + 1, "extra")}
    assert {(r.archive, r.offset, r.status) for r in found} == want | {(0, 10_000_000, "extra"), (9, 0, "extra")}
    gone = audit(own, own.where("archive = 77"))
    assert gone.count() == 302 and gone.where("status = 'missing'").count() == 302


def test_root_is_the_hash_of_hashes(spark, monkeypatch):
    monkeypatch.setattr(fixity, "SPAN", 300)
    own = leaves(archives(spark, 60, 1)).cache()
    depth = depths(own)
    rows = own.orderBy("offset").collect()
    level = {}
    for r in rows:
        level.setdefault(r.offset // 300, []).append(f"{r.offset}:{r.length}:{r.sha256},")
    level = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in level.items()}
    while max(level) > 0:
        up = {}
        for k in sorted(level):
            up.setdefault(k // 16, []).append(f"{k}:{level[k]},")
        level = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in up.items()}
    levels = tree(own, depth)
    assert depth == (2, 0) and levels[-1].count() == 1 and levels[-1].first().hash == level[0]
    assert differing(levels, levels, depth).count() == 0


def test_empty_table(spark):
    path = new_folder(spark, "test")
    write_archives(warc_records(spark.createDataFrame([], KIND)), 1, path)
    own = read_archives(spark, path)
    assert audit(own, own).collect() == []
