import pytest

from haulmark.llm.q_url_filter import ORACLES, RULES, op6_url_filter
from haulmark.llm.url_filter import judge
from tests.llm.oracle import connect, same

SQL = ORACLES["op6_url_filter"]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    same(op6_url_filter(spark, d), connect(d, ["pages"]), SQL)


PAGES = [
    (1, "https://A.Example.ORG/es/x?q#f", None),
    (2, "http://example.org/en/12", ""),
    (3, "http://example.org/en/2", '<a href="http://far.net/x">'),
    (4, "http://com/de/", None),
    (5, "http://x.com", '<a HREF = "//spam.net/">'),
    (6, "http://bad.com/de/1", "<a href='http://spam.net/a'><img src=\"https://Spam.NET/b\">"),
    (7, "http://spam.net/", '<a href="http://bad.com/de/1"> <a href="/own"><a href="http://spam.net/self">'),
    (8, "http://far.net?x=/fr/", None),
    (9, None, '<a href="http://far.net/">'),
    (10, "no scheme", None),
    (None, "://", ""),
    (11, "http://y.com/fr/\nline", None),
    (11, "http://y.com/fr/\nline", None),
    (12, "http://notorg/", None),
    (13, "http://y.com/xx", None),
]
KIND = "page_id long, url string, html string, host string, rule string, verdict string"


def test_equals_sql_on_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(*p, "h", "r", None) for p in PAGES], KIND)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = connect(tmp_path, [])
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same(op6_url_filter(spark, str(tmp_path)), con, SQL)
    rows = {r.page_id: r for r in judge(df, spark.createDataFrame(RULES, "rule string, verdict string")).collect()}
    assert (rows[1].host, rows[1].path, rows[1].rule, rows[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert rows[2].verdict == "block" and rows[3].rule == "org/" and rows[12].rule is None
    assert rows[4].verdict == "block" and rows[5].rule is None and rows[9].host == ""
    assert rows[7].verdict == "block"  # it links to a blocked host and nothing trusted links to it
    assert rows[8].verdict == "allow" and rows[13].verdict == "allow"


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    assert judge(spark.createDataFrame([], KIND), rules).collect() == []
    some = spark.createDataFrame([(*p, "h", "r", None) for p in PAGES], KIND)
    assert {r.verdict for r in judge(some, rules.where("false")).collect()} == {"allow"}
