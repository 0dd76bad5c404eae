import hashlib
import re
import time
from itertools import accumulate

from haulmark.llm import pii
from haulmark.llm.pii import KINDS, joined, personal_spans, redacted
from haulmark.llm.q_pii import op9_pii

SCHEMA = "doc_id long, text string, spans string, email string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m.group())]
    counts = [sum(s[1] == k for s in spans) for k in range(4)]
    return counts, hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


TEXTS = [
    None, "", "a@b.c_d@e.f-g.h. x@y z@@w.v ..@-.- a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 000001.02.3.255 1.1.1.99999999999999999999",
    "😀 4111 1111-1111 1111 and 4111111111111112 4111 1111 1111 1111 2", "+1 (555) 123-4567. +49.30.1234567890123 ++1234567890 +1-----",
    "+41 11 11 11 11 11 11 11", "9" * 3_000, ("1 " * 4_000), "a" * 50_000 + "@b.c", ("x@y.zz, " * 300), "é@x.y ß.a@x.y +12 34567890١", "4111111111111111@8.8.8.8",
]


def test_base_spans_equal_plain_patterns(spark, tmp_path):
    rows = [(i, t, "s", None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "s", ""), (5, TEXTS[5], "s", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id is None, r.doc_id), [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in op9_pii(spark, str(tmp_path)).collect())
    assert got == sorted((((i is None), i), *brute(t)) for i, t, *_ in rows)


def test_base_spans_of_documents(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows = op9_pii(spark, d).collect()
    assert len(rows) == len(texts) and sum(r.n_email for r in rows) > 0
    for r in rows:
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == brute(texts[r.doc_id])


def test_disclosing_terms(spark):
    mail = "boss@corp.example"
    docs = [(i, f"note {i} about zanzibar {mail} from the office number {i}", "", "") for i in range(6)]
    docs += [(100 + i, f"the office {i} is open and the number is new", "", "") for i in range(60)]
    docs += [(200, f"Zanzibar! we said zanzibars, {mail.upper()} on ZANZIBAR", "", ""), (201, "zanzibar alone", "", "")]
    docs += [(300, f"kilimanjaro once.person@corp.example", "", "")] * 5  # copies of one context are no evidence
    rows = {r.doc_id: r for r in personal_spans(spark.createDataFrame(docs, SCHEMA)).select("doc_id", "text", "spans", joined("spans").alias("j"), redacted(pii.F.col("text"), pii.F.col("spans")).alias("clean")).collect()}
    assert rows[200].clean == "[TERM]! we said zanzibars, [EMAIL] on [TERM]"
    assert rows[201].spans == [] and rows[100].spans == [] and rows[300].clean == "kilimanjaro [EMAIL]"
    assert rows[3].j.split(",")[0].startswith("term:") and "office" in rows[3].clean


def test_overlaps_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x 4111111111111111@8.8.8.8 y +4111111111111111", "", "")], SCHEMA)
    r = personal_spans(df).select(redacted(pii.F.col("text"), pii.F.col("spans"))).first()
    assert r[0] == "x [EMAIL] y +[CARD]" or r[0] == "x [EMAIL] y [PHONE]"
    assert personal_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_matches_in_one_text(spark):
    """Linear in the number of matches: each would take minutes if an array grew by one each time."""
    texts = ["12," * 64_000, "a@b.c " * 10_000, "4111111111111111," * 10_000, "1.2.3.4 boss@corp.example 12 " * 5_000]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    began = time.time()
    rows = personal_spans(df).select("doc_id", "text", "spans", redacted(pii.F.col("text"), pii.F.col("spans")).alias("clean")).collect()
    took = time.time() - began
    for r in rows:
        spans = [(m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], r.text) if valid(kind, m.group())]
        assert sorted(tuple(s) for s in r.spans) == sorted(spans)
    clean = {r.doc_id: r.clean for r in rows}
    assert clean[0] == texts[0] and clean[1] == "[EMAIL] " * 10_000 and clean[2] == "[CARD]," * 10_000 and clean[3] == "[IP] [EMAIL] 12 " * 5_000
    assert took < 240


def test_terms_that_overlap_base_spans_give_way(spark):
    base = [(0, 0, 4), (10, 1, 20), (30, 2, 31)]
    terms = [(2, 4, 6), (4, 4, 8), (8, 4, 11), (12, 4, 14), (19, 4, 25), (25, 4, 29), (26, 4, 40), (31, 4, 35)]
    df = spark.createDataFrame([(sorted(base + terms),)], "spans array<struct<start:int,kind:int,end:int>>")
    got = [tuple(s) for s in df.select(pii._clear(pii.F.col("spans"))).first()[0]]
    assert got == [s for s in sorted(base + terms) if s[1] < 4 or not any(b[0] < s[2] and s[0] < b[2] for b in base)]
    values = [5, 3, 8, 1] * 100
    df = spark.createDataFrame([(values, [])], "v array<int>, e array<int>")
    r = df.select(pii._scan(pii.F.col("v"), lambda a, b: a + b).alias("s"), pii._scan(pii.F.col("v"), pii.F.greatest).alias("m"), pii._scan(pii.F.col("e"), pii.F.greatest).alias("e")).first()
    assert r.s == list(accumulate(values)) and r.m == list(accumulate(values, max)) and r.e == []
