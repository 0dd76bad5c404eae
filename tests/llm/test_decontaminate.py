import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haulmark.llm import decontaminate as dc
from haulmark.llm.decontaminate import Items, leaks

DOCS, BENCH = "doc_id long, text string, item_id long, lcs string", "item_id long, text string, doc_id long"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=30), st.lists(st.sampled_from("abcde"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_bit_parallel_lcs(item, other):
    items = Items([(1, " ".join(item))])
    assert items.lcs(0, [items.number.get(w, -1) for w in other]) == lcs(item, other)


def brute(docs, bench):
    """Every pair, every window, without the latent search."""
    items = Items(bench)
    out = set()
    for d, text in docs:
        words = [items.number.get(w, -1) for w in dc.words_of(text)]
        for i, own in enumerate(items.words):
            around = max(dc.PASSAGE // 2, len(own))
            for at in range(0, len(words), dc.PASSAGE // 2):
                near = [w for w in words[max(0, at - around) : at + dc.PASSAGE + around] if w >= 0]
                if own and ((s := items.lcs(i, near) / len(own)) >= dc.LCS or (s >= dc.LCS_ANSWER and items.has_answer(i, near))):
                    out.add((d, items.ids[i]))
                    break
    return out


def test_recall_and_precision_on_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.orderBy("item_id").collect()])
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert got <= want and len(want) > 10
    assert len(got) >= 0.95 * len(want)


def test_paraphrases_and_odd_rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    bench = [(i, ". ".join(" ".join(word() for _ in range(12)) for _ in range(3))) for i in range(20)] + [(50, None), (51, "..."), (None, None)]
    plain = lambda n: " ".join(word() for _ in range(n))

    def paraphrase(text):
        words = text.split()
        return " ".join(word() if rng.random() < 0.15 else w for w in words)

    docs = [(i, plain(200) + " " + bench[i][1].upper() + "\n" + plain(100)) for i in range(5)]
    docs += [(10 + i, plain(61) + " " + paraphrase(bench[i][1]) + " " + plain(9)) for i in range(5, 10)]
    docs += [(30 + i, plain(300)) for i in range(40)] + [(100, None), (101, ""), (102, "!"), (None, bench[11][1]), (0, docs[0][1])]
    rows = leaks(spark.createDataFrame([(*x, None, "x") for x in docs], DOCS), spark.createDataFrame([(*x, None) for x in bench], BENCH)).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert {(i, i) for i in range(5)} <= found and (None, 11) in found and len(rows) == len(found)
    assert len({(10 + i, i) for i in range(5, 10)} & found) >= 4
    assert not {d for d, _ in found} & {*range(30, 103)} - {None}
    assert all(0 < r.lcs <= 1 and r.first_word < r.last_word for r in rows)


def test_singular_vectors_match_a_dense_svd(spark, monkeypatch):
    monkeypatch.setattr(dc, "RANK", 12)
    rng = random.Random(3)
    topics = [[f"t{t}w{i}" for i in range(8)] for t in range(6)]
    docs = [(i, " ".join(rng.choice(topics[i % 6] if rng.random() < 0.9 else topics[rng.randrange(6)]) for _ in range(dc.PASSAGE))) for i in range(240)]
    items = Items([(1, " ".join(w for t in topics for w in t))])
    monkeypatch.setattr(dc, "MOST", 1.0)
    coded = dc.encode(spark.createDataFrame([(*x, None, "") for x in docs], DOCS), items).cache()
    idf = dc.weights(*dc.frequencies(coded, len(items.number)))
    a = np.zeros((len(docs), len(idf)))
    for i, text in docs:
        for w in text.split():
            a[i, items.number[w]] += idf[items.number[w]]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    v = dc.right_vectors(coded, idf)[:, :6]
    want = np.linalg.svd(a, full_matrices=False)[2][:6].T
    assert np.linalg.norm(want.T @ v, 2) > 0.99 and np.linalg.svd(want.T @ v)[1].min() > 0.97


def test_an_item_in_a_third_of_all_documents(spark):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(900)]
    bench = [(i, ". ".join(" ".join(rng.sample(vocab, 12)) for _ in range(2))) for i in range(30)]
    plain = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i, plain(150)) for i in range(400)]
    docs += [(1_000 + i, bench[0][1]) for i in range(100)]  # copies
    docs += [(2_000 + i, f"{plain(rng.randrange(60))} {bench[0][1]} {plain(rng.randrange(60))}") for i in range(100)]  # quoted
    docs += [(3_000 + i, f"{plain(40)} {bench[i][1]} {plain(40)}") for i in range(1, 30)]
    rows = leaks(spark.createDataFrame([(*x, None, "x") for x in docs], DOCS), spark.createDataFrame([(*x, None) for x in bench], BENCH)).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert {d for d, i in found if i == 0} == {*range(1_000, 1_100), *range(2_000, 2_100)}
    assert {(3_000 + i, i) for i in range(1, 30)} <= found


@pytest.mark.parametrize("which", [0, 1, 2])
def test_empty_tables(spark, which):
    docs = spark.createDataFrame([(1, "some words", None, "")] if which == 1 else [], DOCS)
    bench = spark.createDataFrame([(1, "some words", None)] if which == 0 else [], BENCH)
    assert leaks(docs, bench).collect() == []


def test_shares_of_many_pairs():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 5, 40, 63, 64, 90)]
    items = dc.Items(list(enumerate(texts)))
    words = rng.integers(0, len(items.number), 4_000).astype(np.int32)
    item, lo = rng.integers(0, len(texts), 300), rng.integers(0, 3_800, 300)
    hi = lo + rng.integers(0, 200, 300)
    got = items.shares(item, words, lo, hi)
    want = [items.lcs(j, words[a:b].tolist()) / len(items.words[j]) for j, a, b in zip(item.tolist(), lo.tolist(), hi.tolist(), strict=True)]
    assert np.allclose(got, want)
    assert items.shares(item[:0], words[:0], lo[:0], hi[:0]).tolist() == []
    assert items.shares(item[:2], words[:0], lo[:2] * 0, hi[:2] * 0).tolist() == [0, 0]


def test_a_leak_in_a_very_long_text(spark):
    rng = random.Random(7)
    vocabulary = [f"term{i}" for i in range(3_000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(40), 0) for i in range(5)]
    long = f"{prose(60_000)} {items[3][1]} {prose(60_000)}"
    docs = [(1, long, 0, ""), (2, "y" * 500_000, 0, ""), *((10 + i, prose(100), 0, "") for i in range(30))]
    found = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH)).collect()
    assert [(r.doc_id, r.item_id, r.lcs) for r in found] == [(1, 3, 1.0)]
