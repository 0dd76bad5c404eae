import random

import pytest

from haulmark.llm.q_topk import SQL, op2_topk
from haulmark.llm.topk import integer_vectors, top_k
from tests.llm.oracle import connect, same

KIND = "vec_id long, embedding array<float>, v string, score string"


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    assert len(same(op2_topk(spark, d), connect(d, ["embeddings"]), SQL)) >= 10


def brute(rows, k):
    out = []
    for q, x in rows:
        if q % 100:
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_ties_repeats_and_odd_vectors(spark, monkeypatch):
    for name, size in (("CHUNK", 16), ("GROUP", 2), ("QUERY_BLOCK", 3), ("BLOCKS_A_TASK", 2)):
        monkeypatch.setattr(f"haulmark.llm.topk.{name}", size)
    rng = random.Random(4)
    data = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(700)]
    data += [(i, [0.5, 0.5, 0.5]) for i in range(700, 1_000)] + [(1_000, [0.25]), (1_001, []), (1_100, [9.0, -9.0, 3.3])]
    odd = [(2_000, None), (2_100, [1.0, None, 0.0]), (2_200, [1.0, float("nan"), 0.0]), (2_300, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rng.sample(data, len(data)) + odd], KIND)
    v = integer_vectors(df, 1024)
    got = sorted(map(tuple, top_k(v, v.where("vec_id % 100 = 0"), 10).collect()))
    scaled = [(i, [int(x * 1024 // 1) if x != 3.3 else 3379 for x in own]) for i, own in data]
    assert got == brute(scaled, 10)


def test_few_and_no_vectors(spark):
    v = integer_vectors(spark.createDataFrame([(0, [1.0], "", ""), (1, [2.0], "", ""), (2, [-1.0], "", "")], KIND), 2)
    assert sorted(map(tuple, top_k(v, v.where("vec_id = 0"), 10).collect())) == [(0, 1, 1, 8), (0, 2, 2, -4)]
    none = integer_vectors(spark.createDataFrame([], KIND), 2)
    assert top_k(none, none, 10).collect() == []
    assert top_k(v, v.where("vec_id > 99"), 10).collect() == []


def test_a_query_id_repeated_often(spark):
    data = [(0, [1.0, 0.0])] * 14 + [(i, [1.0, 0.0]) for i in range(1, 16)] + [(7, [1.0, 0.0])] * 2 + [(50, [0.0, 2.0])]
    v = integer_vectors(spark.createDataFrame([(*r, "", "") for r in data], KIND), 4)
    got = sorted(map(tuple, top_k(v, v.where("vec_id = 0").limit(1), 10).collect()))
    assert got == [(0, r + 1, i, 16) for r, i in enumerate([1, 2, 3, 4, 5, 6, 7, 7, 7, 8])]


def test_bounds_leave_far_groups_out(spark, monkeypatch):
    from haulmark.llm import topk

    for name, size in (("CHUNK", 8), ("GROUP", 1), ("QUERY_BLOCK", 4), ("PIVOTS", 16)):
        monkeypatch.setattr(f"haulmark.llm.topk.{name}", size)
    rng = random.Random(6)
    data = []
    for i in range(600):  # clusters far apart on a sphere: most groups can't hold a neighbour
        c = [0.0] * 12
        c[i % 12] = 10.0
        data.append((i, [x + rng.uniform(-0.1, 0.1) for x in c]))
    v = integer_vectors(spark.createDataFrame([(*r, "", "") for r in data], KIND), 1024).cache()
    seen, visit = [], topk._visit

    def counted(index, asked, pairs, *rest):
        seen.append(pairs.count())
        return visit(index, asked, pairs, *rest)

    monkeypatch.setattr(topk, "_visit", counted)
    got = sorted(map(tuple, top_k(v, v.where("vec_id % 100 = 0"), 3).collect()))
    rows = [(r.vec_id, list(r.v)) for r in v.collect()]
    assert got == brute(rows, 3)
    every = (6 / 4 + 1) * 600 / 8
    assert sum(seen) < every
