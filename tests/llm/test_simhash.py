import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from haulmark.llm.components import components
from haulmark.llm.simhash import anchors, fingerprints, layout, links_in, near_duplicates, nearest_in, patterns, remixed, sketch

SCHEMA = "doc_id long, text string, fp string, key string"


def brute_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, distance):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    low = {}
    for i, x in enumerate(label):
        low[x] = min(low.get(x, 1 << 63), 1 << 63 if ids[i] is None else ids[i])
    return [None if low[x] == 1 << 63 else low[x] for x in label]


@pytest.mark.parametrize("distance", [4, 11, 12])
def test_anchors_meet(distance):
    rng = np.random.default_rng(distance)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for p in rng.choice(64, rng.integers(0, distance + 1), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(p)
    (ra, ka), (rb, kb) = anchors(a, distance), anchors(b, distance)
    for i in range(len(a)):
        assert set(ka[ra == i]) & set(kb[rb == i])


def test_hamming_code_covers_within_one():
    for _, bits, radius in layout(12):
        table, count = patterns(bits, radius)
        assert all(count >= 1) and sum(bin(int(table[s, 0])).count("1") <= 1 for s in range(bits + 1)) == bits + 1


def test_dense_links_span():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.array([b ^ (np.uint64(1) << np.uint64(p)) for b in base for p in rng.integers(0, 64, 300)], np.uint64)
    a, b = links_in(fp, 4)
    assert len(a) < 40 * len(fp)
    label = np.arange(len(fp))
    for _ in range(20):
        for x, y in zip(a, b, strict=True):
            label[x] = label[y] = min(label[x], label[y])
    assert len(set(label)) == 3


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(5)
    names = list(range(300))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(names[200], names[i]) for i in range(201, 300)]
    edges += [(names[150], names[150]), (names[0], names[1])]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[x] for x in names[:121]} == {min(names[:121])} and {got[x] for x in names[200:]} == {min(names[200:])}
    assert len(got) == 221
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_at_the_driver_equal_those_by_shuffles(spark, monkeypatch):
    from haulmark.llm import components as module

    rng = random.Random(6)
    edges = spark.createDataFrame([((rng.randrange(200), rng.randrange(3)), (rng.randrange(200), rng.randrange(3))) for _ in range(260)], "a struct<x:long,y:long>, b struct<x:long,y:long>")
    monkeypatch.setattr(module, "_large", None)  # no round is needed
    few = sorted(map(tuple, module.components(edges).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(module, "FEW", 0)
    assert few == sorted(map(tuple, module.components(edges).collect())) and few


def rows():
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(300)]
    out, n = [], 0
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append((n, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in words), "f", None))
            n += 1
    rng.shuffle(out)
    return [*out, (None, None, None, None), (900, "", "x", "y"), (901, "  \n ", "x", "y"), (902, "É a b", "x", "y"), (None, "Ünique text of a row without an id", "", ""), (3, *out[0][1:]), out[1], out[1]]


def test_near_duplicates_equal_brute_force(spark):
    data = rows()
    got = near_duplicates(spark.createDataFrame(data, SCHEMA)).select("doc_id", F.hex("fp"), "component_id").collect()
    fps = [brute_fingerprint(t, 4) for _, t, *_ in data]
    want = zip([d for d, *_ in data], (f"{f:X}" for f in fps), brute_components([d for d, *_ in data], fps, 4), strict=True)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_duplicates_with_jaccard(spark):
    data = rows()
    got = {}
    for r in near_duplicates(spark.createDataFrame(data, SCHEMA), words=5, distance=11, jaccard=0.8, views=3).collect():
        got.setdefault(r.component_id, set()).add(r.doc_id)
    sets = {}
    for d, t, *_ in data:
        w = (t or "").lower().split()
        sets.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for group in got.values():  # each member is like some other one
        for d in group if len(group) > 1 else ():
            assert any(len(x & y) >= 0.8 * len(x | y) for x in sets[d] for e in group - {d} for y in sets[e]) or d is None


def test_star_of_near_copies_whose_centre_has_the_largest_id(spark):
    rng = random.Random(12)
    base = [f"word{rng.randrange(5_000)}" for _ in range(204)]
    data = []
    for i in range(1_000):  # each like the centre, hardly any two like each other
        words = list(base)
        for p in rng.sample(range(5, 199, 6), 3):
            words[p] = f"new{i}x{p}"
        data.append((i, " ".join(words), "", ""))
    data += [(5_000, " ".join(base), "", ""), (6_000, "a text of its own", "", "")]
    got = near_duplicates(spark.createDataFrame(data, SCHEMA), words=5, distance=11, jaccard=0.8, views=3).collect()
    assert {r.component_id for r in got} == {0, 6_000} and len(got) == 1_002


def test_nearest_links_leave_nothing_unsaid():
    rng = np.random.default_rng(8)
    sets = [np.unique(np.concatenate([np.arange(100, dtype=np.uint64), rng.integers(1_000, 9_000, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(80)]
    hashes = [remixed(x + np.uint64(1), 3) for x in sets]
    more = np.array([[i % 70, *sketch(h)] for i, h in enumerate(hashes)], np.int64)
    fp = rng.integers(0, 2, 80).astype(np.uint64)
    share = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    want = {(i, j) for j in range(80) for i in range(j) if i % 70 != j % 70 and share(i, j) >= 0.8}
    a, b = nearest_in(fp, 1, 0.8, 2, more)
    links_, loops = set(zip(a[a < b].tolist(), b[a < b].tolist(), strict=True)), set(a[a == b].tolist())
    assert all(x in links_ or set(x) <= loops for x in want) and len(want - links_) > 10
    a, b = nearest_in(fp, 1, 0.8, 80, more)
    assert want <= set(zip(a.tolist(), b.tolist(), strict=True)) and (a < b).all() and len(a) < 80 * 79 / 2


def test_every_pair_just_over_the_similarity_is_linked(spark):
    rng = random.Random(17)
    data = []
    for i in range(400):  # 300 shingles of five words, of which 30 differ: a Jaccard similarity of 0.82
        base = [f"word{rng.randrange(100_000)}" for _ in range(304)]
        other = list(base)
        for p in rng.sample(range(5, 299, 6), 6):
            other[p] = f"new{p}"
        data += [(2 * i, " ".join(base), "", ""), (2 * i + 1, " ".join(other), "", "")]
    got = near_duplicates(spark.createDataFrame(data, SCHEMA), words=5, distance=11, jaccard=0.8, views=3).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got) and len(got) == 800


def test_texts_that_are_not_alike_hardly_meet(spark):
    rng = random.Random(18)
    line = " ".join(f"a{i}" for i in range(30))  # stands in each text
    data = [(i, " ".join([*(f"word{rng.randrange(50_000)}" for _ in range(90)), line, *(f"word{rng.randrange(50_000)}" for _ in range(90))]), "", "") for i in range(3_000)]
    keys = fingerprints(spark.createDataFrame(data, SCHEMA), 5, 3, True).select(F.explode("keys").alias("key")).groupBy("key").count()
    rows, most, pairs = keys.agg(F.sum("count"), F.max("count"), F.sum(F.expr("count * (count - 1) / 2"))).first()
    assert rows <= 12 * 3_000 and most < 300 and pairs < 0.03 * 3_000**2 / 2


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(120_000))
    data = [(1, long, "", ""), (2, long.replace(" ", "\n"), "", ""), (3, "x" * 1_000_000, "", ""), (4, "short", "", "")]
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:x}", r.component_id) for r in near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[1] == got[2] and got[1][1] == 1 and got[1][0] == f"{brute_fingerprint(long, 4):x}"
    assert got[3] == (f"{brute_fingerprint('x' * 1_000_000, 4):x}", 3)
