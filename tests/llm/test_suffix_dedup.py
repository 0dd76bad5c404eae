import random
from collections import Counter

import numpy as np
import pytest

from haulmark.llm import suffix_dedup
from haulmark.llm.bwt import repeated_starts
from haulmark.llm.suffix_dedup import remove_repeats, segments_of

SCHEMA = "doc_id long, text string, spans string, key string"


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
        out.append((len(r), bytes(b for b, g in zip(r, gone, strict=False) if not g), runs))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_transform_finds_repeats(seed):
    rng = random.Random(seed)
    alphabet = b"ab" if seed % 2 else bytes(range(0, 250, 7))
    strings = [bytes(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60, 90]))) for _ in range(30)]
    strings += [strings[3], b"x" + strings[4] + b"y", b"a" * 50, b"a" * 50]
    seen = Counter(s[i : i + 12] for s in strings for i in range(len(s) - 11))
    for s, hit in zip(strings, repeated_starts(strings, 12), strict=True):
        assert hit.tolist() == [seen[s[i : i + 12]] > 1 for i in range(len(s) - 11)]


def test_every_start_is_in_one_segment(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    rng = random.Random(2)
    raw = bytes(rng.choice(b"abcdefgh ") for _ in range(5_000)) + b"z" * 600
    at = 0
    for first, n, anchor, _ in segments_of(raw, 400):
        assert first == at and 0 <= anchor - n + 1 and anchor <= 400 - 32
        at += n
    assert at == len(raw) - 399
    assert list(segments_of(b"x" * 399, 400)) == []


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60), prose(120), prose(25)]
    texts = [None, "", "short", "q" * 1_000, prose(80)]
    for _ in range(60):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), prose(rng.randint(0, 40))]
        texts.append(rng.choice([" ", ""]).join(parts))
    near = prose(300)
    texts += [near[:i] + "X" + near[i + 1 :] for i in (5, 700, 701, 1_200)] + [near, near, texts[7]]
    return texts


@pytest.mark.parametrize("collection", [256, 3, 0])
def test_equals_brute_force(spark, monkeypatch, collection):
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    monkeypatch.setattr(suffix_dedup, "CUT", 24)
    texts = corpus()
    ids = [None if i == 9 else i for i in range(len(texts))]
    ids[-1] = ids[7]  # a repeated row
    docs = spark.createDataFrame([(i, t, "s", None) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in remove_repeats(docs).collect())
    want = sorted((-1 if i is None else i, *x) for i, x in zip(ids, brute(texts, 400), strict=True))
    assert got == want
    assert sum(w[1] - len(w[2]) for w in want) > 10_000


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_planted_repeats_of_400_bytes_and_more_go(spark, tmp_path):
    """Of passages of over 50 words those of 400 bytes and more are removed in every document; shorter ones can't be."""
    rng = random.Random(31)
    prose = lambda n: " ".join("".join(rng.choice("abdeghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [prose(n) for n in (51, 55, 60, 65, 70, 80, 120, 200)]
    rows, where = [], {}
    for i in range(120):
        own, passage = [prose(rng.randint(20, 200)), prose(rng.randint(20, 200))], rng.randrange(12)
        if passage < len(passages):
            own.insert(1, passages[passage])
            where[i] = passage
        rows.append((i, " ".join(own), "", ""))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    from haulmark.llm.q_suffix_dedup import op10_suffix_dedup

    got = {r.doc_id: r for r in op10_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, r in got.items():
        long = i in where and len(passages[where[i]]) >= 400
        assert r.removed == (r.n_removed > 0) == long
        assert not long or len(passages[where[i]]) <= r.n_removed <= len(passages[where[i]]) + 8
    assert {len(p) >= 400 for p in passages} == {True, False}
