import math
import re
import zlib
from fractions import Fraction
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

from haulmark.llm import langid
from haulmark.llm.langid import Vocabulary, expected, fit, forward, predict, score_long, words_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(PATH)


def segmentations(word):
    for n in range(len(word)):
        for cuts in combinations(range(1, len(word)), n):
            at = [0, *cuts, len(word)]
            yield [word[i:j] for i, j in zip(at, at[1:], strict=False)]


def test_forward_sums_all_segmentations(vocab):
    rng = np.random.default_rng(1)
    p = rng.random((vocab.size, 2)) / vocab.size
    p[vocab.none] = 0
    for word in ("▁the", "▁ouvrir", "▁ꙮab", "▁a"):
        total, counts = np.zeros(2), np.zeros(vocab.size)
        for seg in segmentations(word):
            ids = [vocab.ids.get(s, vocab.unknown if len(s) == 1 else vocab.none) for s in seg]
            x = np.prod(p[ids], axis=0)
            total += x
            for i in ids:
                counts[i] += x[0]
        table = vocab.table([word, word])
        assert np.allclose(forward(table, p), np.log(total))
        got = np.zeros(vocab.size)
        expected(table[:1], p[:, 0], np.array([3.0]), got)
        counts[vocab.none] = got[vocab.none]
        assert np.allclose(got, 3 * counts / total[0])


def brute(text, vocab, p):
    """Log probabilities of a text by an exact sum over places, letter by letter, in rational numbers."""
    total = np.zeros(p.shape[1])
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        word = "▁" + word
        for lang in range(p.shape[1]):
            sums = [Fraction(1)]
            for j in range(1, len(word) + 1):
                pieces = [(i, vocab.ids.get(word[i:j], vocab.unknown if j - i == 1 else vocab.none)) for i in range(max(0, j - langid.PIECE_CHARS), j)]
                sums.append(sum((sums[i] * Fraction(p[x, lang]) for i, x in pieces if p[x, lang]), Fraction(0)))
            total[lang] += math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
    return total


def test_long_runs_do_not_underflow(vocab, monkeypatch):
    p = np.full((vocab.size, 3), 1e-9)
    p[vocab.none] = 0
    assert np.isfinite(forward(vocab.table(["▁" + "q" * 256]), p)).all()
    monkeypatch.setattr(langid, "STRETCH", 50)
    for word in ("▁" + "thequickbrown" * 30, "▁" + "x" * 777):  # whole words, in stretches
        assert words_of(word) == [word[1:]]
        assert np.allclose(score_long(word, p, vocab), forward(vocab.table([word]), p)[0])


def test_one_odd_word_does_not_spoil_the_fit(vocab):
    words = ["▁" + "ꙮꙀꚀ" * 15 + "q", *["▁the", "▁water", "▁house"]]
    p = langid.fit_words(words, np.array([1.0, 4e6, 3e6, 2e6]), vocab)
    assert np.isfinite(p).all() and abs(p.sum() - 1) < 1e-9


def test_predictions_equal_brute_force(spark, tmp_path, vocab):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").limit(60)
    odd = [(9001, None, "en", "s", 0), (9002, "12 !", "fr", "s", 4), (9003, "The the", None, "s", 7), (9003, "The the", None, "s", 7)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    from haulmark.llm.q_langid import op5_langid

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    langs, p = fit(docs.where("pmod(crc32(cast(doc_id as string)), 3) <> 1"), PATH)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op5_langid(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()))
        if not n:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        total = brute(texts[r.doc_id], vocab, p)
        assert langs.index(r.lang_pred) == total.argmax()
        assert abs(r.score - 1 / np.exp((total - total.max()) * min(n, langid.SCORE_WORDS) / n).sum()) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_clashing_names_and_copies(spark):
    kind = "Score string, doc_id long, text string, lang string, lang_pred string"
    docs = [("x", i, "the house and the water", "en", "no") for i in range(500)] + [("x", 900, "la maison et le bateau", "fr", "no")]
    df = spark.createDataFrame(docs, kind)
    langs, p = fit(df, PATH)  # a language with a single text beside one of copies only
    assert langs == ["en", "fr"]
    got = predict(df, PATH, langs, p)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {(r.lang, r.lang_pred) for r in got.collect()} == {("en", "en"), ("fr", "fr")}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from haulmark.llm.q_langid import op5_langid

    rows = op5_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 250
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_defined_cases(spark):
    kind = "doc_id long, text string, lang string, source string"
    docs = [(i, f"the house and the water number {i}", "en", None) for i in range(30)]
    docs += [(i, f"la maison et le bateau numéro {i}", "fr", None) for i in range(30, 60)]
    langs, p = fit(spark.createDataFrame(docs, kind), PATH)
    assert langs == ["en", "fr"] and np.allclose(p.sum(0), 1, atol=1e-6)
    cases = [(1, None, None, "s"), (2, "", None, "s"), (3, "123 !?", "en", "s"), (None, "le bateau", None, None), (5, "The Water", None, None), (5, "The Water", None, None), (6, "et la " * 100_000, None, "x")]
    got = [(r.doc_id, r.lang_pred) for r in predict(spark.createDataFrame(cases, kind), PATH, langs, p).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (None, "fr"), (5, "en"), (5, "en"), (6, "fr")]
    none, q = fit(spark.createDataFrame([], kind), PATH)
    assert none == [] and {r.lang_pred for r in predict(spark.createDataFrame(cases, kind), PATH, none, q).collect()} == {"und"}
