"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word (a lower-cased run of letters
after a word mark) scores the sum, over all its segmentations into pieces, of the product of their probabilities,
found by a forward algorithm; a text scores the product over its words. Probabilities are fitted by expectation
maximisation over the same segmentations.

Only fitting uses a sample: of each of the LANGUAGES languages with the most labelled documents the different texts of at
most SAMPLE_CHARS characters whose hash falls below SAMPLE_DOCS / (its different texts), so about SAMPLE_DOCS of them, and
always the one with the least hash; of them the words of at most FIT_LETTERS letters. Prediction covers whole texts and
whole words, however long.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled document every text
is; ties go to the language first in order; a null doc_id is not held out and not learned from; repeated rows get the
same prediction each; columns of the documents that are called lang_pred or score give way to the predicted ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm._common import frugal, kept, small_batches, staged

LANGUAGES, SAMPLE_DOCS, SAMPLE_CHARS, FIT_LETTERS = 256, 400, 65_536, 48
ROUNDS, SMOOTH, PIECE_CHARS, MEMO_WORDS = 3, 0.05, 16, 100_000
#: Longer words are scored a stretch of so many letters at a time, each going on where the last one ended.
STRETCH = 2_048
#: The score is the posterior as if the text had at most so many words.
SCORE_WORDS = 8
LETTERS = re.compile(r"[^\W\d_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Piece numbers of a sentencepiece vocabulary; the last two stand for no piece and for an unknown letter."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        real = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {p: i for i in real if len(p := sp.id_to_piece(i)) <= PIECE_CHARS}
        self.size, self.none, self.unknown = n + 2, n, n + 1
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted(set(map(len, self.ids))):
            own = [p for p in self.ids if len(p) == k]
            codes = _codes("".join(own)).reshape(-1, k)
            hashes = np.zeros(len(own), np.uint64)
            for i in range(k):
                hashes = hashes * MULTIPLIER + codes[:, i]
            order = np.argsort(hashes, kind="stable")
            self.of_length[k] = hashes[order], np.array([self.ids[p] for p in own])[order], codes[order]

    def table(self, words: list[str]) -> np.ndarray:
        """For words of one length: [word, last letter, length - 1] -> piece. Candidates come by a hash of each stretch of
        letters, and letters are compared."""
        n = len(words[0])
        codes = _codes("".join(words)).reshape(-1, n)
        out = np.full((len(words), n, min(n, PIECE_CHARS)), self.none, np.int32)
        hashes = np.zeros_like(codes)
        for k in range(1, out.shape[2] + 1):
            hashes = hashes[:, : n - k + 1] * MULTIPLIER + codes[:, k - 1 :]
            if k in self.of_length:
                known, ids, letters = self.of_length[k]
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                word, start = np.nonzero(known[at] == hashes)
                piece = at[word, start]
                same = (np.lib.stride_tricks.sliding_window_view(codes, k, axis=1)[word, start] == letters[piece]).all(1)
                out[word[same], start[same] + k - 1, k - 1] = ids[piece[same]]
        first = out[:, :, 0]
        first[first == self.none] = self.unknown
        return out

    def ends(self, word: str, first: int, last: int) -> np.ndarray:
        """[letter, length - 1] -> the piece that ends with that letter, for letters from first to before last."""
        near = max(0, first - PIECE_CHARS + 1)
        own = self.table([word[near:last]])[0, first - near :]
        out = np.full((last - first, min(len(word), PIECE_CHARS)), self.none, np.int32)
        out[:, : own.shape[1]] = own
        return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def vocabulary(path: str) -> Vocabulary:
    return kept(Vocabulary, path)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Numbers of words of the same length, in batches of bounded size."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        n, end = len(words[order[at]]), at + 1
        while end < len(order) and len(words[order[end]]) == n and (end - at) * n < 20_000:
            end += 1
        yield order[at:end]
        at = end


def forward(pieces: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations: pieces [word, last letter, length], p [piece, language]."""
    past, scale = [np.ones((len(pieces), p.shape[1]))], np.zeros((len(pieces), p.shape[1]))
    past, scale = _forward_on(pieces, p, past, scale)
    return np.log(past[-1]) + scale


def _forward_on(pieces: np.ndarray, p: np.ndarray, past: list[np.ndarray], scale: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sums after more letters: past holds those of the last places, divided by exp(scale)."""
    words, n, longest = pieces.shape
    for j in range(n):
        now = np.zeros_like(scale)
        for k in range(1, min(len(past), longest) + 1):
            now += past[-k] * p[pieces[:, j, k - 1]]
        past = [*past[-longest + 1 :], now] if longest > 1 else [now]
        if j % 4 == 3 or j == n - 1:
            most = np.maximum.reduce(past)
            past = [x / most for x in past]
            scale = scale + np.log(most)
    return past, scale


def score_long(word: str, p: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """forward() of one word of any length, in memory that does not grow with it."""
    past, scale = [np.ones((1, p.shape[1]))], np.zeros((1, p.shape[1]))
    for at in range(0, len(word), STRETCH):
        past, scale = _forward_on(vocab.ends(word, at, min(len(word), at + STRETCH))[None], p, past, scale)
    return (np.log(past[-1]) + scale)[0]


def expected(pieces: np.ndarray, p: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected count of each piece in the words, by forward and backward sums. Every letter of a word is given its
    own even share of the word's probability as a unit, which all segmentations hold equally: so no sum vanishes."""
    words, n, longest = pieces.shape
    unit = np.exp(-forward(pieces, p[:, None])[:, 0] / n)
    a, b = np.zeros((words, n + 1)), np.zeros((words, n + 1))
    a[:, 0] = b[:, n] = 1
    q = p[pieces] * unit[:, None, None] ** np.arange(1, longest + 1)
    for j in range(1, n + 1):
        for k in range(1, min(j, longest) + 1):
            a[:, j] += a[:, j - k] * q[:, j - 1, k - 1]
    for i in range(n - 1, -1, -1):
        for k in range(1, min(n - i, longest) + 1):
            b[:, i] += b[:, i + k] * q[:, i + k - 1, k - 1]
    share = weight / a[:, n]
    for k in range(1, longest + 1):
        gain = a[:, : n - k + 1] * q[:, k - 1 :, k - 1] * b[:, k:] * share[:, None]
        np.add.at(total, pieces[:, k - 1 :, k - 1].ravel(), gain.ravel())


def fit_words(words: list[str], counts: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Piece probabilities of one language."""
    p = np.full(vocab.size, 1.0 / vocab.size)
    p[vocab.none] = 0
    batches = [(vocab.table([words[i] for i in rows]), counts[rows]) for rows in by_length(words)]
    for _ in range(ROUNDS):
        total = np.full(vocab.size, SMOOTH)
        for pieces, weight in batches:
            expected(pieces, p, weight, total)
        total[vocab.none] = 0
        p = total / total.sum()
    return p


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities [piece, language], from docs(text, lang)."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.length("text").between(1, SAMPLE_CHARS)).select("lang", "text", F.xxhash64("text").alias("hash"))
    texts = known.groupBy("lang", "hash").agg(F.count("*").alias("n"))
    share = texts.groupBy("lang").agg(F.sum("n").alias("n"), (F.lit(SAMPLE_DOCS * float(1 << 20)) / F.count("*")).alias("share"), F.min("hash").alias("least"))
    share = staged(share.orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang", "share", "least"), "shares")
    chosen = (F.pmod("hash", F.lit(1 << 20)) < F.col("share")) | (F.col("hash") == F.col("least"))
    sample = known.join(F.broadcast(share), "lang").where(chosen).dropDuplicates(["lang", "hash"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text) if len(w) <= FIT_LETTERS)
            langs, words = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    def learn(key, group):
        import pandas as pd

        vocab = vocabulary(path)
        group = group.sort_values("word")
        p = fit_words(["▁" + w for w in group["word"]], group["n"].to_numpy(float), vocab)
        base = p[p > 0].min()
        piece = np.nonzero(p > base)[0]
        return pd.DataFrame({"lang": key[0], "piece": np.append(piece, -1), "p": np.append(p[piece], base)})

    counted = sample.mapInArrow(frugal(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").applyInPandas(learn, "lang string, piece int, p double").toPandas()
    vocab = vocabulary(path)
    langs = sorted(rows["lang"].unique())
    p = np.zeros((vocab.size, len(langs)))
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        p[:, i] = own.loc[own["piece"] == -1, "p"].iloc[0]
        own = own[own["piece"] >= 0]
        p[own["piece"], i] = own["p"]
    p[vocab.none] = 0
    return langs, p


class Scorer:
    """Log probabilities of words under each language, with a bounded memo."""

    def __init__(self, p: np.ndarray, vocab: Vocabulary):
        self.p, self.vocab, self.memo, self.old = p, vocab, {}, {}
        self.rows = self.old_rows = np.zeros((1024, p.shape[1]))

    def know(self, words: set[str]) -> None:
        """A memo that is full becomes the old one, from which words that come again are taken over."""
        if len(self.memo) > MEMO_WORDS:
            self.old, self.old_rows = self.memo, self.rows
            self.memo, self.rows = {}, np.zeros((1024, self.p.shape[1]))
        new = [w for w in words if w not in self.memo]
        while len(self.memo) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        base = len(self.memo)
        again = [i for i, w in enumerate(new) if w in self.old]
        self.rows[base + np.array(again, int)] = self.old_rows[[self.old[new[i]] for i in again]]
        fresh = [i for i, w in enumerate(new) if w not in self.old]
        marked = ["▁" + new[i] for i in fresh]
        short = [n for n, w in enumerate(marked) if len(w) <= STRETCH]
        for rows in by_length([marked[n] for n in short]):
            own = [short[i] for i in rows]
            self.rows[[base + fresh[n] for n in own]] = forward(self.vocab.table([marked[n] for n in own]), self.p)
        for n, w in enumerate(marked):
            if len(w) > STRETCH:
                self.rows[base + fresh[n]] = score_long(w, self.p, self.vocab)
        self.memo.update((w, base + i) for i, w in enumerate(new))

    def score(self, words: list[str]) -> tuple[int, float]:
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        total = self.rows[at].sum(0)
        best = int(total.argmax())
        tempered = (total - total[best]) * (min(len(words), SCORE_WORDS) / len(words))
        return best, float(1 / np.exp(tempered).sum())


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time: words of many texts at once take much more room than the texts."""
    for at in range(0, batch.num_rows, 512):
        yield batch.slice(at, 512)


def predict(docs: DataFrame, path: str, langs: list[str], p: np.ndarray) -> DataFrame:
    """docs with lang_pred and score after their own columns."""
    small_batches(docs.sparkSession)
    own = docs.select([c for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    at = own.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(p, vocabulary(path)) if langs else None
        for batch in (part for b in batches for part in parts(b)):
            texts = [words_of(t.as_py() or "") if scorer else [] for t in batch.column(at)]
            if scorer:
                scorer.know({w for t in texts for w in t})
            found = [scorer.score(t) if t else (None, 0.0) for t in texts]
            names = pa.array(["und" if b is None else langs[b] for b, _ in found], pa.string())
            out = [*batch.columns, names, pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, "lang_pred", "score"])

    schema = own.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return own.mapInArrow(frugal(judge), schema)


def recognised(docs: DataFrame, path: str, langs: list[str], p: np.ndarray, least: float) -> DataFrame:
    """docs whose language is recognised with at least that score, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(p, vocabulary(path)) if langs else None
        for batch in (part for b in batches for part in parts(b)):
            texts = [words_of(t.as_py() or "") if scorer else [] for t in batch.column(at)]
            if scorer:
                scorer.know({w for t in texts for w in t})
            yield batch.filter(pa.array([bool(t) and scorer.score(t)[1] >= least for t in texts], pa.bool_()))

    return docs.mapInArrow(frugal(keep), docs.schema)
