"""Benchmark decontamination by latent semantic retrieval.

1. Texts are reduced to the places of words that the benchmark has (no other word can match it), written once.
2. Document frequencies of these words over all passages of PASSAGE words give TF-IDF weights; words in more than
   MOST of the passages (and COMMON passages) weigh nothing, but the rarer half of each item's words always weighs
   something: an item that itself stands in so many passages is still found.
3. A randomised SVD of the passage-by-word matrix A, whose rows stay where they are: with a random orthonormal Q of RANK
   columns, each task adds up its part of A'(A Q) = G in one pass; with the Cholesky factor L of Q'G, the singular
   vectors of G L^-T are A's right singular vectors (the single-pass, Nystroem form). The sum is a words-by-RANK matrix,
   which depends on the benchmark and not on the corpus.
4. Every window of PASSAGE words, at every half passage, and every item are projected; pairs with a cosine of at least
   COSINE are candidates, unless too few of the item's weighed words lie around the window for a leak (an exact bound).
5. A candidate is a leak if the longest common subsequence of the item's words and the window's surroundings holds the
   share LCS of the item, or the share LCS_ANSWER and also the item's answer (its last sentence) in order.

The benchmark is taken in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters, each with its own vocabulary
and model, so what is sent to tasks is bounded.

Defined cases: null and wordless texts or items never match; an item without a second sentence is its own answer;
repeated rows and items of one id give one row; a null doc_id or item_id is reported as null; empty tables give no
rows. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm._common import frugal, small_batches, staged, text_or_empty

PASSAGE, RANK, COSINE, LCS, LCS_ANSWER, MOST, SEED = 64, 160, 0.35, 0.7, 0.55, 0.02, 29
#: Fewer passages than this are too few to call a word common.
COMMON = 50
BLOCK_ITEMS, BLOCK_CHARS, TERMS_A_ROW, FAN_IN = 2_000, 1_000_000, 16, 32
#: Passages in one dense matrix; words of an item that fit the bits of a number.
ROWS, BITS = 48, 63
#: Up to so many leaking ids are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 100_000
WORD = re.compile(r"\w+")
LEAK = "doc_id long, item_id long, first_word long, last_word long, cosine double, lcs double, answer boolean"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def answer_of(text: str | None) -> list[str]:
    sentences = [w for s in re.split(r"[.!?\n]+", text or "") if (w := words_of(s))]
    return sentences[-1] if sentences else []


class Items:
    """A block of the benchmark in numbers."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in rows]
        own = [words_of(t) for _, t in rows]
        self.number = {w: n for n, w in enumerate(sorted({w for x in own for w in x}))}
        self.words = [[self.number[w] for w in x] for x in own]
        self.answers = [[self.number[w] for w in answer_of(t)] for _, t in rows]
        self.masks: list[dict[int, int] | None] = [None] * len(rows)

    def lcs(self, item: int, other: list[int]) -> int:
        """Bit-parallel: a bit a word of the item."""
        if self.masks[item] is None:
            own: dict[int, int] = {}
            for i, w in enumerate(self.words[item]):
                own[w] = own.get(w, 0) | 1 << i
            self.masks[item] = own
        masks, n = self.masks[item], len(self.words[item])
        full = state = (1 << n) - 1
        for w in other:
            if hit := masks.get(w):
                x = state & hit
                state = (state + x | state - x) & full
        return n - state.bit_count()

    def shares(self, item: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of pairs (item, words[lo:hi]): the share of the item in their longest common subsequence. All pairs of an item take
        each step together, where its words fit a number's bits."""
        out = np.zeros(len(item))
        order = np.argsort(item, kind="stable")
        for rows in np.split(order, np.nonzero(np.diff(item[order]))[0] + 1) if len(item) else ():
            j, n = int(item[rows[0]]), len(self.words[item[rows[0]]])
            if n > BITS:
                out[rows] = [self.lcs(j, words[lo[r] : hi[r]].tolist()) / n for r in rows]
                continue
            own = np.array(self.words[j])
            bits = np.zeros(len(self.number) + 1, np.uint64)
            np.bitwise_or.at(bits, own, np.uint64(1) << np.arange(n, dtype=np.uint64))
            for part in np.split(rows, range(1_024, len(rows), 1_024)):
                size = hi[part] - lo[part]
                step = np.arange(size.max(initial=0))
                at = np.minimum(lo[part][None, :] + step[:, None], max(0, len(words) - 1))
                hits = np.where(step[:, None] < size[None, :], bits[words[at]] if len(words) else np.uint64(0), np.uint64(0))
                full = np.uint64((1 << n) - 1)
                state = np.full(len(part), full)
                for hit in hits[hits.any(1)]:
                    x = state & hit
                    state = ((state + x) | (state - x)) & full
                out[part] = (n - np.bitwise_count(state).astype(np.int64)) / n
        return out

    def has_answer(self, item: int, other: list[int]) -> bool:
        rest = iter(other)
        return bool(self.answers[item]) and all(w in rest for w in self.answers[item])


def encode(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n_words, places, words): where known words stand, as 32-bit integers."""
    small_batches(docs.sparkSession)
    number = items.number

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places, words = [], [], []
            for text in batch.column(1):
                found = words_of(text.as_py())
                own = np.fromiter(map(number.get, found, repeat(-1)), np.int32, len(found))
                at = np.nonzero(own >= 0)[0]
                sizes.append(len(found))
                places.append(at.astype(np.int32).tobytes())
                words.append(own[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, pa.binary()), pa.array(words, pa.binary())], ["doc_id", "n_words", "places", "words"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(frugal(reduce), "doc_id long, n_words long, places binary, words binary")


def _entries(batch: pa.RecordBatch, span: int, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's documents cut into stretches of span words: (stretch, word, count) of each that occurs (and weighs
    something), by stretch, and the first stretch of each document."""
    sizes = batch.column("n_words").to_numpy()
    base = np.concatenate([[0], np.cumsum(-(-sizes // span))])
    places, words = ([np.frombuffer(x.as_py(), np.int32) for x in batch.column(n)] for n in ("places", "words"))
    stretch = np.concatenate([p // span + b for p, b in zip(places, base[:-1], strict=True)] or [np.zeros(0, np.int64)])
    word = np.concatenate([*words, np.zeros(0, np.int32)]).astype(np.int64)
    if idf is not None:
        keep = idf[word] > 0
        stretch, word = stretch[keep], word[keep]
    pair, count = np.unique(stretch * (1 << 32) + word, return_counts=True)
    return pair >> 32, pair & ((1 << 32) - 1), count, base


def frequencies(coded: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """Of each word the passages that hold it, and the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(_entries(batch, PASSAGE)[1], minlength=terms)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["word", "n"])

    rows = coded.mapInArrow(frugal(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(terms, np.int64)
    df[rows["word"].to_numpy(int)] = rows["n"].to_numpy(int)
    passages = coded.agg(F.sum(F.ceil(F.col("n_words") / PASSAGE))).first()[0] or 0
    return df, int(passages)


def weights(df: np.ndarray, passages: int, items: Items | None = None) -> np.ndarray:
    """Of common words nothing, but of those among the rarer half of an item's words what the commonest other words weigh."""
    w = np.log((1 + passages) / (1 + df))
    most = max(COMMON, MOST * passages)
    common = df > most
    w[common] = 0
    for words in items.words if items else ():
        own = np.unique(words).astype(np.int64)
        rarer = own[np.argsort(df[own], kind="stable")][: -(-len(own) // 2)]
        w[rarer[common[rarer]]] = np.log((1 + passages) / (1 + most))
    return w.astype(np.float32)


def _dense(stretch: np.ndarray, word: np.ndarray, value: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Sorted entries of n stretches as small dense matrices: (which stretches, which words, matrix)."""
    for lo in range(0, n, ROWS):
        a, b = np.searchsorted(stretch, [lo, lo + ROWS])
        if a < b:
            words, column = np.unique(word[a:b], return_inverse=True)
            part = np.zeros((min(ROWS, n - lo), len(words)), np.float32)
            part[stretch[a:b] - lo, column] = value[a:b]
            yield slice(lo, lo + len(part)), words, part


def _weighed(batch: pa.RecordBatch, span: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    stretch, word, count, base = _entries(batch, span, idf)
    return stretch, word, (count * idf[word]).astype(np.float32), base


def gram_times(coded: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A q), with the rows of A of unit length."""
    terms, rank = q.shape
    q32 = q.astype(np.float32)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((terms, rank))
        for batch in batches:
            stretch, word, value, base = _weighed(batch, PASSAGE, idf)
            norm = np.sqrt(np.bincount(stretch, value**2, minlength=base[-1]))
            value = value / norm[stretch].astype(np.float32)
            for _, words, own in _dense(stretch, word, value, base[-1]):
                total[words] += own.T @ (own @ q32[words])
        salt = TaskContext.get().partitionId() % FAN_IN
        at = range(0, terms, TERMS_A_ROW)
        cols = [pa.array(list(at), pa.int64()), pa.array([salt] * len(at), pa.int64()), pa.array([total[a : a + TERMS_A_ROW].tobytes() for a in at], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["at", "salt", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (at, salt): one row for each."""
        now, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "salt", "part"])
        for batch in batches:
            for at, salt, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (at, salt) != now:
                    if now is not None:
                        yield row()
                    now, total = (at, salt), np.zeros(len(raw) // 8)
                total = total + np.frombuffer(raw)
        if now is not None:
            yield row()

    kind = "at long, salt long, part binary"
    sums = coded.mapInArrow(frugal(part), kind).repartition("at", "salt").sortWithinPartitions("at", "salt").mapInArrow(frugal(add), kind)
    sums = sums.withColumn("salt", F.lit(0).cast("long")).repartition("at").sortWithinPartitions("at", "salt").mapInArrow(frugal(add), kind)
    out = np.zeros((terms, rank))
    for r in sums.collect():
        out[r.at : r.at + TERMS_A_ROW] = np.frombuffer(r.part).reshape(-1, rank)
    return out


def right_vectors(coded: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors [word, RANK or fewer]."""
    rank = min(RANK, len(idf))
    omega = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(idf), rank)))[0]
    g = gram_times(coded, idf, omega)
    shift = 1e-7 * max(np.linalg.norm(g), 1e-9)  # keeps the small matrix positive definite
    g += shift * omega
    small = omega.T @ g
    half = np.linalg.solve(np.linalg.cholesky((small + small.T) / 2), g.T).T
    u, value, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, value**2 - shift > 1e-9 * max(value[0] ** 2, 1e-9)].astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


def search(coded: DataFrame, items: Items, idf: np.ndarray, v: np.ndarray) -> DataFrame:
    half = PASSAGE // 2
    latent = np.zeros((len(items.ids), v.shape[1]), np.float32)
    for i, words in enumerate(items.words):
        if words:
            latent[i] = (v[words] * idf[words, None]).sum(0)
    known = _unit(latent)
    # a common subsequence of that share needs so many of an item's weighed words near the window
    terms = len(idf)
    weighed = np.unique(np.concatenate([np.zeros(0, np.int64), *(i * terms + own[idf[own] > 0] for i, w in enumerate(items.words) if len(own := np.unique(w).astype(np.int64)))]))
    weighed = np.append(weighed, np.iinfo(np.int64).max)
    least = np.array([np.ceil(LCS_ANSWER * len(w) - 1e-9) - sum(idf[x] <= 0 for x in w) for w in items.words])
    repeats = np.array([max(np.bincount(w)) if w else 1 for w in items.words])
    least = np.ceil(least / repeats)
    sizes = np.array([len(w) for w in items.words])
    longest = max(sizes, default=0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LEAK.split(", ")]
        kinds = [*[pa.int64()] * 4, *[pa.float64()] * 2, pa.bool_()]
        for batch in batches:
            stretch, word, value, base = _weighed(batch, half, idf)
            z = np.zeros((base[-1], v.shape[1]), np.float32)
            for at, words, own in _dense(stretch, word, value, base[-1]):
                z[at] = own @ v[words]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(base))
            both = z.copy()
            same = np.nonzero(doc[:-1] == doc[1:])[0]
            both[same] += z[same + 1]
            best: dict[tuple, tuple] = {}
            first = np.searchsorted(stretch, np.arange(base[-1] + 1))

            def enough(w: np.ndarray, item: np.ndarray, first=first, base=base, doc=doc, word=word) -> np.ndarray:
                """Whether the words around a window hold as many different words of the item as a leak needs."""
                wide = 1 + -(-np.maximum(half, sizes[item]) // half)
                lo = np.maximum(w - wide + 1, base[:-1][doc[w]])
                hi = np.minimum(w + 1 + wide, base[1:][doc[w]])
                n = first[hi] - first[lo]
                pair = np.repeat(np.arange(len(w)), n)
                at = np.repeat(first[lo] - np.cumsum(n) + n, n) + np.arange(n.sum())
                key = item[pair] * terms + word[at]
                hit = weighed[np.searchsorted(weighed, key)] == key
                key = np.unique(pair[hit] * terms + word[at[hit]]) // terms
                return np.bincount(key, minlength=len(w)) >= least[item]

            ids = batch.column("doc_id").to_pylist()
            places, every = ([np.frombuffer(x.as_py(), np.int32) for x in batch.column(n)] for n in ("places", "words"))
            place = np.concatenate([np.zeros(0, np.int64), *(p + (d << 32) for d, p in enumerate(map(np.int64, places)))])
            every = np.concatenate([np.zeros(0, np.int32), *every])
            for a in range(0, len(both), 4_000):
                cosine = _unit(both[a : a + 4_000]) @ known.T
                w, item = np.nonzero(cosine >= COSINE)
                near = enough(w + a, item)
                w, item, cosine = w[near] + a, item[near], cosine[w[near], item[near]]
                d = doc[w]
                around = np.maximum(half, sizes[item])
                at = (w - base[:-1][d]) * half
                lo = np.searchsorted(place, (d << 32) + np.maximum(at - around, 0))
                hi = np.searchsorted(place, (d << 32) + np.minimum(at + PASSAGE + around, (1 << 32) - 1))
                share = items.shares(item, every, lo, hi)
                for r in np.nonzero(share >= LCS_ANSWER)[0].tolist():
                    i, j, first_word, part = int(d[r]), int(item[r]), int(at[r] - around[r]), float(share[r])
                    answer = items.has_answer(j, every[lo[r] : hi[r]].tolist())
                    if part >= LCS or answer:
                        row = (ids[i], items.ids[j], max(0, first_word), int(at[r] + PASSAGE + around[r]), round(float(cosine[r]), 6), round(part, 6), answer)
                        old = best.get((i, j))
                        if old is None or (-row[5], row[2]) < (-old[5], old[2]):
                            best[i, j] = row
            found = list(best.values())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True) if found else [[]] * 7, kinds, strict=True)], names)

    return coded.mapInArrow(frugal(look), LEAK) if longest else coded.sparkSession.createDataFrame([], LEAK)


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """Bounded blocks of (item_id, text), one at a time at the driver."""
    block, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("i"), "text").orderBy("i", "text").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(row.text or "") > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row.i, row.text))
        chars += len(row.text or "")
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each (doc_id, item_id) that leaks: where its best window's surroundings lie (in words), its cosine, the
    share of the item in the common subsequence, and whether the answer is there."""
    found = docs.sparkSession.createDataFrame([], LEAK)
    for block in blocks_of(benchmark):
        items = Items(block)
        if not items.number:
            continue
        coded = staged(encode(docs, items), "coded")
        idf = weights(*frequencies(coded, len(items.number)), items)
        found = found.unionByName(search(coded, items, idf, right_vectors(coded, idf)))
    best = F.max_by(F.struct("first_word", "last_word", "cosine", "lcs", "answer"), F.struct("lcs", -F.col("first_word"), "cosine")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")




def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak an item; with a repeated doc_id, all its rows go."""
    bad = staged(leaks(docs, benchmark).select("doc_id").distinct().withColumnRenamed("doc_id", "_leak"), "leaks")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti")
