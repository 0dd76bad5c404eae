"""Exact top-k by inner product over a pivot-distance index.

Vectors are integers. With M the largest norm, a vector x gets the extra coordinate sqrt(M^2 - |x|^2) and a query 0, so
that the inner product falls as the Euclidean distance grows. The index keys each vector by its nearest pivot and its
distance to it, sorted, in chunks: a chunk is a stretch of an annulus, with its least and greatest distance; GROUP
neighbouring chunks are what a task reads. Queries come in blocks of neighbours. The search has two rounds:

1. Each block visits the groups with the least lower bounds (the triangle inequality, from distances to the pivots), by
   rising bound of their chunks. That gives each query its k-th distance so far.
2. Bounds alone, without any vector, tell which other groups can hold anything nearer to some query of a block. Only these
   are visited. A query skips a chunk whose bound exceeds its k-th distance.

In both rounds a task holds one group of the index and the blocks come to it, so that the index is moved once for each
BLOCKS_A_TASK blocks that need a group, and not once a block.

Equal vectors are one entry that keeps the k + 1 smallest different ids with their repeats, which is all that any query can
need.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as
padded with zeros; repeated ids are separate candidates, but no row with the query's own id is one; ties go to the
smaller id; an empty table gives no rows. Scores are exact while they fit 63 bits. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm._common import frugal, staged

PIVOTS, CHUNK, GROUP, QUERY_BLOCK, BLOCKS_A_TASK, FIRST = 64, 1_024, 16, 1_024, 64, 2

INDEX = "chunk long, pivot int, lo double, hi double, ids array<long>, offsets array<int>, v binary"
BLOCK = "block long, ids array<long>, v binary, lo array<double>, hi array<double>"
FOUND = "block long, query long, query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of vectors that take part."""
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & real).select(F.col("vec_id").cast("long"), scaled.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy()
    return out


class Space:
    """Pivots and distances in the space with the extra coordinate."""

    def __init__(self, pivots: np.ndarray, square: float):
        self.square = square
        self.pivots = pivots.astype(float)
        self.rest = np.sqrt(np.maximum(0, square - (self.pivots**2).sum(1)))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        rest = np.sqrt(np.maximum(0, self.square - (x**2).sum(1)))
        return np.sqrt(np.maximum(0, 2 * self.square - 2 * (x @ self.pivots.T + rest[:, None] * self.rest)))

    def reach(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The distance of a vector with a query's least score; a little more, against rounding."""
        square = (q.astype(float) ** 2).sum(1)
        return np.sqrt(np.maximum(0, square + self.square - 2 * least.astype(float))) * (1 + 1e-9) + 1e-6

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(float)
        return np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + self.square - 2 * q @ self.pivots.T))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating-point matrices where these are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if most < 2**53 else q @ x.T


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray):
        """least: the score that each query's k-th best has at least."""
        self.ids, self.k, self.least = ids, k, least.copy()
        self.query = self.score = self.other = np.zeros(0, np.int64)

    def add(self, queries: np.ndarray, scores: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        bound = self.least[queries]
        if scores.shape[1] > self.k + 1:  # the own vector may be among the best
            at = scores.shape[1] - self.k - 1
            bound = np.maximum(bound, np.partition(scores, at, axis=1)[:, at])
        q, v = np.nonzero(scores >= bound[:, None])
        n = np.diff(offsets)[v]
        at = np.repeat(offsets[:-1][v] - np.cumsum(n) + n, n) + np.arange(n.sum())
        query, other = np.repeat(queries[q], n), ids[at]
        keep = other != self.ids[query]
        query = np.concatenate([self.query, query[keep]])
        score = np.concatenate([self.score, np.repeat(scores[q, v], n)[keep]])
        other = np.concatenate([self.other, other[keep]])
        order = np.lexsort([other, -score, query])
        query, score, other = query[order], score[order], other[order]
        first = np.searchsorted(query, query, "left")
        keep = np.arange(len(query)) - first < self.k
        self.query, self.score, self.other = query[keep], score[keep], other[keep]
        full, last = np.bincount(self.query, minlength=len(self.ids)) >= self.k, np.searchsorted(self.query, np.arange(len(self.ids)), "right") - 1
        self.least[full] = np.maximum(self.least[full], self.score[last[full]])


def build_index(vectors: DataFrame, k: int) -> tuple[DataFrame, Space | None, int]:
    """(chunk, pivot, lo, hi, ids, offsets, v): the index, its space and the vectors' width."""
    first = Window.partitionBy("v").orderBy("vec_id")
    counted = vectors.groupBy("v", "vec_id").agg(F.count("*").alias("copies"))
    few = counted.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    # of a repeated id k + 1 copies are as many as any query can need
    each = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "copies"))), lambda x: F.array_repeat(x["vec_id"], F.least(x["copies"], F.lit(k + 1)).cast("int"))))
    entries = staged(few.groupBy("v").agg(each.alias("ids")), "entries")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = entries.agg(F.max(norm), F.max(F.size("v"))).first()
    if top[1] is None:
        return None, None, 0
    width = max(1, top[1])
    least = [r.h for r in entries.select(F.xxhash64("v").alias("h")).orderBy("h").limit(PIVOTS).collect()]
    sample = sorted(entries.select("v").where(F.xxhash64("v").isin(least)).collect(), key=lambda r: r.v)
    pivots = np.array([[*r.v, *[0] * (width - len(r.v))] for r in sample], np.int64)
    space = Space(pivots, top[0])
    keyed = "pivot int, distance double, ids array<long>, v array<long>"

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.of_vectors(_matrix(batch.column(0), width))
            near = d.argmin(1)
            cols = [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), batch.column(1), batch.column(0)]
            yield pa.RecordBatch.from_arrays(cols, ["pivot", "distance", "ids", "v"])

    schema = INDEX

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, base = 0, TaskContext.get().partitionId() * (GROUP << 32)
        for batch in batches:
            pivot = batch.column(0).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(pivot))[0] + 1).tolist(), len(pivot)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for at in range(a, b, CHUNK):
                    part = batch.slice(at, min(CHUNK, b - at))
                    d = part.column(1).to_numpy()
                    ids = part.column(2).to_pylist()
                    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).tolist()
                    cols = [base + number, int(pivot[at]), float(d[0]), float(d[-1]), [i for own in ids for i in own], offsets, _matrix(part.column(3), width).tobytes()]
                    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])
                    number += 1

    sorted_ = entries.select("v", "ids").mapInArrow(frugal(key), keyed)
    sorted_ = staged(sorted_, "keyed").repartitionByRange("pivot", "distance").sortWithinPartitions("pivot", "distance")
    return staged(sorted_.mapInArrow(frugal(chunks), schema), "index"), space, width


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors and queries (vec_id, v) -> (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    index, space, width = build_index(vectors, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = space.of_queries(_matrix(batch.column(1), width)).argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], ["pivot", "vec_id", "v"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, base = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                q = _matrix(part.column(2), width)
                d = space.of_queries(q)
                cols = [base + number, part.column(1).to_pylist(), q.tobytes(), d.min(0).tolist(), d.max(0).tolist()]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.float64())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])
                number += 1

    near = staged(queries.mapInArrow(frugal(keyed), "pivot int, vec_id long, v array<long>"), "queries")
    asked = staged(near.repartitionByRange("pivot", "vec_id").sortWithinPartitions("pivot", "vec_id").mapInArrow(frugal(blocks), BLOCK), "blocks")
    # lower bounds of every block and group, from ranges of distances alone
    group = F.expr(f"chunk div {GROUP}").alias("group")
    rings = index.select(group, "pivot", "lo", "hi").groupBy("group", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ranges = asked.select("block", F.posexplode(F.zip_with("lo", "hi", lambda x, y: F.struct(x.alias("q_lo"), y.alias("q_hi")))).alias("pivot", "r")).select("block", "pivot", "r.*")
    bound = F.greatest(F.lit(0.0), F.col("q_lo") - F.col("hi"), F.col("lo") - F.col("q_hi"))
    pairs = staged(rings.join(ranges, "pivot").select("block", "group", bound.alias("bound")).groupBy("block", "group").agg(F.min("bound").alias("bound")), "pairs")
    nearest = F.row_number().over(Window.partitionBy("block").orderBy("bound", "group"))
    first = staged(pairs.withColumn("n", nearest).where(F.col("n") <= FIRST).select("block", "group"), "first")
    none = asked.select("block", F.lit(None).cast("binary").alias("least"))
    found = staged(_visit(index, asked.join(none, "block"), first, space, width, k), "found")

    place = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    kth = found.withColumn("n", F.row_number().over(place)).where(F.col("n") == k).groupBy("block").agg(F.collect_list(F.struct("query", "score")).alias("kth"))

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, v, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = np.frombuffer(v, np.int64).reshape(-1, width)
                least = np.full(len(q), np.iinfo(np.int64).min)
                for x in known or ():
                    least[x["query"]] = x["score"]
                cols = [pa.array([b], pa.int64()), pa.array([least.tobytes()], pa.binary()), pa.array([float(space.reach(q, least).max(initial=0))], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "least", "reach"])

    known = staged(asked.select("block", "v").join(kth, "block", "left").mapInArrow(frugal(reaches), "block long, least binary, reach double"), "reaches")
    rest = pairs.join(known.select("block", "reach"), "block").where("bound <= reach").join(first, ["block", "group"], "left_anti").select("block", "group")
    more = _visit(index, asked.join(known.select("block", "least"), "block"), rest, space, width, k)
    order = Window.partitionBy("query_id", "block", "query").orderBy(F.desc("score"), "vec_id")
    best = found.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _visit(index: DataFrame, asked: DataFrame, pairs: DataFrame, space: Space, width: int, k: int) -> DataFrame:
    """What each block of queries (block, ids, v, least) finds in the groups that pairs (block, group) names: (block, query,
    query_id, vec_id, score), at most k a query and group."""
    part = F.expr(f"cast(row_number() over (partition by group order by block) as bigint) div {BLOCKS_A_TASK}").alias("part")
    dealt = staged(pairs.select("block", "group", part), "visits")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = index.withColumn("group", F.expr(f"chunk div {GROUP}")).join(dealt.select("group", "part").distinct(), "group")
    chunks = own.select("group", "part", F.lit(-1).cast("long").alias("block"), "pivot", "lo", "hi", "ids", "offsets", "v", none("binary", "least"))
    heads = dealt.join(asked, "block").select("group", "part", "block", none("int", "pivot"), none("double", "lo"), none("double", "hi"), "ids", none("array<int>", "offsets"), "v", "least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                at = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                if at != now:
                    now, held = at, []
                block, pivot, lo, hi, ids, offsets, v, least = (batch.column(c)[r].as_py() for c in range(2, 10))
                rows, ids = np.frombuffer(v, np.int64).reshape(-1, width), np.array(ids, np.int64)
                if block < 0:
                    held.append((pivot, lo, hi, ids, np.array(offsets, np.int64), rows))
                    continue
                d = space.of_queries(rows)
                start = np.frombuffer(least, np.int64) if least is not None else np.full(len(rows), np.iinfo(np.int64).min)
                best = Best(ids, k, start)
                gaps = [np.maximum(0, np.maximum(d[:, p] - h, lo_ - d[:, p])) for p, lo_, h, *_ in held]
                for c in sorted(range(len(held)), key=lambda c: gaps[c].min(initial=np.inf)):
                    open_ = np.nonzero(gaps[c] <= space.reach(rows, best.least))[0]
                    if len(open_):
                        _, _, _, others, offs, x = held[c]
                        best.add(open_, products(rows[open_], x), offs, others)
                cols = [np.full(len(best.query), block), best.query, ids[best.query], best.other, best.score]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), [c.split()[0] for c in FOUND.split(", ")])

    visits = chunks.union(heads).repartition("group", "part").sortWithinPartitions("group", "part", "block")
    return visits.mapInArrow(frugal(search), FOUND)
