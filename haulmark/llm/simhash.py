"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half the hashes of the text's word shingles. To find
all pairs within a Hamming distance, the fingerprint is cut into blocks: of two close fingerprints at least one block
is closer still (pigeonhole). A block's anchors are the words of a perfect Hamming code (covering radius 1). The point
half-way between two blocks that differ in d bits has an anchor within 1 of it, so both lie within 1 + ceil(d / 2) of
that anchor. Each fingerprint is therefore replicated to every anchor within that distance, and fingerprints are
compared only with those at the same anchor. The search is exact.

Where a link also needs a Jaccard similarity, a longer distance is asked for, and anchors of so few bits would hold a
fixed share of all texts. There the anchors are pairs of shingles, each the least of the text's by one of ``2 * ANCHORS``
hashes: two texts with a Jaccard similarity of j share any one of them in j * j of cases, whatever the number of texts,
and fingerprints are compared at shared anchors only. At j = 0.8 all of them are missed by 4 pairs of 100,000.

Equal fingerprints are one row from the start. Anchors that hold more than ``BLOCK`` fingerprints are cut into blocks,
every two of which meet in a task of their own. From one task, a dense set of links leaves as a spanning star. Where a
link also needs a Jaccard similarity, which no star can stand for, the rows of dense sets are gone over again in rounds,
nearest first, until every pair that meets is checked, ruled out or in one component already.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; fewer words than a
shingle's give one shingle of them all; a null doc_id never names a component unless all its documents have none;
repeated rows fall into one component; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm._common import frugal, mark, remove_since, small_batches, staged, staged_at, text_or_empty
from haulmark.llm.components import components

BLOCK = 1_024
#: Rows with more links than this at one anchor are left to the rounds; a first round takes so many links a row and
#: anchor, each further one WIDER times as many.
CROWD, NEAREST, WIDER = 4, 1, 32
NO_ID = (1 << 63) - 1
#: Anchors of a text by pairs of shingles. With several fingerprints a mean distance of so many bits more is near, too.
ANCHORS, SLACK = 10, 5
#: Of a row, for the exact bound on its similarity to others.
BOUND = ("root", *(f"s{i}" for i in range(5)))
#: Up to so many hot anchors or documents (16 bytes each) are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 100_000


def layout(distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, anchor distance) of the blocks that find all pairs within the distance. Bits between blocks are
    left to the comparison."""
    if distance <= 5:  # of two blocks one differs in 2 bits at most
        return [(0, 31, 2), (32, 31, 2)]
    if distance <= 11:  # of four blocks one differs in 2 bits at most
        return [(s, 15, 2) for s in (0, 16, 32, 48)]
    if distance <= 12:  # or else each in 3
        return [(s, 15, 3 if s == 0 else 2) for s in (0, 16, 32, 48)]
    raise ValueError("distances over 12 of 64 bits aren't selective enough to index")


def patterns(bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome of the Hamming code of that length, the error patterns up to the radius that have it: a table
    with a row a syndrome, and how many entries of the row count."""
    found: list[list[int]] = [[] for _ in range(bits + 1)]
    for weight in range(radius + 1):
        for places in combinations(range(bits), weight):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1
            found[syndrome].append(sum(1 << p for p in places))
    table = np.zeros((bits + 1, max(map(len, found))), np.uint64)
    for s, row in enumerate(found):
        table[s, : len(row)] = row
    return table, np.array([len(r) for r in found])


def anchors(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of fp, anchor key) for every anchor of every block that the fingerprint is replicated to."""
    rows, keys = [], []
    for number, (shift, bits, radius) in enumerate(layout(distance)):
        table, count = patterns(bits, radius)
        part = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        syndrome = np.zeros(len(fp), np.int64)
        for p in range(bits):
            syndrome ^= np.where((part >> np.uint64(p)) & np.uint64(1), p + 1, 0)
        takes = np.arange(table.shape[1])[None, :] < count[syndrome][:, None]
        rows.append(np.broadcast_to(np.arange(len(fp))[:, None], takes.shape)[takes])
        keys.append((part[:, None] ^ table[syndrome])[takes] | np.uint64(number << 32))
    return np.concatenate(rows), np.concatenate(keys)


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - size + 1)
    spans = zip(starts[:n].tolist(), (ends[min(size, len(words)) - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(text[s:e], 42) for s, e in spans), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(np.uint64)[0])


def links_in(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one anchor's fingerprints that connect what links connect. Few links: each of them. Dense sets: a star for
    each component."""
    n, left, right = len(fp), [], []
    for i in range(0, n, 256):
        near = np.bitwise_count(fp[i : i + 256, None] ^ fp[None, i:]) <= distance
        a, b = np.nonzero(near)
        keep = a < b
        left.append(a[keep] + i)
        right.append(b[keep] + i)
        if sum(map(len, left)) > 8 * n:
            break
    else:
        return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
    left, right = [], []
    rest = np.arange(n)
    while len(rest):
        seed, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for i in range(0, len(front), 256):
                hit |= (np.bitwise_count(fp[front[i : i + 256], None] ^ fp[None, rest]) <= distance).any(0)
            front, rest = rest[hit], rest[~hit]
            left.append(np.full(len(front), seed))
            right.append(front)
    return np.concatenate(left), np.concatenate(right)


def near(x: np.ndarray, y: np.ndarray, distance: int, views: int = 1) -> np.ndarray:
    """Whether fingerprints are within the distance. With several views, which the last axis holds: by any of them, or by their
    mean within SLACK bits more."""
    apart = np.bitwise_count(x ^ y)
    return apart <= distance if views == 1 else (apart <= distance).any(-1) | (apart.sum(-1, dtype=np.int64) <= (distance + SLACK) * views)


def near_in(fp: np.ndarray, distance: int, ok: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of one anchor's fingerprints (or rows of them, one a view) that are near, of those that are ok."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(fp), 256):
        a, b = np.nonzero(near(fp[i : i + 256, None], fp[None, i:], distance, fp.shape[1] if fp.ndim > 1 else 1))
        keep = a < b
        a, b = a[keep] + i, b[keep] + i
        if ok:
            keep = ok(a, b)
            a, b = a[keep], b[keep]
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def can_be_similar(more: np.ndarray, jaccard: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows, with more[row] the row's component and sketch(): whether they are of two components and can have the
    similarity. Sets with it differ in at most (1 - j) / (1 + j) of the sum of their sizes; sketches differ in no more bits, nor
    the sizes by more."""
    root, size = more[:, 0], more[:, 1]
    out = root[a] != root[b]
    a, b = a[out], b[out]
    least = np.maximum(bits_apart(more, a, b), np.abs(size[a] - size[b]))
    out[out] = least <= (1 - jaccard) / (1 + jaccard) * (size[a] + size[b]) + 1e-6
    return out


def bits_apart(more: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits = more[:, 2:].view(np.uint64)
    return np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)


def links_or_crowd(fp: np.ndarray, distance: int, ok: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one anchor's fingerprints: each link that is ok, but of those between two rows with over CROWD links each
    only the loops of the rows."""
    a, b = near_in(fp, distance, ok)
    crowd = np.bincount(np.concatenate([a, b]), minlength=len(fp)) > CROWD
    keep, loops = ~(crowd[a] & crowd[b]), np.nonzero(crowd)[0]
    return np.concatenate([a[keep], loops]), np.concatenate([b[keep], loops])


def nearest_in(fp: np.ndarray, distance: int, jaccard: float, most: int, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one anchor's fingerprints, with more[row] the row's component and sketch(): the ``most`` nearest links
    of each row to other components that can have the similarity; a loop for each row with a link that is left out."""
    size = more[:, 1]
    a, b = near_in(fp, distance, lambda a, b: can_be_similar(more, jaccard, a, b))
    share = bits_apart(more, a, b) / np.maximum(1, size[a] + size[b])
    row = np.concatenate([a, b])
    order = np.lexsort([np.concatenate([b, a]), np.concatenate([share, share]), row])
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    now = np.minimum(rank[: len(a)], rank[len(a) :]) < most
    loops = np.unique(np.concatenate([a[~now], b[~now]]))
    return np.concatenate([a[now], loops]), np.concatenate([b[now], loops])


def sketch(hashes: np.ndarray) -> list[int]:
    """Of the set of shingles its size and 256 bits, each whether an odd number of its shingles falls there, as 64-bit integers."""
    own = np.unique(hashes)
    odd = np.bincount((remixed(own, 7) >> np.uint64(56)).astype(np.int64), minlength=256) % 2
    return [len(own), *np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()]


def remixed(hashes: np.ndarray, view: int) -> np.ndarray:
    """Other hashes of the same shingles; view 0 are the hashes themselves."""
    if view == 0:
        return hashes
    x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * view)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def least_pairs(hashes: np.ndarray, number: int) -> list[int]:
    """Of the set of shingles so many keys: each of two shingles, the least by hashes of their own. None for no shingles."""
    if not len(hashes):
        return []
    factors = np.uint64(0x9E3779B97F4A7C15) + np.arange(16, 16 + 4 * number, 2, dtype=np.uint64)
    least = np.full(2 * number, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        x = hashes[i : i + (1 << 12)] * factors[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        least = np.minimum(least, x.min(1))
    return (least[::2] * np.uint64(0xC2B2AE3D27D4EB4F) ^ least[1::2]).view(np.int64).tolist()


def fingerprints(docs: DataFrame, words: int, views: int = 1, sketches: bool = False) -> DataFrame:
    """(doc_id, tie, fps, node, sketch, keys): tie is a hash of the text, node one of its words; fps holds a fingerprint by each
    of so many independent hashes; sketch and keys, the least pairs, are empty unless asked for."""
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            fps, nodes, own_sketches, keys = [], [], [], []
            for text in batch.column(1):
                w = words_of(text.as_py())
                hashes = shingle_hashes(w, words)
                fps += [fingerprint(remixed(hashes, v)) for v in range(views)]
                nodes.append(xxh3_64_intdigest(b" ".join(w)))
                own_sketches.append(sketch(hashes) if sketches else [])
                keys.append(least_pairs(hashes, ANCHORS) if sketches else [])
            flat, own = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, views, dtype=np.int32)), flat)
            cols = [batch.column(0), batch.column(2), lists, own, *(pa.array(x, pa.list_(pa.int64())) for x in (own_sketches, keys))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tie", "fps", "node", "sketch", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    return rows.mapInArrow(frugal(compute), "doc_id long, tie long, fps array<long>, node long, sketch array<long>, keys array<long>")


def covering(nodes: DataFrame, distance: int) -> DataFrame:
    """nodes(view, fp, node, first) -> (key, node, first, f0): a row for every anchor that a fingerprint is replicated to."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_048):
                part = batch.slice(i, 2_048)
                rows, keys = anchors(part.column(2).to_numpy().view(np.uint64), distance)
                if len(rows):
                    keys = keys.view(np.int64) | part.column(3).to_numpy().astype(np.int64)[rows] << 40
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(pa.array(rows)) for c in part.columns[:3])], ["key", "node", "first", "f0"])

    return nodes.select("node", "first", "fp", "view").mapInArrow(frugal(replicate), "key long, node long, first long, f0 long")


def links(spread: DataFrame, distance: int, views: int = 1, inside: Callable | None = None, few: int = 16, ok: Callable | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """spread(key, node, first, f0, ...), with a fingerprint a view -> (a, b), structs (first, node) of nodes near each other
    at an anchor, the smaller first. At anchors of over ``few`` rows ``inside`` has its say, from the fingerprints and the
    columns ``more``; at the others each link counts that is ok by these columns."""
    spark = spread.sparkSession
    inside = inside or (lambda fp, _: links_in(fp, distance))
    prints, last_print = [f"f{i}" for i in range(views)], 4 + views

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.nonzero((rows[1:, :2] != rows[:-1, :2]).any(1))[0] + 1
            bounds = np.concatenate([[0], cut, [len(rows)]])
            size = np.diff(bounds)
            left, right = [], []
            small = np.repeat(size <= few, size)
            fp = rows[:, 4 if views == 1 else slice(4, last_print)].view(np.uint64)
            run = np.repeat(np.arange(len(size)), size)
            for shift in range(1, min(few, int(size.max(initial=0)))):
                hit = np.nonzero(small[:-shift] & (run[:-shift] == run[shift:]) & near(fp[:-shift], fp[shift:], distance, views))[0]
                if ok:
                    hit = hit[ok(rows[:, last_print:], hit, hit + shift)]
                left.append(hit)
                right.append(hit + shift)
            for r in np.nonzero(size > few)[0]:
                own = slice(bounds[r], bounds[r + 1])
                a, b = inside(fp[own], rows[own, last_print:])
                left.append(a + bounds[r])
                right.append(b + bounds[r])
            if left and len(a := np.concatenate(left)):
                b = np.concatenate(right)
                pairs = np.unique(np.concatenate([rows[a][:, [3, 2]], rows[b][:, [3, 2]]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(4)], ["a_first", "a_node", "b_first", "b_node"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], 1))
            if sum(map(len, held)) < 50_000:
                continue
            rows = np.concatenate(held)
            last = np.nonzero((rows[:, :2] != rows[-1, :2]).any(1))[0]
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from found(rows[:cut])
            held = [rows[cut:]]
        if held and sum(map(len, held)):
            yield from found(np.concatenate(held))

    hot = staged(spread.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("k")), "hot")
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(j, own) * F.col("k") + F.greatest(j, own))
    dealt = (
        spread.join(hot, "key", "left")
        .withColumn("k", F.coalesce("k", F.lit(1)))
        .select("key", F.explode(cells).alias("cell"), "node", "first", *prints, *more)
        .withColumn("cell", F.col("cell").cast("long"))
    )
    pairs = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "first", "node").mapInArrow(frugal(compare), "a_first long, a_node long, b_first long, b_node long")
    end = lambda x: F.struct(F.col(f"{x}_first").alias("first"), F.col(f"{x}_node").alias("node"))
    return pairs.select(end("a").alias("a"), end("b").alias("b")).distinct()


def _similar(edges: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, jaccard: float) -> DataFrame:
    """Those edges whose texts' sets of word shingles have that Jaccard similarity."""
    spark = docs.sparkSession
    ends = staged(edges.select(F.col("a").alias("end")).union(edges.select("b")).distinct().select("end.first", "end.node"), "ends")
    wanted = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    small_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("first"), text_or_empty().alias("text")).withColumn("first", F.coalesce("first", F.lit(NO_ID)))
    near = keyed.join(wanted.select("first").distinct() if wanted is ends else F.broadcast(ends.select("first").distinct()), "first", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            nodes_, sets_ = [], []
            for text in batch.column(1):
                w = words_of(text.as_py())
                nodes_.append(xxh3_64_intdigest(b" ".join(w)))
                sets_.append(np.unique(shingle_hashes(w, words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes_, np.uint64).view(np.int64)), pa.array(sets_, pa.binary())], ["first", "node", "shingles"])

    held = staged(near.mapInArrow(frugal(sets), "first long, node long, shingles binary").dropDuplicates(["first", "node"]), "shingles")
    side = lambda x: held.select(F.struct("first", "node").alias(x), F.col("shingles").alias(f"{x}_set"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(len(p) + len(q) == 0 or both >= jaccard * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], batch.schema.names[:2]).filter(pa.array(keep))

    kind = "struct<first:bigint,node:bigint>"
    return edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(frugal(measure), f"a {kind}, b {kind}")


def _checked_links(nodes: DataFrame, docs: DataFrame, words: int, distance: int, jaccard: float, views: int) -> DataFrame:
    """Links (a, b) of nodes that share an anchor, are near and have that Jaccard similarity: enough of them to connect what all
    of them connect. nodes has fps, node, first, sketch, keys.

    A first pass takes all links but those between two crowded rows of an anchor. The crowded rows are then compared at all
    their anchors again, in rounds: only links to other components count, of those only the ones that sizes and sketches
    allow (an exact bound), nearest first. A round before the others does so at the first anchor of each row alone: it joins
    most of a large group by few links, which the others then need not tell again at every anchor. The rounds end when no
    such link is left out."""
    spark = docs.sparkSession
    own_columns = [*(F.col("fps")[i].alias(f"f{i}") for i in range(views)), "root", *(F.col("sketch")[i].alias(f"s{i}") for i in range(5))]
    spread = lambda df: df.select(F.explode("keys").alias("key"), "node", "first", *own_columns)
    ok = lambda own, a, b: can_be_similar(own, jaccard, a, b)
    crowded = lambda fp, own: links_or_crowd(fp, distance, lambda a, b: ok(own, a, b))
    found = staged(links(spread(nodes.withColumn("root", F.col("node"))), distance, views, crowded, ok=ok, more=BOUND), "candidates")
    tested = found.where("a <> b")
    good = staged(_similar(tested, docs, nodes, words, jaccard), "links")
    most, opening = NEAREST, True
    while crowd := found.where("a = b").count():
        start = mark(spark)
        rows = found.where("a = b").select("a.first", "a.node")
        own = nodes.join(F.broadcast(rows) if crowd <= BROADCAST_ROWS else rows, ["first", "node"], "left_semi")
        roots = components(good).select(F.col("node.node").alias("node"), F.col("node.first").alias("first"), F.col("root.node").alias("root"))
        own = staged(own.join(roots, ["first", "node"], "left").withColumn("root", F.coalesce("root", "node")), "crowd")
        at = spread(own.withColumn("keys", F.slice("keys", 1, 1)) if opening else own)
        pairs = links(at, distance, views, lambda fp, own_, n=most: nearest_in(fp, distance, jaccard, n, own_), 1, more=BOUND)
        pairs, keep = staged_at(pairs, "candidates")
        fresh, also = staged_at(pairs.where("a <> b").join(tested, ["a", "b"], "left_anti"), "fresh")
        good, last = staged_at(good.union(_similar(fresh, docs, nodes, words, jaccard)), "links")
        remove_since(spark, start, (keep, also, last))
        tested = tested.union(fresh)
        if not opening:
            found, most = pairs, most * WIDER
        opening = False
    return good


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, jaccard: float | None = None, views: int = 1) -> DataFrame:
    """(doc_id, tie, fp, root, component_id): a row per document; root names its class, component_id is the smallest doc_id in
    it.

    Without ``jaccard`` a link is a Hamming distance of at most ``distance``. With it, a link also needs that Jaccard
    similarity of the two texts' shingle sets; the candidates are then the pairs that share an anchor and are near() by
    ``views`` independent fingerprints. (Fingerprints estimate the similarity: of pairs with a Jaccard similarity of 0.8 one
    fingerprint brings about 3 of 4 within 11 bits.)"""
    own = "fp" if jaccard is None else "node"
    prints = staged(fingerprints(docs, words, views, jaccard is not None).withColumn("fp", F.col("fps")[0]), "prints")
    first = F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first")
    nodes = staged(prints.groupBy("fps", "sketch", "keys", F.col(own).alias("node")).agg(first), "nodes")
    if jaccard is None:
        edges = links(covering(nodes.select(F.posexplode("fps").alias("view", "fp"), "node", "first"), distance), distance)
    else:
        edges = _checked_links(nodes, docs, words, distance, jaccard, views)
    roots = components(edges).select(F.col("node.node").alias("node"), F.col("node.first").alias("first"), "root")
    own_root = F.coalesce("root", F.struct("first", "node"))
    classes = staged(nodes.select("node", "first").join(roots, ["node", "first"], "left").select(F.col("node").alias("key"), own_root.alias("root")), "classes")
    joined = prints.withColumn("key", F.col(own)).join(classes, "key")
    return joined.select("doc_id", "tie", "fp", "root", F.nullif("root.first", F.lit(NO_ID)).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, distance: int = 11, jaccard: float = 0.8, views: int = 3) -> DataFrame:
    """docs with one row of each class: the one with the smallest doc_id, of several such rows the one with the least text
    hash, of rows with the same text any."""
    found = near_duplicates(docs, words, distance, jaccard, views)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "tie"))
    keep = staged(found.groupBy("root").agg(first.alias("k")).select("k.d", "k.tie"), "kept")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text_or_empty()).alias("tie"))
    return own.join(keep, ["d", "tie"]).dropDuplicates(["d", "tie"]).select("row.*")
