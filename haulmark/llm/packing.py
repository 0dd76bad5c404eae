"""Packing of documents into fixed-length sequences: first-fit decreasing in randomised groups.

Every document's ids (with its end id) are cut into full sequences of ``capacity`` ids and a remainder.
Full pieces are sequences of their own. Remainders are dealt by hash into groups of a bounded expected size;
each group is packed on its own by first-fit decreasing, the first bin that still fits found by descending a
tournament tree of bin capacities. Then the emptiest bins are taken apart and their pieces cut to fill the gaps
of the others, and the ids that are left make sequences of power-of-two lengths, which need no padding.

Defined cases: a null text is an empty one (its end id alone); repeated rows are separate documents, each packed;
ties in length are broken by doc_id, then text hash; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm._common import frugal, small_batches, text_or_empty
from haulmark.llm.chunked_tokens import encoded, encoder

GROUP_DOCS = 2_048
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " sequence_length long, group_id long"
)


class Tournament:
    """A complete binary tree over bins; a node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """The leftmost bin with that much room; takes it."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < need:
                node += 1
        room[node] -= need
        bin_ = node - self.size
        node //= 2
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node //= 2
        return bin_


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in item, length). Items must be of 1 to capacity ids."""
    if not lengths:
        return []
    tree, bins = Tournament(len(lengths), capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = tree.first_fit(lengths[item])
        while at >= len(bins):
            bins.append([])
        bins[at].append((item, 0, lengths[item]))
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    lo, hi, loose = 0, len(order) - 1, []
    while lo < hi:  # fill the fullest bin that has a gap from the emptiest one
        gap = capacity - fill[order[lo]]
        if gap == 0:
            lo += 1
            continue
        if not loose:
            loose = sorted(bins[order[hi]], key=lambda p: p[2])
            bins[order[hi]] = loose
        item, start, length = loose.pop(0)
        take = min(gap, length)
        bins[order[lo]].append((item, start, take))
        fill[order[lo]] += take
        fill[order[hi]] -= take
        if take < length:
            loose.insert(0, (item, start + take, length - take))
        if not loose:
            hi -= 1
    out = []
    for b in order:
        if not bins[b]:
            continue
        rest, left = list(bins[b]), sum(p[2] for p in bins[b])
        if left == capacity:
            out.append(rest)
            continue
        while left:  # what is left over: powers of two, largest first
            room, seq = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                item, start, length = rest.pop(0)
                take = min(room, length)
                seq.append((item, start, take))
                room -= take
                if take < length:
                    rest.insert(0, (item, start + take, length - take))
            out.append(seq)
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, boundary: str, end_id: int, capacity: int = 1024, seed: int = 17, group_docs: int = GROUP_DOCS
) -> DataFrame:
    """A row per piece. Only remainders of under ``capacity`` ids go through the one shuffle, with a small row for
    each full piece; a group holds about ``group_docs`` remainders, however long the documents are."""
    spark = docs.sparkSession
    small_batches(spark)
    groups = max(1, -(-docs.count() // group_docs))
    cut_schema = "group_id long, doc_id long, tie long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
    names = [c.split()[0] for c in cut_schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, boundary), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        kinds = [pa.int64()] * 7 + [pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            ids_, groups_, ties = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for doc_id, own, group, tie in zip(ids_, encoded(enc, batch.column(1)), groups_, ties, strict=True):
                raw = own + end
                n = len(raw) // 4
                for at in range(0, len(raw), step):
                    ids = raw[at : at + step]
                    whole = len(ids) == step
                    out.append((group, doc_id, tie, at // 4, len(ids) // 4, n, zlib.crc32(ids), None if whole else ids))
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 4096], strict=True), kinds, strict=True)], names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(group: int, rows: list[tuple]) -> pa.RecordBatch:
            out, seq = [], 0
            base = group << 32
            for doc_id, _, start, length, n, crc, ids in rows:
                if ids is None:
                    out.append((doc_id, start, length, crc, n, base + seq, 0, length, group))
                    seq += 1
            rest = [r for r in rows if r[6] is not None]
            for pieces in pack([r[3] for r in rest], capacity):
                at, total = 0, sum(p[2] for p in pieces)
                for item, start, length in pieces:
                    doc_id, _, doc_start, _, n, _, ids = rest[item]
                    out.append((doc_id, doc_start + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, base + seq, at, total, group))
                    at += length
                seq += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

        now, rows = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*cols, strict=True):
                if row[0] != now:
                    if rows:
                        yield packed(now, rows)
                    now, rows = row[0], []
                rows.append(row[1:])
        if rows:
            yield packed(now, rows)

    order = ["group_id", F.coalesce(F.length("ids"), F.lit(4 * capacity)).desc(), "doc_id", "tie", "start"]
    return (
        docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())  # its place in the input: so copies of a row don't share a group
        .withColumn("group_id", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie", "row"), F.lit(groups)))
        .select("doc_id", "text", "group_id", "tie")
        .mapInArrow(frugal(cut), cut_schema)
        .repartition("group_id")
        .sortWithinPartitions(*order)
        .mapInArrow(frugal(fill), PIECES)
    )
