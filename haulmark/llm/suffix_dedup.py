"""Removal of repeated byte strings of a fixed length, over all documents.

Every substring of ``length`` bytes belongs to exactly one segment: neighbouring starts whose substrings have the same
anchor, the 32-byte window with the least hash. Equal substrings have equal anchors, so only segments with the same
anchor can share one. Then:

1. Anchors are counted (hashes only; nothing else is shuffled for text that has no copy).
2. Where all of an anchor's segments are the same bytes, each is a repeat as a whole.
3. Else one copy of each different segment is fetched and cut at fixed distances from the anchor into cuts of at most CUT
   starts. All substrings of a cut share its middle bytes, so cuts are counted by these; again only cuts with company
   remain, and cuts that are the same bytes are repeats as a whole.
4. Over the cuts that share their middle and differ outside, a column-wise Burrows-Wheeler construction (see bwt.py)
   finds the starts with a common prefix of ``length`` with another suffix. Collections are bounded, so its columns are
   kept in a worker's memory instead of in external files.
5. More than ``COLLECTION`` cuts with the same middle don't fit one collection: their single substrings are counted by
   hash. This is exact for any number.

Segments, shared bytes and substrings are told apart by 128-bit hashes.

Defined cases: a null text is an empty one; repeated rows are separate documents (each makes the other a repeat, and
both get the same result); a null doc_id is a document like any other; an empty table gives no rows. Only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm._common import frugal, small_batches, staged, text_or_empty
from haulmark.llm.bwt import repeated_symbols

GRAM, COLLECTION, BATCH, CUT = 32, 256, 2_000, 24
#: Starts of very long texts are taken in stretches, which bounds memory; position bits in a packed hash.
STRETCH, PLACE = 1 << 22, 24
#: Up to so many documents (16 bytes each) whose bytes are wanted are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 200_000
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]

DOC = ["doc", "tie"]
SEGMENT = "doc long, tie long, at int, n int, anchor int, key long, c1 long, c2 long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    h = data.astype(np.uint64) + np.uint64(1)
    step = 1
    for mult in _MULTIPLIERS:
        h = h[:-step] * np.uint64(mult) + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    return h


def segments_of(raw: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first start, starts, anchor's place after it, anchor's hash) of each segment, in order."""
    window = length - GRAM + 1
    for base in range(0, max(0, len(raw) - length + 1), STRETCH):
        h = gram_hashes(np.frombuffer(raw, np.uint8)[base : base + STRETCH + length - 1])
        v = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= window:
            v = np.minimum(v[:-step], v[step:])
            step *= 2
        if rest := window - step:
            v = np.minimum(v[:-rest], v[rest:])
        place = (v & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
        count = np.diff(np.append(first, len(place)))
        anchor = place[first]
        yield from zip((first + base).tolist(), count.tolist(), (anchor - first).tolist(), h[anchor].view(np.int64).tolist(), strict=True)


def _hash128(raw: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    d = xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _table(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, tie, text): doc and tie tell rows apart but for repeated ones, and are never null."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("tie"), "text"
    )


def segments(docs: DataFrame, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 3]
        for batch in batches:
            rows: list[tuple] = []
            for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py().encode()
                for at, n, anchor, key in segments_of(raw, length):
                    rows.append((doc, tie, at, n, anchor, key, *_hash128(raw[at : at + n - 1 + length])))
                    if len(rows) >= 20_000:
                        yield _table(rows, kinds, _names(SEGMENT))
                        rows = []
            yield _table(rows, kinds, _names(SEGMENT))

    return keyed(docs).select("doc", "tie", "text").mapInArrow(frugal(cut), SEGMENT)


def _uniform():
    return (F.min("c1") == F.max("c1")) & (F.min("c2") == F.max("c2"))


def _fetch(contents: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """contents (key, c1, c2, rep) with their bytes: rep's documents are joined once, with all that is wanted of each."""
    wanted = contents.groupBy("rep.doc", "rep.tie").agg(
        F.collect_list(F.struct("key", "c1", "c2", "rep.at", "rep.n", "rep.anchor")).alias("w")
    )
    texts = keyed(docs).select("doc", "tie", "text")
    keys = staged(wanted.select(*DOC), "wanted")
    if keys.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(keys), DOC, "left_semi")
    texts = texts.dropDuplicates(DOC)
    schema = "key long, c1 long, c2 long, anchor int, raw binary"

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 3, pa.int32(), pa.binary()]
        for batch in batches:
            for text, wanted_ in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode()
                rows = [(w["key"], w["c1"], w["c2"], w["anchor"], raw[w["at"] : w["at"] + w["n"] - 1 + length]) for w in wanted_.as_py()]
                for i in range(0, len(rows), 2_000):
                    yield _table(rows[i : i + 2_000], kinds, _names(schema))

    return texts.join(wanted, DOC).select("text", "w").mapInArrow(frugal(slices), schema)


HIT = "key long, c1 long, c2 long, lo int, hi int"


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.nonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))[0]
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _by_transform(cuts: DataFrame, length: int) -> DataFrame:
    """cuts (key, c1, c2, lo, hi, core, k1, k2, raw) -> (key, c1, c2, lo, hi): runs of starts that are repeats, found in collections
    of all cuts with the same shared bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 3, *[pa.int32()] * 2]

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            strings, weight, group, shared = [], [1] * 257, None, length - CUT + 1
            for *_, lo, hi, core, k1, k2, raw in rows:
                if (k1, k2) != group:  # the bytes that the group shares are one symbol
                    group = (k1, k2)
                    weight.append(shared)
                ends = np.frombuffer(raw[lo:core] + raw[core + shared : hi + length], np.uint8).astype(np.uint16) + np.uint16(1)
                strings.append(np.concatenate([ends[: core - lo], np.array([len(weight) - 1], np.uint16), ends[core - lo :]]))
            hits = repeated_symbols(strings, [r[4] - r[3] + 1 for r in rows], length, np.array(weight, np.int64))
            return _table([(*r[:3], r[3] + lo, r[3] + hi) for r, hit in zip(rows, hits, strict=True) for lo, hi in _runs(hit)], kinds, _names(HIT))

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "c1", "c2", "lo", "hi", "core", "k1", "k2", "raw")), strict=True):
                if len(rows) >= BATCH and row[6:8] != rows[-1][6:8]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    dealt = cuts.select("key", "c1", "c2", "lo", "hi", "core", "k1", "k2", "raw").repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(frugal(find), HIT)


def _by_cuts(contents: DataFrame, length: int) -> DataFrame:
    """contents (key, c1, c2, anchor, raw) -> (key, c1, c2, lo, hi): runs of starts that are repeats."""
    base = "key long, c1 long, c2 long, lo int, hi int, core int, k1 long, k2 long"
    schema = base + ", s1 long, s2 long"

    def table(rows: list[tuple], digests: list[bytes], names: list[str]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [()] * 6
        cols = [pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 3, *[pa.int32()] * 3], strict=True)]
        hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, len(names) - 6)
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(hashes[:, i]) for i in range(hashes.shape[1]))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows, digests = [], []
            for key, c1, c2, anchor, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start, last = 0, len(raw) - length
                while start <= last:  # cuts lie at the same distances from the anchor in every segment
                    place = (anchor - start) // CUT
                    core = anchor - place * CUT  # the last start of a full cut
                    end = min(last, core)
                    rows.append((key, c1, c2, start, end, core))
                    digests.append(xxh3_128_digest(b"%d %d " % (key, place) + raw[core : core - CUT + 1 + length]))
                    digests.append(xxh3_128_digest(b"%d %d " % (core - start, core - end) + raw[start : end + length]))
                    start = end + 1
            for i in range(0, len(rows), 8_000):
                yield table(rows[i : i + 8_000], digests[2 * i : 2 * i + 16_000], _names(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows, digests = [], []
            for key, c1, c2, lo, hi, core, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(key, c1, c2, at, at, core) for at in range(lo, hi + 1)]
                digests += [xxh3_128_digest(raw[at : at + length]) for at in range(lo, hi + 1)]
            for i in range(0, len(rows), 8_000):
                yield table(rows[i : i + 8_000], digests[i : i + 8_000], _names(base))

    wide = contents.select("key", "c1", "c2", "raw")
    first = staged(contents.select("key", "c1", "c2", "anchor", "raw").mapInArrow(frugal(cut), schema), "cuts")
    same = (F.min("s1") == F.max("s1")) & (F.min("s2") == F.max("s2"))
    shared = staged(first.groupBy("k1", "k2").agg(F.count("*").alias("m"), same.alias("same")).where("m > 1"), "shared")
    joined = first.join(shared, ["k1", "k2"])
    open_ = staged(joined.where(~F.col("same")).select("key", "c1", "c2", "lo", "hi", "core", "k1", "k2", "m"), "open")
    few = open_.where(F.col("m") <= COLLECTION).join(wide, ["key", "c1", "c2"])
    many = open_.where(F.col("m") > COLLECTION).join(wide, ["key", "c1", "c2"]).select("key", "c1", "c2", "lo", "hi", "core", "raw")
    single = staged(many.mapInArrow(frugal(each), base), "single")
    again = staged(single.groupBy("k1", "k2").agg(F.count("*").alias("m")).where("m > 1"), "again")
    found = single.join(again, ["k1", "k2"]).select("key", "c1", "c2", "lo", "hi")
    return joined.where("same").select("key", "c1", "c2", "lo", "hi").union(found).union(_by_transform(few, length))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans array<struct<start, end>>): spans are the maximal removed runs."""
    spark = docs.sparkSession
    small_batches(spark)
    seg = staged(segments(docs, length), "segments")
    keys = staged(seg.groupBy("key").agg(F.count("*").alias("m"), _uniform().alias("uniform")).where("m > 1").select("key", "uniform"), "keys")
    shared = seg.join(keys, "key")
    covered = shared.where("uniform").select("doc", "tie", "at", (F.col("at") + F.col("n") - 1 + length).alias("to"))
    mixed = staged(shared.where(~F.col("uniform")).drop("uniform"), "mixed")
    contents = staged(
        mixed.groupBy("key", "c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "tie", "at", "n", "anchor")).alias("rep")), "contents"
    )
    hits = _by_cuts(staged(_fetch(contents, docs, length), "raw"), length)
    whole = contents.where("copies > 1").select("key", "c1", "c2", F.lit(0).alias("lo"), (F.col("rep.n") - 1).alias("hi"))
    hits = staged(whole.union(hits).groupBy("key", "c1", "c2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "hits")
    found = mixed.join(hits, ["key", "c1", "c2"]).select("doc", "tie", "at", F.explode("runs").alias("r"))
    covered = covered.union(found.select("doc", "tie", F.col("at") + F.col("r.lo"), F.col("at") + F.col("r.hi") + length))
    spans = covered.groupBy(*DOC).agg(F.collect_set(F.struct(F.col("at").alias("start"), F.col("to").alias("end"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes_, kept, merged = [], [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                raw_, runs = text.as_py().encode(), []
                for s in sorted(own.as_py() or (), key=lambda x: x["start"]):
                    if runs and s["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                    else:
                        runs.append(dict(s))
                at, rest = 0, []
                for r in runs:
                    rest.append(raw_[at : r["start"]])
                    at = r["end"]
                sizes_.append(len(raw_))
                kept.append(b"".join([*rest, raw_[at:]]))
                merged.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes_, pa.int64()), pa.array(kept, pa.binary()), pa.array(merged, span)], ["doc_id", "n_bytes", "kept", "spans"])

    return (
        keyed(docs)
        .join(spans, DOC, "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(frugal(cut), "doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")
    )
