import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from haulmark.llm import chunked_tokens
from haulmark.llm._common import new_folder
from haulmark.llm.chunked_tokens import ChunkEncoder
from haulmark.llm.packing import pack, pack_documents
from haulmark.llm.token_files import read_document, read_token_files, write_token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ROWS = [
    (1, "The cat's hat  sat.\n\nOn 123 mats, ISN'T it?", "x"),
    (2, None, None),
    (3, "", "y"),
    (None, "no id", "z"),
    (4, "same text", "a"),
    (4, "same text", "a"),
    (5, "Σίσυφος ΌΣΟΣ é é 日本語    x\x1cy <|endoftext|> <|startoftext|>", "b"),
    (6, " ".join(f"w{i % 977}" for i in range(30_000)), "c"),
    (7, "x" * 5_000, "d"),
]
SCHEMA = "doc_id long, text string, start string"


def whole(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "boundary"), [(WORD, "dropped"), (BYTE, "leading")])
def test_chunks_encode_as_whole_texts(path, boundary):
    enc, lib = ChunkEncoder(path, boundary), whole(path)

    @settings(max_examples=1500, deadline=None)
    @given(st.text(st.one_of(st.sampled_from(" \n\t\r'.,AaΣσ́ \u0085 \x1c​9é日<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
    def same(text):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == lib(text)

    same()
    for text in ("a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y z<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext |>", "a  <|endoftext|>\n b"):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == lib(text)
    texts = [text or "" for _, text, _ in ROWS]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_column(pa.array(texts))] == list(map(lib, texts))
    prose = [r.text for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pandas().itertuples()]
    got = list(chunked_tokens.encoded(enc, pa.array(prose), 100_000))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == list(map(lib, prose))


@pytest.mark.parametrize(("path", "boundary"), [(WORD, "dropped"), (BYTE, "leading")])
def test_bounded_memo_changes_nothing(path, boundary, monkeypatch):
    monkeypatch.setattr(chunked_tokens, "MEMO", 40)
    enc, lib = ChunkEncoder(path, boundary), whole(path)
    texts = [" ".join(f"w{j * i}." for j in range(60)) for i in range(20)] * 2
    assert [np.frombuffer(x, "<u4").tolist() for i in range(0, 40, 3) for x in enc.encode_column(pa.array(texts[i : i + 3]))] == list(map(lib, texts))


def test_token_files_round_trip(spark):
    docs, path = spark.createDataFrame(ROWS, SCHEMA), new_folder(spark, "test")
    write_token_files(docs, path, WORD, "dropped", 2)
    got = sorted(map(tuple, read_token_files(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    lib, want, start = whole(WORD), [], 0
    for doc_id, text, _ in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*lib(text), 2]
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert read_document(spark, path, 1) == [[*lib(ROWS[0][1]), 2]]
    assert len(read_document(spark, path, 4)) == 2 and read_document(spark, path, 99) == []


def test_token_files_of_an_empty_table(spark):
    path = new_folder(spark, "test")
    write_token_files(spark.createDataFrame([], SCHEMA), path, WORD, "dropped", 2)
    assert read_token_files(spark, path).collect() == []


def test_first_fit_decreasing_by_tree():
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 700):
        lengths = [rng.randint(1, 1023) for _ in range(n)]
        seqs = pack(lengths, 1024)
        covered = {}
        for seq in seqs:
            total = sum(p[2] for p in seq)
            assert total == 1024 or total & (total - 1) == 0
            for item, start, length in seq:
                covered.setdefault(item, []).append((start, length))
        for item, length in enumerate(lengths):
            at = 0
            for start, size in sorted(covered[item]):
                assert start == at
                at += size
            assert at == length


def test_packing_covers_each_id_once(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = pack_documents(docs, BYTE, "leading", 0, group_docs=3).collect()
    lib = whole(BYTE)
    seqs, pieces = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    for doc_id, text, _ in ROWS:
        ids = [*lib(text), 0]
        want = [x for x in sorted(pieces[doc_id])]
        copies = sum(r[0] == doc_id for r in ROWS)
        assert sum(x[1] for x in want) == copies * len(ids)
        for start, length, crc, n in want:
            assert n == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
    assert pack_documents(spark.createDataFrame([], SCHEMA), BYTE, "leading", 0).collect() == []


def test_copies_of_a_row_are_split(spark, monkeypatch):
    """A row repeated many times doesn't meet in one group or part."""
    rows = [(7, "the same words over and over", "x")] * 4_000 + [(i, f"text {i}", "x") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    pieces = pack_documents(docs, BYTE, "leading", 0, group_docs=200).where("doc_id = 7")
    share = pieces.groupBy("group_id").count().collect()
    assert len(share) >= 15 and max(r["count"] for r in share) < 600
    path = new_folder(spark, "test")
    write_token_files(docs, path, WORD, "dropped", 2)
    got = sorted(map(tuple, read_token_files(spark, path).select("start", "doc_id", "n_tokens").collect()))
    assert len(got) == len(rows) and [g[1] for g in got] == sorted(r[0] for r in rows)
    assert all(a + n == b for (a, _, n), (b, *_) in zip(got, got[1:], strict=False))


def test_a_worker_keeps_what_one_kind_of_stage_needs():
    from haulmark.llm import _common, langid

    own = chunked_tokens.encoder(BYTE, "leading")
    assert chunked_tokens.encoder(BYTE, "leading") is own
    langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert not any(x is own for x in _common._kept.values()) and len(_common._kept) == 1


def test_encoding_is_not_interrupted_by_searches_for_cycles():
    import gc

    runs = []
    note = lambda phase, info: runs.append(info["generation"])
    enc = ChunkEncoder(BYTE, "leading")
    texts = pa.array([" ".join(f"w{i}x{j}-a" for i in range(400)) for j in range(50)])
    gc.callbacks.append(note)
    try:
        own = enc.encode_column(texts)
    finally:
        gc.callbacks.remove(note)
    assert not runs and gc.isenabled()
    whole = Tokenizer.from_file(BYTE).encode(texts[3].as_py(), add_special_tokens=False).ids
    assert np.frombuffer(own[3], "<u4").tolist() == whole
