"""Encoding of whole texts by a public tokenizer, word chunk by word chunk.

The tokenizers library encodes every distinct chunk of white-space-separated text once; a text's ids are its chunks'
ids in order. That is exact where the tokenizer's pre-tokenizer always breaks at the places used here, which is tested
against whole-text encoding. The places, for the two kinds of boundary:

* ``dropped``: white space separates words and is not encoded.
* ``leading``: one space between two visible characters starts the next word's token; other white space stays inside a
  chunk.

Texts are cut and their chunks numbered by Arrow, so Python sees only the distinct chunks of a call. Inside a chunk, a
letter next to ASCII punctuation other than an apostrophe ends or starts a token, and so does either side of one line
feed between visible ASCII characters. A piece that is a run of Latin letters is one token of the pre-tokenizer and goes
straight to the library's model. Everything else is left to the whole tokenizer, which gets the pieces that are new many
at a time, between separators that no token can span. A text that holds an added token of the tokenizer (such as an end
mark) goes to the library whole. Both memos are bounded.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from haulmark.llm._common import kept

SPACE = chr(256 + 32)
#: A memo that is full becomes the old one, which is still asked; so each holds at most twice that and one call's.
MEMO, MEMO_CHARS, CALL_CHARS, CALL_BYTES = 300_000, 48, 200_000, 4_000_000
VISIBLE = "!-~¡-ɏ"
LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
MARKS = r"!-&(-/:-@\[-`{-~"
#: White space that the library's patterns and Python's may see differently, or that isn't ASCII.
ODD = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]"
INSIDE = re.compile(rf"(?<=[{LETTER}])(?=[{MARKS}])|(?<=[{MARKS}])(?=[{LETTER}])|(?<=[!-~])(?=\n[!-~])|(?<=[!-~]\n)(?=[!-~])")
WORD = re.compile(rf" ?[{LETTER}]+")
SPLIT = {"dropped": re.compile(r"[ \t\n\r]+"), "leading": re.compile(rf"(?<=[{VISIBLE}])(?= [{VISIBLE}])")}
ENDS_VISIBLE = re.compile(rf"[{VISIBLE}](?:.*[{VISIBLE}])?", re.DOTALL)
#: (text, ids it adds before and after its own one id) between two chunks.
SEPARATOR = {"dropped": (" \x01 ", 0), "leading": ("\n\x01\n", 1)}


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(other)}


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist(), but without a scalar object for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


@contextmanager
def uncollected() -> Iterator[None]:
    """Without searches for cycles: encoding makes none, but so many lists that the memos would be gone through again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class ChunkEncoder:
    """encode_column(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, boundary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.leading = boundary == "leading"
        self.split = SPLIT[boundary].split
        self.separator, self.around = SEPARATOR[boundary]
        ids = self.tokenizer.encode(self.separator, add_special_tokens=False).ids
        self.mark = ids[self.around] if len(ids) == 1 + 2 * self.around else None
        self.letters, self.model = byte_letters(), self.tokenizer.model
        self.raw = [i.to_bytes(4, "little") for i in range(self.vocabulary)]
        self.pieces: dict[str, bytes] = {"": b""}
        self.old_pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _words(self, words: list[str]) -> list[bytes]:
        """Of runs of Latin letters: straight from the model, which wants the byte-level alphabet."""
        tokenize, letters, raw, lower, out = self.model.tokenize, self.letters, self.raw, not self.leading, []
        for word in words:
            if lower:
                word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(letters)
            elif word[0] == " ":
                word = SPACE + word[1:]
            out.append(b"".join([raw[t.id] for t in tokenize(word)]))
        return out

    def _library(self, pieces: list[str]) -> dict[str, bytes]:
        out, call, chars = {}, [], 0
        for i, piece in enumerate(pieces):
            if self.mark is None or "\x01" in piece or piece[:2].isspace():
                out[piece] = self._ids(piece).tobytes()
            else:
                call.append(piece)
                chars += len(piece)
            if call and (chars >= CALL_CHARS or i == len(pieces) - 1):
                ids = self._ids(self.separator.join(["", *call, ""]))
                at = np.nonzero(ids == self.mark)[0]
                if len(at) != len(call) + 1:
                    raise ValueError("a separator was not encoded on its own")
                raw, a = ids.tobytes(), self.around
                for piece_, lo, hi in zip(call, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    out[piece_] = raw[4 * (lo + 1 + a) : 4 * (hi - a)]
                call, chars = [], 0
        return out

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, as they stand in a text."""
        if len(self.pieces) > MEMO:
            self.old_pieces, self.pieces = self.pieces, {"": b""}
        known, old, word = self.pieces, self.old_pieces, WORD.fullmatch
        cut = [INSIDE.split(c) for c in chunks]
        need = {p for own in cut for p in own if p not in known}
        new = {p: old[p] for p in need if p in old}
        lead, parts = self.leading, self.parts
        for p in need:  # a word may be known as a whole part
            if lead == (p[:1] == " ") and (x := parts.get(p[1:] if lead else p)) is not None:
                new[p] = x
        need = need.difference(new)
        words = [p for p in need if word(p)]
        new.update(zip(words, self._words(words), strict=True))
        new |= self._library(list(need.difference(words)))
        known.update(new)
        found = [known[own[0]] if len(own) == 1 else b"".join([known[p] for p in own]) for own in cut]
        for p in [p for p in new if len(p) > MEMO_CHARS]:
            del known[p]
        return found

    def _new_parts(self, parts: list[str]) -> list[bytes | None]:
        """The ids of parts that follow a boundary; None for one that a boundary can't stand beside."""
        lead, word = self.leading, WORD.fullmatch
        out: list[bytes | None] = [None] * len(parts)
        plain = [i for i, p in enumerate(parts) if word(p)]
        for i, ids in zip(plain, self._words([" " + parts[i] for i in plain] if lead else [parts[i] for i in plain]), strict=True):
            out[i] = ids
        others = [i for i, p in enumerate(parts) if out[i] is None and (not lead or ENDS_VISIBLE.fullmatch(p))]
        for i, ids in zip(others, self._learn([" " + parts[i] for i in others] if lead else [parts[i] for i in others]), strict=True):
            out[i] = ids
        return out

    def _of_parts(self, parts: list[str]) -> list[bytes | None]:
        if len(self.parts) > MEMO:
            self.old_parts, self.parts = self.parts, {}
        memo, old = self.parts, self.old_parts
        out = list(map(memo.get, parts))
        new = [i for i, x in enumerate(out) if x is None]
        for i in new:
            out[i] = old.get(parts[i])
        fresh = [i for i in new if out[i] is None]
        for i, ids in zip(fresh, self._new_parts([parts[i] for i in fresh]), strict=True):
            out[i] = ids
        memo.update((parts[i], out[i]) for i in new if out[i] is not None and len(parts[i]) <= MEMO_CHARS)
        return out

    def _plain(self, texts: pa.Array) -> list[bytes | None]:
        """The ids of texts without odd characters, each distinct part encoded once; None where a boundary can't stand beside some
        part."""
        parts = pc.split_pattern(texts, " ") if self.leading else pc.ascii_split_whitespace(texts)
        starts = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        own, codes = self._of_parts(_strings(coded.dictionary)), coded.indices.to_numpy()
        many = np.diff(starts)
        bad = np.array([x is None for x in own])[codes]
        if self.leading:  # the first part follows no boundary; alone it is the whole text
            codes = codes.copy()
            heads = coded.dictionary.take(pa.array(codes[starts[:-1]])).to_pylist()
            bad[starts[:-1]] = [n > 1 and not ENDS_VISIBLE.fullmatch(h) for h, n in zip(heads, many.tolist(), strict=True)]
            codes[starts[:-1]] = len(own) + np.arange(len(heads))
            own += self._learn([h if n == 1 or not b else "" for h, n, b in zip(heads, many.tolist(), bad[starts[:-1]].tolist(), strict=True)])
        ids = pa.array([x or b"" for x in own], pa.large_binary()).take(pa.array(codes))
        data, ends = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][starts].tolist()
        whole = np.logical_or.reduceat(bad, starts[:-1]) if len(codes) else bad
        return [None if w else data[a:b].to_pybytes() for w, a, b in zip(whole.tolist(), ends, ends[1:], strict=False)]

    @uncollected()
    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids."""
        added = np.zeros(len(texts), bool)
        for token in self.added:
            added |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        odd = added | pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        plain = iter(self._plain(texts.filter(pa.array(~odd))) if not odd.all() else ())
        out = []
        for i, o in enumerate(odd.tolist()):
            own = None if o else next(plain)
            if own is None:
                text = texts[i].as_py()
                own = self._ids(text).tobytes() if added[i] else b"".join(self._learn(self.split(text)))
            out.append(own)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0]


def encoded(enc: ChunkEncoder, texts: pa.Array, size: int = CALL_BYTES) -> Iterator[bytes]:
    """Each text's ids in turn, of an array without nulls, encoded some at a time."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield from enc.encode_column(texts.slice(at, to - at))
        at = to


def encoder(path: str, boundary: str) -> ChunkEncoder:
    """One per Python worker."""
    return kept(ChunkEncoder, path, boundary)
