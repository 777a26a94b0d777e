"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a piece there is exactly one token that can end its encoding: the one that the merge rules let
stand after the last token of the shorter prefix. The table of these last tokens is the encoder's whole state. Appending
bytes only adds entries; an edit keeps the entries before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, texts

_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Memoised pieces (in each of two generations) and token pairs of a worker.
MEMO, PAIRS = 1_000_000, 500_000
#: Longest piece (characters) that is memoised.
MEMO_CHARS = 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache
def piece_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """The pattern of the public rank files for the standard library's re, for texts of code points up to top.

    Letters, numbers and white space are classes from unicodedata. A class without ranges beyond 0xFFFF is one table
    look-up for each character; with them the ranges are tried in turn.
    """
    kinds: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(top + 1):
        runs = kinds.get(unicodedata.category(chr(c))[0])
        if runs is not None:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    letter, number = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in kinds[k]) for k in "LN")
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?(?:[{letter}]+|[{number}]+|[^{space}{letter}{number}]+)|[{space}]+(?![^{space}])|[{space}]+")


def pattern_for(text: str) -> re.Pattern:
    """The narrowest piece pattern that holds for a text."""
    if text.isascii():
        return piece_pattern(0x7F)
    wide = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
    return piece_pattern(sys.maxunicode if wide else 0xFFFF)


class Vocabulary:
    """Ranks with, for each token, the two tokens that its last merge joined."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for k, v in ranks.items():
            self.bytes[v] = k
        self.longest = max(map(len, ranks))
        self.length = list(map(len, self.bytes))
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array(self.length, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: All tokens that end at each byte of a string, in one pass over it.
        self.ends = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, v in ranks.items():
            self.ends.add_word(k.decode("latin-1"), v)
        self.ends.make_automaton()
        self.halves = [self._halves(b, i) for i, b in enumerate(self.bytes)]
        self.stands: dict[int, bool] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """What is left of a token when merges of lower rank are done; None for a single byte."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(a + b, self.size), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= rank:
                raise ValueError(f"token {rank} can't be reached by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def can_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both ends with just these two tokens.

        Merges are taken back in falling rank on the side where the later one was made; at each step the tokens that
        touch must not have been joined by a merge that comes before the one taken back.
        """
        found = self.stands.get(key := left * self.size + right)
        if found is None:
            if len(self.stands) >= PAIRS:
                self.stands.clear()
            found = self.stands[key] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        ranks, text, halves = self.ranks, self.bytes, self.halves
        bound = self.size  # merges of a lower rank than this have been possible while both tokens stood
        while True:
            if ranks.get(text[left] + text[right], self.size) < bound:
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]


class PrefixEncoder:
    """The last token of every byte prefix of one piece; last[0] stands for the empty prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data = vocabulary, b""
        self.last: list[int | None] = [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; earlier entries hold as they are."""
        start = len(self.data)
        self.data += more
        last, length, size, known, can_follow = self.last, self.v.length, self.v.size, self.v.stands.get, self.v.can_follow
        last.extend([None] * len(more))
        back = max(0, start - self.v.longest)  # no token over the new bytes begins before
        for end, token in self.v.ends.iter(self.data[back:].decode("latin-1")):
            end += back + 1
            if last[end] is None:
                begin = end - length[token]
                if begin:
                    stands = known(last[begin] * size + token)
                    if not (can_follow(last[begin], token) if stands is None else stands):
                        continue
                last[end] = token

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Replaces data[start:end]; only the entries beyond start are made anew."""
        tail = new + self.data[end:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.append(tail)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of so many bytes."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.v.bytes[self.last[at]])
        return out[::-1]


class EditableText:
    """A text's pieces with their ids; an edit encodes anew only from the piece before it to where pieces agree again."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.v, self.text, self.starts, self.encoded = vocabulary, "", [], []
        self.replace(0, 0, text)

    def replace(self, start: int, end: int, new: str) -> int:
        """Replaces text[start:end]; the number of pieces encoded."""
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        first = 0
        for first in range(len(self.starts) - 1, -1, -1):
            if self.starts[first] < start:
                break
        first = max(0, first - 2)  # white space before a piece is split by what follows it
        at = self.starts[first] if self.starts else 0
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        starts, encoded = self.starts[:first], self.encoded[:first]
        rest = len(self.starts)
        made = 0
        for m in pattern_for(text).finditer(text, at):
            if m.start() >= start + len(new) and m.start() in old:
                rest = old[m.start()]
                break
            starts.append(m.start())
            encoded.append(PrefixEncoder(self.v, m.group().encode()).ids())
            made += 1
        self.starts = starts + [s + shift for s in self.starts[rest:]]
        self.encoded = encoded + self.encoded[rest:]
        self.text = text
        return made

    def ids(self) -> list[int]:
        return [i for x in self.encoded for i in x]


class _Pieces(dict):
    """Packed ids by piece, made when first asked for; when full, pieces that are not asked for again go."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode()
            whole = self.v.ranks.get(data)
            ids = [whole] if whole is not None else PrefixEncoder(self.v, data).ids()
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


def encode_packed(text: str, pieces: _Pieces) -> bytes:
    """ids of a text as little-endian unsigned 32-bit integers."""
    return b"".join(map(pieces.__getitem__, pattern_for(text).findall(text)))


def decoded(vocabulary: Vocabulary, packed: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of packed ids, so many ids at a time: each token's bytes are copied from the vocabulary's, laid end to end."""
    ids = np.frombuffer(packed, "<u4")
    for at in range(0, len(ids), step):
        block = ids[at : at + step]
        size = vocabulary.sizes[block]
        to = np.cumsum(size)
        yield vocabulary.blob[np.arange(to[-1]) + np.repeat(vocabulary.starts[block] - (to - size), size)].tobytes()


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> bytes:
    return b"".join(decoded(vocabulary, np.array(list(ids), "<u4").tobytes()))


#: What a Python worker keeps from task to task, by rank file.
_made: dict[str, tuple[Vocabulary, _Pieces]] = {}


def _encoder(shared, name: str) -> Callable:
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:
            _made.clear()
            _made[name] = (v := Vocabulary(shared.value), _Pieces(v))
        v, pieces = _made[name]

        def rows() -> Iterator[tuple]:
            for part in parts:
                for doc_id, text in zip(part[0].to_pylist(), part[1], strict=True):
                    ids = encode_packed(text.as_py() or "", pieces)
                    back = hashlib.sha256()
                    for x in decoded(v, ids):
                        back.update(x)
                    yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()

        return batches(rows(), _OUT)

    return run


def encode_documents(docs: DataFrame, ranks_path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; nothing is shuffled.

    A null text is the empty text, with no tokens. The rank file is read on the driver and broadcast; its size doesn't
    depend on the data. Long texts are encoded piece by piece, in time linear in their bytes.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    return texts(docs).mapInArrow(_encoder(shared, ranks_path), _SCHEMA)
