"""Periodic runs of words, by multi-scale minimizers.

A run is a maximal stretch of words with a smallest period q, at least four periods (and six words) long. Documents stay
in their partition; nothing is shuffled. The documents of a block are laid end to end as numbers of words, each behind
a number of its own, so that no period reaches over a border, and handled as arrays:

* Periods up to 8 are found by direct scans: words equal to the word q further on, in stretches.
* Periods in (Q, 2Q], for Q = 8, 16, 32 and so on: each position has the hash of the 2Q words from it, made of the two
  halves of the scale before, and every window of Q positions selects its smallest hash. 2Q words hold a whole period,
  so inside a run equal hashes are exactly q apart, and windows one period apart select positions one period apart: two
  selected neighbours of equal hash, q apart, seed each run. A seed is extended both ways, word by word.

A stretch found with several periods has the smallest. Hashes only propose seeds; what is returned was compared.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, raw, texts

#: The longest period that is found by a direct scan; the first scale starts behind it.
DIRECT = 8
#: Bytes of text that are handled as one block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20

#: The contract's shortest run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

Run = tuple[int, int, int]
_RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_REPORT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions, and positions behind the last, of stretches of true values."""
    edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values, well mixed (fixed multipliers of a published finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _same_ahead(words: np.ndarray, at: int, q: int) -> int:
    """The first t >= at with words[t] != words[t + q]."""
    step = 64
    while True:
        differ = words[at : at + step][: len(words) - q - at] != words[at + q : at + q + step]
        if len(differ) == 0:
            return at
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at += len(differ)
        step *= 2


def _same_behind(words: np.ndarray, at: int, q: int) -> int:
    """The smallest b so that words[t] == words[t + q] for all b <= t < at."""
    step = 64
    while at > 0:
        low = max(0, at - step)
        differ = (words[low:at] != words[low + q : at + q])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return at - first
        at = low
        step *= 2
    return 0


def _seeds(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of neighbours of equal hash among the minima of windows of so many positions.

    The low bits of what is compared are the position, so of equal minima the first is selected.
    """
    n = len(hashes)
    bits = np.uint64(max(1, n.bit_length()))
    low = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    span = 1
    while span < width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    by_hash = at[np.argsort(hashes[at], kind="stable")]
    apart = np.diff(by_hash)
    pair = (hashes[by_hash[1:]] == hashes[by_hash[:-1]]) & (apart > width) & (apart <= 2 * width)
    return by_hash[:-1][pair], apart[pair]


def runs_of(words: np.ndarray, sizes: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs in documents laid end to end, longest first.

    words are numbers, with a number of its own before each document; sizes are the documents' lengths in words.
    """
    found: dict[tuple[int, int], int] = {}  # period by first position and the one behind the last

    def add(start: int, end: int, q: int) -> None:
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
            found[start, end] = min(q, found.get((start, end), q))

    for q in range(1, min(DIRECT, len(words) - 1) + 1):
        first, behind = _stretches(words[:-q] == words[q:])
        long = behind - first + q >= max(LEAST_WORDS, LEAST_PERIODS * q)
        for start, end in zip(first[long].tolist(), behind[long].tolist(), strict=True):
            add(start, end + q, q)
    hashes, span, width = _mixed(words.astype(np.uint64) + np.uint64(1)), 1, DIRECT
    ends = np.cumsum(sizes + 1)
    while True:
        enough = int((sizes >= LEAST_PERIODS * (width + 1)).sum())  # the documents that are long enough come first
        if not enough:
            break
        hashes = hashes[: ends[enough - 1]]
        while span < 2 * width:
            hashes = _mixed(hashes[:-span] * np.uint64(0x9E3779B97F4A7C15) + hashes[span:])
            span *= 2
        at, apart = _seeds(hashes, width)
        order, last = np.lexsort((at, apart)), (0, 0)
        for i, q in zip(at[order].tolist(), apart[order].tolist(), strict=True):
            if last[0] == q and i < last[1]:
                continue  # inside the stretch that the seed before gave
            end = _same_ahead(words, i, q)
            if end > i:
                add(_same_behind(words, i, q), end + q, q)
            last = (q, end)
        width *= 2
    return [(start, end - start, q) for (start, end), q in found.items()]


def runs_of_documents(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each document's words, by start, then period."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    numbers: dict[bytes, int] = {}
    number = lambda w: numbers.setdefault(w, len(numbers))
    sizes = np.array([len(documents[i]) for i in order], np.int64)
    starts = np.cumsum(sizes + 1) - sizes  # of the first words
    words = np.empty(int((sizes + 1).sum()), np.int64)
    for k, i in enumerate(order):
        words[starts[k] - 1] = -2 - k
        words[starts[k] : starts[k] + sizes[k]] = np.fromiter(map(number, documents[i]), np.int64, len(documents[i]))
    out: list[list[Run]] = [[] for _ in documents]
    for start, length, q in runs_of(words, sizes):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[order[k]].append((start - int(starts[k]), length, q))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _blocks(parts: Iterable[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """doc_id and words of documents of about BLOCK_BYTES together."""
    held, total = [], 0
    for part in parts:
        for doc_id, text in zip(part[0].to_pylist(), (x for i in range(0, len(part), 64) for x in raw(part[1][i : i + 64])), strict=True):
            words = text.split()  # of bytes: at spaces and the characters 9 to 13, no others
            held.append((doc_id, rewrite(doc_id, words) if rewrite else words))
            total += len(text)
            if total >= BLOCK_BYTES:
                yield held
                held, total = [], 0
    if held:
        yield held


def _each(rewrite: Rewrite | None, schema: pa.Schema, rows: Callable) -> Callable:
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for block in _blocks(parts, rewrite):
                for (doc_id, words), runs in zip(block, runs_of_documents([w for _, w in block]), strict=True):
                    yield from rows(doc_id, words, runs)

        return batches(out(), schema)

    return run


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, start, length, period of every run of every row of docs; start is the number of its first word, from 0.

    A null text is the empty text; texts without runs give no rows, an empty table neither. Rows that repeat a doc_id, or
    have none, are documents of their own. Other columns aren't looked at. rewrite changes a document's words first.
    """
    return texts(docs).mapInArrow(_each(rewrite, _RUNS, lambda i, _, runs: ((i, *r) for r in runs)), "doc_id long, start long, length long, period long")


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _report(doc_id: int | None, words: list[bytes], runs: list[Run]) -> Iterator[tuple]:
    best: Run | None = None
    for r in runs:  # by start, then period: of equal exponents the first stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    yield doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def collapse_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_runs, the run with the greatest exponent (ties: smallest start, then period; four
    nulls without runs), and digests of all runs and of the text without repetitions.

    Nulls, repeated ids and other columns are as in find_runs(); an empty table gives no rows.
    """
    names = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return texts(docs).mapInArrow(_each(rewrite, _REPORT, _report), names)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents with a periodic end: where crc32 of the decimal doc_id says so, words from a on repeat p words.

    A document without doc_id stays as it is.
    """
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]
