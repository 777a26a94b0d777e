"""Language-model scores by logistic context mixing over hashed contexts.

A text is its tokens (words, then one end). A word is coded as its bytes and a space, the end as a space alone, each byte
as the binary decisions of a Huffman code of bytes. Four predictors know the decisions so far of the byte and a hashed
context: the last one, two or three bytes, and the whole word so far, which has exact counts however many words there are.
Their counts of zeros and ones are those of all training tokens. The predictors' log odds are combined by weights from a
set chosen (gated) by how often the word so far has been seen; the weights learn online, block by block, each token with
its own occurrence left out of the counts, and a final map adapts the mixed probability to what it has turned out to mean.
This is the probability of a token's spelling, computed once for each different token.

Two more mixtures stand above it, their weights learnt by expectation maximization with own occurrences left out:
a token's spelling and its share of the training tokens; and, in its place, that mixture and the token's share after the
word before, with weights gated by how frequent the word before is. A last predictor knows whole segments: texts are cut
where the hash of two words says so, and a segment of SEGMENT_WORDS words or more that training documents hold elsewhere
is coded as one of all segments instead of word by word. Training documents' scores leave their own occurrences out of
tokens, pairs and segments, though not of the spelling's counts.

Counts of tokens and segments are one table, gathered from every document, that grows with the input; so is that of pairs,
which has every pair behind a word with at least 1 / 2**HEAD of all training tokens, however rare the pair is. Tokens with
1 / 2**FREQUENT of all training occurrences, and pairs with 1 / 2**PAIRS, are broadcast, so their number is bounded; all other
tokens and pairs meet what they are worth in one shuffled join. Words so far are counted where all words that begin so meet:
tokens are dealt out by the shortest beginning that fewer than about 1 / 2**HEAVY of all different tokens share, and more
common beginnings are counted in all tasks and summed. The driver holds tables of bounded size only.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batches, texts, written
from .ngrams import CHUNK, chunks, mix, span_hashes
from .quality import remainder

#: Sizes, as powers of two, of the tables for the last one, two and three bytes.
BITS = (16, 18, 20)
#: Slots that are gathered as one row, as a power of two.
BLOCK = 12
#: Beginnings of at least this share of the different tokens, a power of two, by a sample of every so many'th token.
HEAVY, HEAVY_SAMPLE, HEAVY_BYTES = 14, 16, 16
#: Independent learners whose weights are averaged; tokens whose beginnings are counted together, at least.
SHARDS, TOGETHER = 16, 40_000
#: Runs of texts whose counts are summed before they are handed on.
HELD = 8
#: Bytes of tokens that are worked on together.
STEP = 1 << 15
GATES, BINS, INPUTS = 16, 33, 5
#: What each predictor's counts of zeros and of ones start from; the curvature added to each gate's.
PRIOR, DAMPING = 0.4, 30.0
#: The weights that learners start from.
WEIGHTS = (0.1, 0.15, 0.3, 0.5, 0.0)
#: Shares, as powers of two, of tokens that are broadcast, of words that are a context for the next, and of pairs that are broadcast.
FREQUENT, HEAD, PAIRS = 21, 15, 20
#: Words of a segment on average, and at least.
SEGMENT, SEGMENT_WORDS = 32, 8
#: Texts with segments that are coded as one are marked by bits, so many tables of 32,768 at most.
MARKS = 4096
#: Keys of the end and of what stands before a text.
END, START = 0, 1
#: What places are told by, where keys are too, begins after these two.
PLACED = 2
#: In place of a context: a token by itself, the sum of a text's pairs.
NO_CONTEXT, OF_SUMS = -1, -2
#: First byte that tells segments from tokens, which hold no white space.
OF_SEGMENT = b" "

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Tokens:
    """The tokens of a run of texts: row, first and last byte (exclusive), key, the key before; ends have no bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, rows = _FOLD[data], len(offsets) - 1
        begins, ends, keys = [], [], []
        at = 0
        while at < len(data):
            to = min(at + CHUNK, len(data))
            while to < len(data) and not _SPACE[data[to]]:  # a block ends before white space
                more = np.flatnonzero(_SPACE[data[to : to + CHUNK]])
                to = to + int(more[0]) if len(more) else min(to + CHUNK, len(data))
            block = self.data[at:to]
            space = _SPACE[block]
            cut = offsets[(offsets > at) & (offsets < to)] - at
            before, after = np.concatenate(([True], space[:-1])), np.concatenate((space[1:], [True]))
            before[cut], after[cut - 1] = True, True
            begin, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
            begins.append(begin + at)
            ends.append(end + at)
            keys.append(token_keys(block, begin, end))
            at = to
        none = np.zeros(0, np.int64)
        begin, end, key = np.concatenate([none, *begins]), np.concatenate([none, *ends]), np.concatenate([none.astype(np.uint64), *keys])
        row = np.searchsorted(offsets, begin, "right") - 1
        self.count = np.bincount(row, minlength=rows)
        last = np.cumsum(self.count)
        self.begin, self.end = np.insert(begin, last, offsets[1:]), np.insert(end, last, offsets[1:])
        self.key, self.row = np.insert(key, last, np.uint64(END)), np.insert(row, last, np.arange(rows))
        self.count += 1
        self.first = np.cumsum(self.count) - self.count
        self.before = np.concatenate((np.zeros(1, np.uint64), self.key[:-1]))[: len(self.key)]
        self.before[self.first] = START

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, number of tokens and key of each segment; an end is one of its own."""
        cut = (mix(self.before * np.uint64(3) + self.key) % np.uint64(SEGMENT)) == 0
        cut[self.first] = True
        cut[self.first + self.count - 1] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(cut))
        return start, stop - start, mix(span_hashes(self.key, start, stop) + (stop - start).astype(np.uint64))


def token_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of tokens, told by their bytes and length alone; the end's is END."""
    return mix(span_hashes(data, begin, end) + (end - begin).astype(np.uint64))


def spaced(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of tokens, a space after each, and how many each has with it."""
    column = column.cast(pa.large_binary())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, size = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)
    out = np.full(len(data) + len(size), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    return out, size + 1


def keys_of(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The keys of tokens that spaced() gives."""
    end = np.cumsum(size)
    return token_keys(data, end - size, end - 1)


class Table:
    """Places of 64-bit keys, by open addressing; the keys' own high bits say where to look first."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.bits = keys, max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at, left = self._at(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that aren't there."""
        at = self._at(keys)
        out = self.slots[at].astype(np.int64)
        if not len(self.keys):
            return out
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            out[left] = self.slots[at]
            more = (out[left] >= 0) & (self.keys[out[left]] != keys[left])
            left, at = left[more], at[more]
        return out


def _different(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes, as they come, and the place of each hash among them; by a hash table, as sorting takes several times as long."""
    found = pa.array(h).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _sums(key: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, a place of each, and the sums of the weights."""
    key, at = _different(key)
    place = np.empty(len(key), np.int64)
    place[at] = np.arange(len(at))
    return (key, place, *(np.bincount(at, w, len(key)).astype(np.int64) for w in weights))


def _bytes_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes at each place, end to end."""
    to = np.cumsum(size)
    return data[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(begin - (to - size), size)]


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


_COUNTS = "token binary, train long, n long"


def _count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and segments of each batch, with their occurrences in training documents and in all."""
    names = ["token", "train", "n"]

    def out(words: list, segments: list) -> Iterator[pa.RecordBatch]:
        key, size, data, k, n = (np.concatenate([w[i] for w in words]) for i in range(5))
        begin = np.cumsum(size) - size
        _, at, k, n = _sums(key, k, n)
        yield pa.RecordBatch.from_arrays([_binary(_bytes_of(data, begin[at], size[at]), size[at]), pa.array(k), pa.array(n)], names=names)
        key, train = (np.concatenate([s[i] for s in segments]) for i in range(2))
        key, _, k, n = _sums(key, train, np.ones(len(train)))
        yield pa.RecordBatch.from_arrays([_named(OF_SEGMENT, key.astype(">u8")), pa.array(k), pa.array(n)], names=names)

    words, segments = [], []
    for part in parts:
        trains = part[1].to_numpy(zero_copy_only=False).astype(float)
        for first, data, offsets in chunks(part[0]):
            t = Tokens(data, offsets)
            train = trains[first + t.row]
            key, at, k, n = _sums(t.key, train, np.ones(len(train)))
            size = (t.end - t.begin)[at]
            words.append((key, size, _bytes_of(t.data, t.begin[at], size), k, n))
            start, length, key = t.segments()
            long = length >= SEGMENT_WORDS
            segments.append((key[long], train[start[long]]))
            if len(words) >= HELD:
                yield from out(words, segments)
                words, segments = [], []
    if words:
        yield from out(words, segments)


def _named(kind: bytes, key: np.ndarray) -> pa.Array:
    wide = key.dtype.itemsize
    data = np.empty((len(key), wide + 1), np.uint8)
    data[:, 0] = kind[0]
    data[:, 1:] = np.frombuffer(key.tobytes(), np.uint8).reshape(-1, wide)
    return _binary(data.ravel(), np.full(len(key), wide + 1))


def byte_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman code of the 256 byte values: first place in, and length of, each byte's path; the path's nodes and bits.

    Frequent bytes take few decisions. All bytes have a code, whatever the counts.
    """
    heap = [(float(c) + 1e-3, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    for k in range(256, 511):
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (k, 0), (k, 1)
        heapq.heappush(heap, (a + b, k, k))
    paths = []
    for i in range(256):
        path, at = [], i
        while at in parent:
            at, bit = parent[at]
            path.append((at - 256, bit))
        paths.append(path[::-1])
    size = np.array([len(x) for x in paths])
    return np.cumsum(size) - size, size, np.array([y for x in paths for y in x], np.int64)


class Coder:
    """The slots and bits of a block of tokens; the tables of BITS lie end to end."""

    def __init__(self, code: tuple[np.ndarray, np.ndarray, np.ndarray], heavy: np.ndarray | None = None) -> None:
        self.first = np.concatenate(([0], np.cumsum([1 << b for b in BITS])))
        self.start, self.size, path = code
        self.node, self.bit = path[:, 0].astype(np.int32), path[:, 1].astype(np.int32)
        self.salt = path[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.heavy = np.zeros(0, np.uint64) if heavy is None else heavy

    @staticmethod
    def _laid(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each byte's token and place in it, and the hash of the token so far."""
        begin = np.repeat(np.cumsum(size) - size, size)
        at = np.arange(len(data))
        since = at - begin
        return np.repeat(np.arange(len(size)), size), since, span_hashes(data, begin, at) + since.astype(np.uint64)

    def homes(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where each token is dealt: told by its shortest beginning that isn't heavy, or by all of it."""
        place, _, so_far = self._laid(data, size)
        at = np.flatnonzero(~_in(self.heavy, so_far))
        token, first = np.unique(place[at], return_index=True)
        out = mix(keys_of(data, size) + np.uint64(1))
        out[token] = mix(so_far[at[first]])
        return out.view(np.int64)

    def slots(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each decision of each token: its slots in the tables of BITS (one row each), its hash after the word so far, whether
        that is heavy, its step of the code's paths, and the token's place."""
        place, since, so_far = self._laid(data, size)
        wide = data.astype(np.uint64)
        before = lambda n: np.where(since >= n, np.concatenate((np.zeros(n, np.uint64), wide[:-n]))[: len(wide)], np.uint64(32))
        one = before(1)
        two = one | before(2) << np.uint64(8)
        three = two | before(3) << np.uint64(16)
        n = self.size[data]
        last = np.cumsum(n)
        step = np.arange(last[-1] if len(last) else 0) + np.repeat(self.start[data] - last + n, n)
        out = np.empty((len(BITS), len(step)), np.int32)
        out[0] = np.repeat(one.astype(np.int32) << 8, n) | self.node[step]
        salt = self.salt[step]
        for i, x in enumerate((two, three, so_far), 1):
            h = (np.repeat(mix(x + np.uint64(i << 60)), n) ^ salt) * np.uint64(0xD6E8FEB86659FD93)
            if i < len(BITS):
                out[i] = (h >> np.uint64(64 - BITS[i])).astype(np.int32) + np.int32(self.first[i])
        return out, h, np.repeat(_in(self.heavy, so_far), n), step, np.repeat(place, n)


def _in(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)


def _blocks(data: np.ndarray, size: np.ndarray, n: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens as spaced() gives them and their training counts, about step bytes at a time."""
    last, at = np.cumsum(size), 0
    while at < len(size):
        first = last[at] - size[at]
        to = min(len(size), int(np.searchsorted(last, first + step)) + 1)
        yield data[first : last[to - 1]], size[at:to], n[at:to]
        at = to


def _words(part: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return _blocks(*spaced(part.column(0)), part.column(1).to_numpy())


def _byte_counts(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256)
    for part in parts:
        for data, size, n in _words(part):
            total += np.bincount(data, np.repeat(n, size), 256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])


def _beginnings(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        n = Counter(w[:k] for w in part[0].to_pylist() for k in range(min(len(w), HEAVY_BYTES) + 1))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*n], pa.binary()), pa.array([*n.values()], pa.int64())], names=["beginning", "n"])


_BLOB = pa.schema([("slot", pa.int64()), ("counts", pa.binary())])


def _packed(first: int, counts: np.ndarray) -> tuple[int, bytes]:
    """A block of slots as the places that aren't zero and their counts, in four bytes each where they fit."""
    at = np.flatnonzero(counts.any(1)).astype(np.uint16)
    kind = np.uint32 if counts.max() < 1 << 32 else np.float64
    return first, len(at).to_bytes(4, "little") + at.tobytes() + counts[at].astype(kind).tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    kind = np.uint32 if len(blob) == 4 + 10 * n else np.float64
    return np.frombuffer(blob, np.uint16, n, 4).astype(np.int64), np.frombuffer(blob, kind, 2 * n, 4 + 2 * n).reshape(-1, 2).astype(float)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes and the sums of their counts of zeros and ones."""
    key, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    counts = np.concatenate([h[1] for h in held])
    return key, np.stack([np.bincount(at, counts[:, b], len(key)) for b in (0, 1)], 1)


def _decisions(h: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's decisions and their counts."""
    key, at = _different(h)
    n = np.bincount(2 * at + bit, weight, 2 * len(key))
    return key, n.reshape(-1, 2)


#: Slots below 0 hold decisions after heavy beginnings, dealt out by their hash.
_PARTS = 64


def _gather(code: tuple, heavy: np.ndarray) -> Callable:
    """A task's counts of the tables of BITS, as blocks, and of decisions after heavy beginnings."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(code, heavy)
        counts, held = np.zeros(2 * coder.first[-1]), []
        for part in parts:
            for data, size, n in _words(part):
                slots, h, here, step, place = coder.slots(data, size)
                bit, weight = coder.bit[step], n[place].astype(float)
                for x in slots:
                    np.add.at(counts, 2 * x + bit, weight)
                held.append(_decisions(h[here], bit[here], weight[here]))
                if len(held) > 12:
                    held = [_summed(held)]
        if held:
            counts, step = counts.reshape(-1, 2), 1 << BLOCK
            rows = [_packed(s, counts[s : s + step]) for s in range(0, len(counts), step) if counts[s : s + step].any()]
            key, n = _summed(held)
            part = (key % np.uint64(_PARTS)).astype(np.int64)
            rows += [(-1 - k, key[part == k].tobytes() + n[part == k].tobytes()) for k in range(_PARTS) if (part == k).any()]
            yield from batches(iter(rows), _BLOB)

    return run


def _heavy_unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 24
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.float64, 2 * n, 8 * n).reshape(-1, 2)


def _merge(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    heavy: dict[int, list] = {}
    for part in parts:
        for s, blob in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
            if s < 0:
                heavy.setdefault(s, []).append(_heavy_unpacked(blob))
                continue
            at, counts = _unpacked(blob)
            held.setdefault(s, np.zeros((1 << BLOCK, 2)))[at] += counts
    rows = [_packed(s, c) for s, c in held.items()]
    for s, found in heavy.items():
        key, n = _summed(found)
        rows.append((s, key.tobytes() + n.tobytes()))
    return batches(iter(rows), _BLOB)


def log_odds(counts: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each slot, the log odds that its decisions of 0 and of 1 meet, end to end, and the level of what it has seen.

    own: how many of the token's own occurrences are left out of the counts.
    """
    zero, one, prior = counts[:, 0], counts[:, 1], np.float32(PRIOR)
    odds = np.empty((len(counts), 2), np.float32)
    for bit in (0, 1):
        odds[:, bit] = np.log((np.maximum(one - own * bit, 0) + prior) / (np.maximum(zero - own * (1 - bit), 0) + prior))
    level = np.frexp(np.maximum(zero + one - own, 0) + 1)[1] - 1  # the whole part of log2
    return odds.ravel(), np.minimum(GATES - 1, level).astype(np.uint8)


#: Slots (a row for each predictor), steps of the code's paths, number of decisions of each token, training counts.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Mixer:
    """Predictors' log odds, gated weights and the final map; probabilities of ones."""

    def __init__(self, model: tuple, own: int) -> None:
        code, counts, heavy, self.shared, self.taught, self.mapped = model
        self.own, self.coder = own, Coder(code, heavy)
        self.fixed, _ = log_odds(counts, own)
        self.start()

    def start(self) -> None:
        """The weights and the final map as the model has them."""
        self.weights = self.taught.copy()
        self.curve = np.zeros((GATES, INPUTS, INPUTS))
        self.final = np.zeros((256, BINS, 2)) if self.mapped is None else self.mapped.copy()

    def blocks(self, words: pa.Table) -> Iterator[Block]:
        """The decisions of tokens (the first column, training counts in the second), each worked out once, STEP bytes at a time.

        Decisions after beginnings that aren't heavy are counted here: all tokens that begin so must be there. Their slots come
        after those of the decisions after heavy ones; the last slot is for what hasn't been seen.
        """
        made, hashes, heavy = [], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for data, size, n in _words(words):
            slots, h, is_heavy, step, place = self.coder.slots(data, size)
            made.append((slots, step.astype(np.uint16), np.bincount(place, minlength=len(size)), n))
            hashes.append(h)
            heavy.append(is_heavy)
        key, at = _different(np.concatenate(hashes))
        shared, of_shared = self.shared
        common = np.zeros(len(key), bool)
        common[at[np.concatenate(heavy)]] = True
        del hashes, heavy
        counts, first = np.zeros(2 * len(key)), 0
        for _, step, of, n in made:
            np.add.at(counts, 2 * at[first : first + len(step)] + self.coder.bit[step], np.repeat(n, of).astype(float))
            first += len(step)
        counts = np.concatenate((of_shared, counts.reshape(-1, 2)[~common], np.zeros((1, 2))), dtype=np.float32, casting="same_kind")
        slot = np.full(len(key), len(counts) - 1, np.int32)
        slot[~common] = np.arange(len(shared), len(counts) - 1)
        common = np.flatnonzero(common)
        common = common[_in(shared, key[common])]
        slot[common] = np.searchsorted(shared, key[common])
        self.odds, self.level = log_odds(counts, self.own)
        first = 0
        while made:
            slots, step, of, n = made.pop(0)
            yield np.concatenate((slots, slot[at[first : first + len(step)]][None])), step, of, n
            first += len(step)

    def inputs(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of each predictor (a row each), node, bit and token's place, by gate, and where gates begin."""
        slots, step, of, _ = block
        gate = self.level[slots[-1]]
        order = np.argsort(gate, kind="stable")
        step = step[order]
        bit = self.coder.bit[step]
        x = np.empty((INPUTS, len(step)), np.float32)
        for i, s in enumerate(slots):
            x[i] = (self.fixed if i < len(BITS) else self.odds)[2 * s[order] + bit]
        x[-1] = 0.3
        return x, self.coder.node[step], bit, np.repeat(np.arange(len(of)), of)[order], np.concatenate(([0], np.cumsum(np.bincount(gate, minlength=GATES))))

    def mixed(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        return np.clip(np.concatenate([w @ x[:, a:b] for w, a, b in zip(weights, cuts, cuts[1:], strict=False)]), -15, 15)

    def learn(self, block: Block) -> None:
        """One block online: a Newton step of each gate's weights, decisions counted by how often they occur."""
        x, node, bit, place, cuts = self.inputs(block)
        t = self.mixed(x, cuts)
        w = block[-1][place].astype(np.float32)
        p = 1 / (1 + np.exp(-t))
        slope, curve = (bit - p) * w, np.maximum(p * (1 - p), 1e-4) * w
        steps = np.zeros((GATES, INPUTS))
        for g in np.flatnonzero(np.diff(cuts)):
            here = slice(cuts[g], cuts[g + 1])
            mine = x[:, here].astype(float)
            steps[g] = mine @ slope[here]
            self.curve[g] += (mine * curve[here]) @ mine.T
        self.weights += np.linalg.solve(self.curve + DAMPING * np.eye(INPUTS), steps[:, :, None])[:, :, 0]
        low, share = self.bins(t)
        key = (node * BINS + low) * 2 + bit
        size = self.final.size
        self.final += (np.bincount(key, w * (1 - share), size) + np.bincount(key + 2, w * share, size)[:size]).reshape(self.final.shape)

    @staticmethod
    def bins(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.clip(t, -8, 7.99) + 8) * ((BINS - 1) / 16)
        low = at.astype(np.int32)
        return low, at - low.astype(at.dtype)

    def log10(self, block: Block) -> np.ndarray:
        """log10 of each token's probability."""
        x, node, bit, place, cuts = self.inputs(block)
        t = self.mixed(x, cuts)
        low, share = self.bins(t)
        centre = 1 / (1 + np.exp(8 - np.arange(BINS) * (16 / (BINS - 1))))
        refined = ((self.final[:, :, 1] + 20 * centre) / (self.final.sum(2) + 20)).ravel()
        at = node * BINS + low
        p = 0.5 / (1 + np.exp(-t)) + 0.5 * (refined[at] * (1 - share) + refined[at + 1] * share)
        p = np.clip(np.where(bit == 1, p, 1 - p), 1e-7, 1)
        return np.bincount(place, np.log(p), len(block[2])) / math.log(10)


def _dealt(code: tuple, heavy: np.ndarray) -> Callable:
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(code, heavy)
        for part in parts:
            home = np.concatenate([np.zeros(0, np.int64), *(coder.homes(data, size) for data, size, _ in _words(part))])
            shard = (mix(home.view(np.uint64)) % np.uint64(SHARDS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.array(shard)], names=["token", "train", "n", "home", "shard"])

    return run


def _homes(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of whole homes of one shard, of TOGETHER tokens at least where there are so many; rows come sorted by shard and home."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows < TOGETHER:
            continue
        t = pa.Table.from_batches(held)
        home, shard = t.column(3).to_numpy(), t.column(4).to_numpy()
        cuts = np.flatnonzero((home[1:] != home[:-1]) | (shard[1:] != shard[:-1])) + 1
        at = 0
        for to in cuts:
            if to - at >= TOGETHER or shard[to] != shard[at]:
                yield int(shard[at]), t.slice(at, to - at)
                at = int(to)
        held, rows = t.slice(at).to_batches(), t.num_rows - at
    if rows:
        t = pa.Table.from_batches(held)
        shard = t.column(4).to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            yield int(shard[at]), t.slice(at, to - at)


def _learn(shared) -> Callable:
    """A shard's weights and final map, and how many tokens taught them."""
    names = ["shard", "n", "weights", "final"]

    def row(shard: int, n: float, weights: np.ndarray, final: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n]), pa.array([weights.tobytes()], pa.binary()), pa.array([final.tobytes()], pa.binary())], names=names)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mixer, total = None, None, 0.0
        for shard, t in _homes(parts):
            if mixer is None:
                mixer = Mixer(shared.value, 1)
            elif shard != now:
                yield row(now, total, mixer.weights, mixer.final)
                mixer.start()
                total = 0.0
            now = shard
            for block in mixer.blocks(t):
                mixer.learn(block)
            total += t.num_rows
        if mixer is not None:
            yield row(now, total, mixer.weights, mixer.final)

    return run


def _spelled(shared) -> Callable:
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = None
        for _, t in _homes(parts):
            mixer = mixer or Mixer(shared.value, 0)
            p = np.concatenate([mixer.log10(block) for block in mixer.blocks(t)])
            key = np.concatenate([keys_of(data, size) for data, size, _ in _words(t)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(t.column(1).to_numpy()), pa.array(p)], names=["k", "c", "log_p"])

    return run


def _array(df: DataFrame, column: str) -> np.ndarray:
    return df.select(column).toArrow().column(0).to_numpy()


def fit(words: DataFrame, different: int) -> tuple:
    """The mixing model of a table of different tokens and counts. The driver sees tables of bounded size."""
    spark = words.sparkSession
    known = words.filter("train > 0")
    share = np.zeros(256)
    for r in known.mapInArrow(_byte_counts, "byte long, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        share[r["byte"]] = r["n"]
    code = byte_code(share)
    sample = known.filter(F.pmod(F.xxhash64("token"), F.lit(HEAVY_SAMPLE)) == 0).select("token")
    begin = sample.mapInArrow(_beginnings, "beginning binary, n long").groupBy("beginning").agg(F.sum("n").alias("n"))
    least = different / HEAVY_SAMPLE / (1 << HEAVY)
    common = sorted({b"", *(bytes(r["beginning"]) for r in begin.filter(F.col("n") >= least).select("beginning").collect())})
    size = np.array([len(x) for x in common])
    stop = np.cumsum(size)
    heavy = np.sort(span_hashes(np.frombuffer(b"".join(common), np.uint8), stop - size, stop) + size.astype(np.uint64))
    merged = written(known.mapInArrow(_gather(code, heavy), "slot long, counts binary").repartition("slot").mapInArrow(_merge, "slot long, counts binary"), "mixing-tables")
    table, found = np.zeros((int(Coder(code).first[-1]), 2)), [(np.zeros(0, np.uint64), np.zeros((0, 2)))]
    for row in merged.toLocalIterator():
        if row["slot"] < 0:
            found.append(_heavy_unpacked(bytes(row["counts"])))
        else:
            at, n = _unpacked(bytes(row["counts"]))
            table[row["slot"] + at] = n
    of_heavy = _summed(found)
    table, of_heavy = table.astype(np.float32), (of_heavy[0], of_heavy[1].astype(np.float32))
    model = (code, table, heavy, of_heavy, np.tile(WEIGHTS, (GATES, 1)), None)
    shared = spark.sparkContext.broadcast(model)
    shards = known.mapInArrow(_dealt(code, heavy), _DEALT).repartition(SHARDS, "shard").sortWithinPartitions("shard", "home", "token")
    # sorted here: Spark would run the learners twice, once to find ranges of shards
    made = sorted(written(shards.mapInArrow(_learn(shared), "shard int, n double, weights binary, final binary"), "mixing-learners").collect(), key=lambda r: r["shard"])
    shared.destroy()
    if made:
        total = sum(r["n"] for r in made)
        weights = sum(r["n"] / total * np.frombuffer(r["weights"], np.float64) for r in made)
        final = sum(np.frombuffer(r["final"], np.float64) for r in made)
        model = (*model[:4], weights.reshape(GATES, INPUTS), final.reshape(256, BINS, 2))
    return model


_DEALT = "token binary, train long, n long, home long, shard int"


def maximized(ratio: np.ndarray, n: np.ndarray, start: float = 0.5, rounds: int = 200) -> float:
    """The weight of the second of two predictors, of places that it gives so many times the first's probability."""
    w = start
    for _ in range(rounds):
        w = min(1 - 1e-12, float((n * (w * ratio / (1 - w + w * ratio))).sum() / max(1e-300, n.sum())))  # at 1, a ratio of 0 would leave nothing
    return w


def log10_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10(10**a + 10**b)."""
    return np.logaddexp(a * math.log(10), b * math.log(10)) / math.log(10)


class Words:
    """What is broadcast of tokens: log10 of probabilities in training documents (own 1) and in others (own 0), and the contexts."""

    def __init__(self, key: np.ndarray, count: np.ndarray, spelled: np.ndarray, trained: int, spell: float, head: np.ndarray) -> None:
        self.key, self.head = key, head
        self.base = np.log10(count + 0.5)
        self.plain = [told_apart(count, spelled, trained, spell, own) for own in (0, 1)]

    def ready(self) -> Words:
        """With tables to look tokens and contexts up; a worker makes them once."""
        if not hasattr(self, "table"):
            self.table, self.context = Table(self.key), Table(self.head)
        return self

    def scored(self, t: Tokens, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's place (-1: not broadcast) and log10 of its probability without context (0 for others)."""
        at = self.table.find(t.key)
        if not len(self.key):
            return at, np.zeros(len(at))
        return at, np.where(at >= 0, np.where(own > 0, self.plain[1][at], self.plain[0][at]), 0.0)


class Pairs:
    """What is broadcast of pairs: the log10 that a pair adds to its token's, in other documents (own 0) and in training ones (own 1).

    unseen: what a pair adds that no other training document has, by context. Gains are told by what they are above it.
    """

    def __init__(self, context: np.ndarray, key: np.ndarray, other: np.ndarray, training: np.ndarray, unseen: np.ndarray) -> None:
        self.key, self.gain, self.unseen = _paired(context, key), np.stack([other, training]), unseen

    def ready(self) -> Pairs:
        if not hasattr(self, "table"):
            self.table = Table(self.key)
        return self


def _paired(context: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(key.view(np.uint64) ^ mix(context.astype(np.uint64) + np.uint64(1)))


def told_apart(count: np.ndarray, spelled: np.ndarray, trained: int, spell: float, own: int) -> np.ndarray:
    """log10 of tokens' probabilities without context, from their counts and their spelling's log10."""
    with np.errstate(divide="ignore"):
        return log10_sum(spelled + np.log10(spell), np.log10((1 - spell) * np.maximum(count - own, 0) / max(1, trained - own)))


_ROWS = "doc_id long, train boolean, n_bytes long, n_tokens long, n_known long, base double, score double, segments array<struct<k:long,v:double>>, s array<int>, b array<int>, k array<long>"


def _places(shared) -> Callable:
    """A row for each text: sums over the tokens that are broadcast, its segments with theirs, and what else its tokens add.

    Lists b and k hold the other tokens (b: NO_CONTEXT) and every token that comes after a context (b: the context's place), in
    order; s has how many of them are in each segment, twice, and one more if that has SEGMENT_WORDS: they are far fewer than
    tokens. k is a token's place (and PLACED) if it is broadcast, else its key: small numbers take less room.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.ready()
        base = np.append(words.base, 0.0)
        for part in parts:
            for first, data, offsets in chunks(part[1]):
                t, rows = Tokens(data, offsets), len(offsets) - 1
                columns = [part[i].slice(first, rows) for i in (0, 2)]
                own = columns[1].to_numpy(zero_copy_only=False).astype(float)[t.row]
                at, p = words.scored(t, own)
                start, length, key = t.segments()
                long = length >= SEGMENT_WORDS
                row = t.row[start]
                in_row = np.bincount(row[long], minlength=rows)
                value = np.add.reduceat(p, start)
                before = words.context.find(t.before)
                alone, after = np.flatnonzero(at < 0), np.flatnonzero(before >= 0)
                rare = np.concatenate((alone, after))
                order = np.argsort(rare, kind="stable")
                rare, context = rare[order], np.concatenate((np.full(len(alone), NO_CONTEXT), before[after]))[order]
                held = 2 * np.bincount(np.repeat(np.arange(len(start)), length)[rare], minlength=len(start)) + long
                lists = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                segments = pa.ListArray.from_arrays(lists(in_row), pa.StructArray.from_arrays([pa.array(key[long].view(np.int64)), pa.array(value[long])], ["k", "v"]))
                at_row = lists(np.bincount(t.row[rare], minlength=rows))
                others = [pa.ListArray.from_arrays(lists(np.bincount(row, minlength=rows)), pa.array(held, pa.int32()))]
                others += [pa.ListArray.from_arrays(at_row, x) for x in (pa.array(context, pa.int32()), pa.array(np.where(at[rare] >= 0, at[rare] + PLACED, t.key[rare].view(np.int64))))]
                known = np.bincount(t.row, at >= 0, rows).astype(np.int64)
                sums = [np.bincount(t.row, base[at], rows), np.bincount(row, np.where(long, 0.0, value), rows)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(offsets)), pa.array(t.count), pa.array(known), *map(pa.array, sums), segments, *others],
                    names=["doc_id", "train", "n_bytes", "n_tokens", "n_known", "base", "score", "segments", "s", "b", "k"],
                )

    return run


def _others(shared) -> Callable:
    """Tokens and pairs that aren't broadcast, one a row (own: -1 in segments that are coded as one); what other pairs add, one a text.

    The text's sum has every pair as if it were unseen; a pair's row is for what it is worth above that.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, names = shared.value.ready(), ["row", "own", "b", "k", "v"]
        for part in parts:
            pieces, at, hit = (np.repeat(np.arange(part.num_rows), part[i].value_lengths().fill_null(0).to_numpy()) for i in (2, 3, 5))
            held, context, key, taken = (part[i].flatten().to_numpy() for i in (2, 3, 4, 5))
            long = held & 1
            before = np.cumsum(np.bincount(pieces, long, part.num_rows + 1).astype(np.int64))
            number = np.cumsum(long) - 1 - np.concatenate(([0], before))[pieces]
            alone = np.repeat((long == 0) | ~np.isin(pieces << 32 | number, hit << 32 | taken), held >> 1)
            train, row = part[1].to_numpy(zero_copy_only=False), part[0].to_numpy()
            own = np.where(alone, train[at], -1)
            keep = (context == NO_CONTEXT) | alone
            after = np.flatnonzero((context != NO_CONTEXT) & alone)
            if len(after):
                place = pairs.table.find(_paired(context[after], key[after]))
                some, value = np.unique(at[after]), np.bincount(at[after], pairs.unseen[context[after]], len(row))
                after, place = after[place >= 0], place[place >= 0]
                keep[after] = False
                value = (value + np.bincount(at[after], pairs.gain[own[after], place], len(row)))[some]
                yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(np.zeros(len(some), np.int32)), pa.array(np.full(len(some), OF_SUMS, np.int32)), pa.array(row[some]), pa.array(value)], names=names)
            left = np.flatnonzero(keep)
            for to in range(0, len(left), 100_000):
                some = left[to : to + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(row[at[some]]), pa.array(own[some].astype(np.int32)), pa.array(context[some]), pa.array(key[some]), pa.nulls(len(some), pa.float64())], names=names)

    return run


def _met_by() -> Column:
    """What occurrences and worth meet by: context and place as one number, or a hash where the token isn't broadcast."""
    return F.when(F.col("k").between(0, (2 << FREQUENT) - 1), F.col("b").cast("long") * (2 << FREQUENT) + F.col("k")).otherwise(F.xxhash64(F.col("b").cast("int"), F.col("k"))).alias("key")


def with_hits(lists: DataFrame, hits: DataFrame) -> DataFrame:
    """lists with each row's hits (null: none). Only rows that have some are moved; which they are is broadcast, a bit a row."""
    bucket, bit = F.bitmap_bucket_number("row"), F.bitmap_bit_position("row")
    marks = written(hits.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits")), "mixing-marks")
    if marks.count() > MARKS:
        return lists.join(hits, "row", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = lists.join(F.broadcast(marks), bucket == F.col("_bucket"), "left").withColumn("_there", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")
    there = marked.filter("_there").drop("_there").join(hits, "row")
    return there.unionByName(marked.filter("not _there").drop("_there").withColumn("hits", F.lit(None).cast("array<int>")))


def _log10_sum(a: Column, b: Column) -> Column:
    """log10(10**a + 10**b); a null b adds nothing."""
    return F.when(b.isNull(), a).otherwise(F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b))))


def pair_gains(rows: DataFrame, meant: DataFrame, head: np.ndarray, size: np.ndarray, trained: int) -> tuple[DataFrame, np.ndarray]:
    """b, k, train, other, training of every pair behind a context that some text finds in another training document; what a pair adds else, by context.

    A token after context b is a mixture of what it is without it and its share of what comes after b. The mixture's weights are
    those of the context's gate, from all pairs. A pair that no other training document has adds log10 of one less the weight,
    whatever its token is; other and training are the log10 that a pair adds above that, by own occurrences (0 and 1). So pairs
    of one training occurrence and no other, the greater part, needn't be stored or met. meant: k, and log10 of each token's
    probability without context.
    """
    spark = rows.sparkSession
    gate = np.clip(np.log2(max(1, trained) / np.maximum(size, 1)), 0, GATES - 1).astype(np.int64)
    contexts = spark.createDataFrame(pa.table({"b": pa.array(np.arange(len(head)), pa.int32()), "size": size, "gate": gate}))  # 2**HEAD rows and one at most
    found = rows.select("train", F.explode(F.arrays_zip("b", "k")).alias("x")).filter(F.col("x.b") != NO_CONTEXT).groupBy("x.b", "x.k")
    found = found.agg(F.count_if("train").alias("train"), F.bool_or(~F.col("train")).alias("asked")).filter((F.col("train") > 1) | (F.col("train") > 0) & F.col("asked")).drop("asked")
    found = written(found.join(meant.select("k", "other", "training"), "k").join(F.broadcast(contexts), "b"), "mixing-pairs")
    after = lambda n: F.greatest(F.col("train") - n, F.lit(0)) / F.greatest(F.col("size") - n, F.lit(1))
    ratio = F.round(F.greatest(F.least(F.log10(after(1)) - F.col("training"), F.lit(99.0)), F.lit(-99.0)), 2)
    cells = found.filter("train > 1").groupBy("gate", ratio.alias("r")).agg(F.sum("train").alias("n")).collect()
    # each training occurrence of a context has one token after it, the end none: what isn't in the cells are pairs that occur once
    total = np.bincount(gate, np.where(head == END, 0, size), GATES).astype(np.int64)
    weight = np.zeros(GATES)
    for g in np.flatnonzero(total):
        mine = [r for r in cells if r["gate"] == g]
        n = [float(r["n"]) for r in mine]
        weight[g] = min(0.99, maximized(np.array([0.0, *(10.0 ** r["r"] for r in mine)]), np.array([float(total[g]) - sum(n), *n])))
    w = F.element_at(F.array(*map(F.lit, weight.tolist())), (F.col("gate") + 1).cast("int"))
    gain = lambda n, plain: _log10_sum(F.log10(1 - w), F.log10(w * after(n)) - F.col(plain)) - F.log10(1 - w)
    return found.select("b", "k", "train", gain(0, "other").alias("other"), gain(1, "training").alias("training")), np.log10(1 - weight)[gate]


def language_scores(docs: DataFrame, held_out: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Null and empty texts have the end as their only token; bits_per_byte is null for them. Rows that repeat a doc_id are
    scored each by itself, a null doc_id isn't held out. An empty table gives no rows; without training rows train_tokens is 0 and
    the spelling's model is uniform. Tokens, pairs and segments are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    base = texts(docs)
    is_train = (remainder() != held_out).alias("train")
    counts = base.select("text", is_train).mapInArrow(_count, _COUNTS).groupBy("token").agg(F.sum("train").alias("train"), F.sum("n").alias("n"))
    counts = written(counts, "mixing-counts")
    kind = F.substring("token", 1, 1)
    words = counts.filter(kind != F.lit(OF_SEGMENT))
    different, trained, starts = words.agg(F.count_if(F.col("train") > 0), F.sum("train"), F.sum(F.when(F.col("token") == F.lit(b""), F.col("train")))).first()
    trained, starts = trained or 0, starts or 0
    shared = spark.sparkContext.broadcast(model := fit(words, different))
    dealt = words.mapInArrow(_dealt(model[0], model[2]), _DEALT).repartition("home").sortWithinPartitions("shard", "home", "token")
    known = written(dealt.mapInArrow(_spelled(shared), "k long, c long, log_p double"), "mixing-known")
    shared.destroy()
    # the weight of the spelling against the share of training tokens
    ratio = F.log10((F.col("c") - 1) / max(1, trained - 1)) - F.col("log_p")
    cells = known.filter("c > 0").groupBy(F.round(F.greatest(F.least(F.coalesce(ratio, F.lit(-99.0)), F.lit(99.0)), F.lit(-99.0)), 1).alias("r")).agg(F.sum("c").alias("n")).collect()
    times = np.array([0.0 if r["r"] <= -99 else 10.0 ** r["r"] for r in cells])
    spell = 1 - maximized(times, np.array([float(r["n"]) for r in cells])) if cells else 1.0
    spell = min(max(spell, 1e-6), 1.0 if not trained else 1 - 1e-6)
    # what is broadcast
    often = (F.col("c") > 0) & (F.col("c") * (1 << FREQUENT) >= trained)
    by_count = lambda t: t.sort_by([("c", "descending"), ("k", "ascending")])  # common ones have small places
    top = by_count(known.filter(often).toArrow())
    heads = by_count(known.filter((F.col("c") > 0) & (F.col("c") * (1 << HEAD) >= trained)).select("k", "c").toArrow())
    head, size = (np.append(heads.column(i).to_numpy().view(kind_), kind_(x)) for i, kind_, x in ((0, np.uint64, START), (1, np.int64, starts)))
    frequent = Words(*(top.column(i).to_numpy().view(k) for i, k in ((0, np.uint64), (1, np.int64), (2, np.float64))), trained, spell, head)
    shared = spark.sparkContext.broadcast(frequent)
    rows = written(base.select("doc_id", "text", is_train).mapInArrow(_places(shared), _ROWS).withColumn("row", F.monotonically_increasing_id()), "mixing-rows")
    shared.destroy()
    # segments that training documents hold elsewhere
    whole = counts.filter(kind == F.lit(OF_SEGMENT)).select(F.conv(F.hex(F.substring("token", 2, 8)), 16, -10).cast("long").alias("k"), "train", "n")
    total, again = whole.agg(F.sum("train"), F.sum(F.when(F.col("train") > 1, F.col("train")))).first()
    copied = ((again or 0) + 1) / ((total or 0) + 2)
    elsewhere = F.col("c") - F.col("train").cast("long")
    one = F.log10(copied * elsewhere / F.greatest(F.lit(total or 0) - F.col("train").cast("long"), F.lit(1)))
    found = rows.select("row", "train", F.posexplode("segments").alias("s", "x")).select("row", "train", "s", "x.k", "x.v").join(whole.filter("train > 0 and n > 1").select("k", F.col("train").alias("c")), "k")
    found = written(found.filter(elsewhere > 0).select("row", "s", (one - math.log10(1 - copied) - F.col("v")).alias("gain")), "mixing-segments")
    hits = found.groupBy("row").agg(F.collect_list("s").alias("hits"))
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # what pairs add to their tokens, and other tokens' counts; those of a segment that is coded as one add nothing to the score
    own = lambda n: (F.col("c") - n, F.greatest(F.lit(trained - n), F.lit(1)))
    plain = lambda n: _log10_sum(F.col("log_p") + math.log10(spell), F.log10((1 - spell) * own(n)[0] / own(n)[1])) if spell < 1 else F.col("log_p")
    # tokens that are broadcast go by their places
    placed = spark.createDataFrame(top.set_column(0, "k", pa.array(np.arange(top.num_rows) + PLACED)), known.schema).unionByName(known.filter(~often))
    meant = placed.select("k", "c", plain(0).alias("other"), plain(1).alias("training"))
    pairs, unseen = pair_gains(rows, meant, head, size, trained)
    many = F.col("train") * (1 << PAIRS) >= max(1, trained)
    shared = spark.sparkContext.broadcast(Pairs(*(x.to_numpy() for x in pairs.filter(many).select("b", "k", "other", "training").toArrow().columns), unseen))
    key = _met_by()
    worth = meant.filter(~often).withColumn("b", F.lit(NO_CONTEXT)).select(key, F.when(F.col("c") > 0, 1).otherwise(0).alias("known"), F.log10(F.col("c") + 0.5).alias("base"), "other", "training")
    worth = worth.unionByName(pairs.filter(~many).select(key, F.lit(0).alias("known"), F.lit(0.0).alias("base"), "other", "training"))
    lists = rows.select("row", "train", "s", "b", "k")
    lists = lists.join(F.broadcast(hits), "row", "left") if few else with_hits(lists, hits)
    rare = lists.select("row", "train", "s", "b", "k", "hits").mapInArrow(_others(shared), "row long, own int, b int, k long, v double")
    met = rare.select("row", "own", "v", key).join(worth.hint("shuffle_hash"), "key", "left")
    value_of = F.coalesce("v", F.when(F.col("own") == 1, F.col("training")).when(F.col("own") == 0, F.col("other")))
    none = lambda kind: F.lit(None).cast(kind)
    value = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["v"] + math.log10(1 - copied))
    parts = rows.select("row", "doc_id", "n_bytes", "n_tokens", "n_known", "base", (F.col("score") + value).alias("score"))
    parts = parts.unionByName(found.select("row", none("long").alias("doc_id"), none("long").alias("n_bytes"), none("long").alias("n_tokens"), none("long").alias("n_known"), none("double").alias("base"), F.col("gain").alias("score")))
    parts = parts.unionByName(met.groupBy("row").agg(F.sum("known").alias("n_known"), F.sum("base").alias("base"), F.sum(value_of).alias("score")).select(
        "row", none("long").alias("doc_id"), none("long").alias("n_bytes"), none("long").alias("n_tokens"), "n_known", "base", "score"))
    whole_ = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known", "base", "score")])
    space = math.log10(trained + 0.5 * (different + 1))
    return whole_.select(
        "doc_id", (remainder() == held_out).alias("held_out"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.lit(trained).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * space).alias("base_score"), F.col("score").alias("score"), (-F.col("score") * math.log2(10) / F.nullif(F.col("n_bytes"), F.lit(0.0))).alias("bits_per_byte"),
    )
