"""Exact deduplication with Patricia-trie owners.

Rows are keyed by text length and content hash. Only keys that two rows or more share go on: each input partition
inserts its candidates' full byte strings into a compressed radix trie, whose terminal nodes hold the owner and the
number of copies, so a text held by a third of all rows leaves a partition once. The partial owners are dealt out by
length and hash, and a second trie per partition merges them. Its input is sorted by that key, so a subtree is
complete, and handed on, as soon as the key moves on; a map-side trie over its byte limit hands on its largest
subtrees early, which costs only another merge.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, raw, texts, written

#: The most candidate keys that are broadcast (24 MB); beyond it the candidates are found by a shuffled semi-join.
BROADCAST_KEYS = 1 << 20
#: The bytes of labels that one trie holds before it hands on subtrees.
TRIE_BYTES = 64 << 20

_PART = pa.schema([("n_len", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
_OWNER = pa.schema([("owned_sha256", pa.string()), ("owner", pa.int64()), ("n", pa.int64())])


class _Node:
    __slots__ = ("label", "children", "owner", "n")

    def __init__(self, label: bytes, owner: int | None = None, n: int = 0) -> None:
        self.label, self.children, self.owner, self.n = label, {}, owner, n


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over byte strings; a terminal node keeps its string's owner and number of rows."""

    def __init__(self, pick: Callable[[int, int], int]) -> None:
        self.pick, self.root, self.held = pick, _Node(b""), 0

    def insert(self, key: bytes, owner: int | None, n: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                new = _Node(key[at:])
                node.children[key[at]] = new
                self.held += len(new.label) + 100
                node, at = new, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                same = _common(child.label, key[at : at + len(child.label)])
                upper = _Node(child.label[:same])
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.held += 100
                node, at = upper, at + same
        if owner is not None:
            node.owner = owner if node.owner is None else self.pick(node.owner, owner)
        node.n += n

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.label
            if node.n:
                yield whole, node.owner, node.n
            stack += [(c, whole) for _, c in sorted(node.children.items(), reverse=True)]

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        return self._walk(self.root, b"")

    def spill(self, limit: int) -> Iterator[tuple[bytes, int | None, int]]:
        """Hands on the largest subtrees below the root until at most limit bytes are held."""
        sizes = {k: sum(len(x.label) + 100 for x in self._nodes(c)) for k, c in self.root.children.items()}
        for k in sorted(sizes, key=sizes.get, reverse=True):
            if self.held <= limit:
                break
            self.held -= sizes[k]
            yield from self._walk(self.root.children.pop(k), b"")

    @staticmethod
    def _nodes(node: _Node) -> Iterator[_Node]:
        stack = [node]
        while stack:
            yield (x := stack.pop())
            stack += x.children.values()


def _partial(keep: str, limit: int) -> Callable:
    pick = max if keep == "max" else min

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie = PatriciaTrie(pick)
            header = struct.Struct(">qq")
            cut = lambda x: (*header.unpack(x[0][:16])[::-1], x[0][16:], x[1], x[2])
            for part in parts:
                for size, h, text, owner in zip(part[0].to_pylist(), part[1].to_pylist(), raw(part[2]), part[3].to_pylist(), strict=True):
                    trie.insert(header.pack(h, size) + text, owner)
                    if trie.held > limit:
                        yield from map(cut, trie.spill(limit // 2))
            yield from map(cut, trie.items())

        return batches(rows(), _PART)

    return run


def _merged(keep: str) -> Callable:
    pick = max if keep == "max" else min

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie, key = PatriciaTrie(pick), None
            done = lambda x: (hashlib.sha256(x[0]).hexdigest(), x[1], x[2])
            for part in parts:
                for size, h, text, owner, n in zip(part[0].to_pylist(), part[1].to_pylist(), part[2].to_pylist(), part[3].to_pylist(), part[4].to_pylist(), strict=True):
                    if key is not None and key != (size, h):
                        yield from map(done, trie.items())
                        trie = PatriciaTrie(pick)
                    key = (size, h)
                    trie.insert(text, owner, n)
            yield from map(done, trie.items())

        return batches(rows(), _OWNER)

    return run


def exact_dedup(docs: DataFrame, keep: str = "max", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: whether the largest ("max") or smallest ("min") doc_id of equal texts owns them. A null text is the empty
    text. A null doc_id counts in group_size and owns a text only if no other row does. Rows that repeat the owner's
    doc_id are all kept: they are the same document. An empty table gives no rows; other columns are not looked at.
    """
    base = texts(docs)
    keys = [F.octet_length("text").cast("long").alias("n_len"), F.xxhash64("text").alias("hash")]
    thin = written(base.select("doc_id", *keys, F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "exact-thin")
    shared = written(thin.groupBy("n_len", "hash").count().filter("count > 1").select("n_len", "hash"), "exact-keys")
    few = shared.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    candidates = base.select(*keys, "text", "doc_id").join(F.broadcast(shared) if few else shared, ["n_len", "hash"], "left_semi")
    partial = candidates.select("n_len", "hash", "text", "doc_id").mapInArrow(_partial(keep, trie_bytes), "n_len long, hash long, text binary, owner long, n long")
    owners = partial.repartition("n_len", "hash").sortWithinPartitions("n_len", "hash").mapInArrow(_merged(keep), "owned_sha256 string, owner long, n long")
    owners = written(owners.filter("n > 1"), "exact-owners")
    return thin.join(owners, F.col("text_sha256") == F.col("owned_sha256"), "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("owner")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("owner"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """docs without the rows that exact_dedup() drops, all columns as they are."""
    gone = written(exact_dedup(docs, keep).filter("not kept").select("doc_id"), "exact-gone")
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
"""
