"""SimHash near-deduplication with a Gray-order hierarchical index.

Fingerprints that differ in few bits agree in at least one of four blocks of bits, so a fingerprint meets its possible
neighbours in the four buckets named by its blocks. A bucket with more than a set number of different fingerprints is
dealt out again by blocks of its remaining bits, and so on, so no bucket grows with the data and no link is lost.
Within a bucket the fingerprints are sorted by Gray rank and grouped into a tree: a node holds the bits that all its
members share (a mask and a pattern), a child only the bits that it adds to its parent's. Two nodes are compared by the
differences of their common masked bits; the whole pair of groups is dropped when these pass the limit. Of the links
found, a spanning forest goes on to a distributed connected-components loop over minima.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw, texts, written

SHINGLE = 3
MOST_BITS = 3
#: Different fingerprints in a bucket beyond which it is dealt out by further bits.
BUCKET = 4096
#: Members of a tree node per child.
FAN = 8
#: Pairs of nodes that one step of the search compares.
STEP = 1 << 18
_ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of a text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) > shingle:
        begins = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        ends = ends[shingle - 1 :].tolist()
    else:
        begins, ends = [0], [len(line)]
    h, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(begins)
    for at in range(0, n, 50_000):
        part = np.array([h(line[a:b], 42) for a, b in zip(begins[at : at + 50_000], ends[at : at + 50_000], strict=True)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        found = np.array([fingerprint(x) for x in raw(part[1])], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part[0], pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (64 bits as a long) of every row."""
    return texts(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order: the prefix parity of its bits."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Levels of nodes over codes sorted by bucket and Gray rank; no node spans two buckets."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray) -> None:
        order = np.lexsort((gray_rank(codes), bucket))
        self.order, self.codes, bucket = order, codes[order], bucket[order]
        full = np.full(len(codes), ~np.uint64(0))
        self.levels = [(self.codes, full, np.arange(len(codes) + 1))]  # pattern, mask, first child
        own, pattern, any_, all_ = bucket, self.codes, self.codes, self.codes
        while len(own) and (own[1:] == own[:-1]).any():
            change = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            within = np.arange(len(own)) - np.repeat(change, np.diff(np.append(change, len(own))))
            first = np.flatnonzero(within % FAN == 0)
            any_, all_ = np.bitwise_or.reduceat(any_, first), np.bitwise_and.reduceat(all_, first)
            mask = ~(any_ ^ all_)
            pattern = all_ & mask
            self.levels.append((pattern, mask, np.append(first, len(own))))
            own = own[first]

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in the given order) of pairs of one bucket with at most so many differing bits, block by block."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)] if top else []
        while stack:
            level, a, b = stack.pop()
            if len(a) > STEP:
                stack += [(level, a[STEP:], b[STEP:]), (level, a[:STEP], b[:STEP])]
                continue
            first = self.levels[level][2]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            n = na * nb
            pair = np.repeat(np.arange(len(a)), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            x, y = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
            pattern, mask, _ = self.levels[level - 1]
            keep = (x < y) if level == 1 else (x <= y)
            x, y = x[keep], y[keep]
            # what the parents' shared bits already told is part of this: masks only widen on the way down
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= most
            x, y = x[near], y[near]
            if level == 1:
                yield self.order[x], self.order[y]
            elif len(x):
                stack.append((level - 1, x, y))


def spanning(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places, the smallest place that links reach."""
    label = np.arange(n)
    for x, y in links:
        while len(x):
            a, b = label[x], label[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def _bucket_links(most: int, together: int = 200_000) -> Callable:
    """Links of rows sorted by bucket; whole buckets are worked on together until they have so many rows."""

    def linked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, fp = t.column(0).to_numpy(), t.column(1).to_numpy()
        label = spanning(len(fp), GrayIndex(np.unique(key, return_inverse=True)[1], fp.view(np.uint64)).links(most))
        there = np.flatnonzero(label != np.arange(len(fp)))
        for at in range(0, len(there), 50_000):
            i = there[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(fp[label[i]]), pa.array(fp[i])], names=["a", "b"])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in parts:
            held.append(part)
            rows += part.num_rows
            if rows >= together:
                t = pa.Table.from_batches(held)
                key = t.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if cut:
                    yield from linked(t.slice(0, cut))
                    held, rows = t.slice(cut).to_batches(), rows - cut
        if rows:
            yield from linked(pa.Table.from_batches(held))

    return run


def _blocks(free: list[int], blocks: int) -> list[list[int]]:
    cut = [round(i * len(free) / blocks) for i in range(blocks + 1)]
    return [free[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _key(fp: Column, path: int, free: list[int]) -> Column:
    """A bucket's name: the way of blocks taken and the bits of the block."""
    mask = sum(1 << i for i in free)
    return F.xxhash64(F.lit(path), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))


def links(codes: DataFrame, most: int = MOST_BITS, bucket: int = BUCKET) -> DataFrame:
    """Pairs a, b of different codes (column fp, a long, no repeats) that connect just what lies within most bits."""
    spark = codes.sparkSession
    found, todo, ways = None, codes.select("fp", F.lit(0).cast("long").alias("held")), [(0, list(range(64)))]
    while ways:
        names = [(path * (most + 1) + i + 1, block, [x for x in free if x not in block]) for path, free in ways for i, block in enumerate(_blocks(free, most + 1))]
        at = F.array(*[F.struct(F.lit(path).cast("long").alias("path"), F.xxhash64("held", _key(F.col("fp"), path, block)).alias("key")) for path, block, _ in names])
        if len(ways) > 1 or ways[0][0]:
            at = F.filter(at, lambda e: (F.floor((e["path"] - 1) / (most + 1)) == F.col("way")))
        dealt = written(todo.withColumn("e", F.explode(at)).select("e.path", "e.key", "fp"), "simhash-dealt")
        sizes = dealt.groupBy("path", "key").count().filter(F.col("count") > bucket).select("path", "key")
        large = written(sizes, "simhash-large")
        rows = dealt
        if not large.isEmpty():
            rows = dealt.join(large, ["path", "key"], "left_anti")
        made = written(rows.repartition("key").select("key", "fp").sortWithinPartitions("key").mapInArrow(_bucket_links(most), "a long, b long"), "simhash-links")
        found = made if found is None else found.unionByName(made)
        if large.isEmpty():
            break
        still = {r[0] for r in large.select("path").distinct().collect()}
        ways = [(path, free) for path, _, free in names if path in still]
        todo = dealt.join(large, ["path", "key"]).select("fp", F.col("key").alias("held"), F.col("path").alias("way"))
    return found if found is not None else spark.createDataFrame([], "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reached) of every id on an edge a, b.

    Each round gives every id the least id among itself and its neighbours, follows that pointer once more, and keeps the
    edges between what is still apart; all steps are joins and minima that combine before the shuffle.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    label = None  # id, root
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")), "cc-up")
        for _ in range(2):
            over = up.select(F.col("id").alias("root"), F.col("root").alias("over"))
            up = written(up.join(over, "root", "left").select("id", F.least("root", F.coalesce("over", "root")).alias("root")), "cc-jump")
        step = up.select(F.col("id").alias("was"), F.col("root").alias("now"))
        if label is None:
            label = up
        else:  # the edges left are between roots, so the ids of up are roots of label
            label = written(label.join(step, label["root"] == step["was"], "left").select("id", F.coalesce("now", "root").alias("root")), "cc-label")
        a = edges.join(step, edges["a"] == step["was"]).select(F.col("now").alias("a"), "b")
        b = a.join(step, a["b"] == step["was"]).select("a", F.col("now").alias("b"))
        edges = written(b.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    if label is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return label.select("id", F.col("root").alias("component"))


def near_dedup(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Copies share a fingerprint and are looked up once. A null or empty text, or one without words, has fingerprint zero
    and links like any other. A null doc_id never names a component unless nothing else is reachable. An empty table gives
    no rows.
    """
    prints = written(fingerprints(docs), "simhash-fp")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    comp = components(links(nodes.select("fp"), most))
    joined = nodes.join(comp, nodes["fp"] == comp["id"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(written(joined.select("fp", "component"), "simhash-named").join(written(lows, "simhash-lows"), "component").select(F.col("fp").alias("_fp"), "component_id"), "simhash-components")
    return prints.join(named, prints["fp"] == named["_fp"], "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """docs with the smallest doc_id of each component only, all columns as they are; a null doc_id stays.

    Rows that repeat a doc_id stand or fall together: all stay if it is the smallest of the component of each of their texts.
    """
    gone = written(near_dedup(docs, most).filter(F.col("doc_id") != F.col("component_id")).select("doc_id"), "simhash-gone")
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
