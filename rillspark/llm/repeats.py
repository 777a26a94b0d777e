"""Removal of repeated byte strings with common-prefix interval trees over sampled suffix arrays.

A string of LENGTH bytes is sampled by an anchor: among its GRAM-byte pieces the one of least hash, so equal strings have
equal anchors at equal places. An anchor of a text stands for a run of such strings (its context: all their bytes).
Anchors are dealt out by the hash of their piece. Contexts that are equal as a whole repeat as a whole. Of those that
share an anchor and yet differ, one each goes on with its bytes: the suffixes at the anchors are sorted, with the lengths
of common prefixes of neighbours (an enhanced suffix array); a stack scan finds the intervals of suffixes with a common
prefix, and within an interval a second scan over the reversed left contexts finds the groups that can't be extended to
the left because their members' next bytes differ. Such a group, if no deeper interval holds all of it, is a maximal repeat
with all its occurrences.

A group of anchors is bounded: pieces with about HOT anchors in all (by a sample of all bytes, which decides on nothing
but the way they take), and groups with over GROUP different contexts, go by descent. There, contexts that are equal as a
whole are settled by aggregates that combine before the shuffle; one of each different context is cut into blocks of 32
strings, dealt out by the bytes that all strings of a block have in common (69 of them), and again equal blocks are settled
as a whole and different ones compared by suffix arrays. Blocks of which over GROUP differ around the same bytes are cut
into blocks of eight strings (93 bytes), and those into single strings, which are equal as a whole or not at all.

"Equal as a whole" is told by 64 bits of hash of the piece, or common bytes, and 64 more of all bytes and the shape.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, numbered, raw, texts, written
from .ngrams import CHUNK, chunks, mix, span_hashes

LENGTH = 100
GRAM = 32
#: A piece with about so many anchors in all is hot.
HOT = 1 << 15
#: Every so many'th slice of SLICE bytes is looked at for hot pieces.
SAMPLE, SLICE = 16, 1 << 16
#: Hot pieces that may be broadcast (8 bytes each); beyond it anchors meet them in a join, dealt out to so many salts.
HOT_BROADCAST, SALTS = 100_000, 64
#: Different contexts of one piece, or blocks with the same common bytes, that are compared by a suffix array.
GROUP = 4096
#: Strings of a block, by level of the descent.
WIDTHS = (32, 8, 1)
#: doc_ids that may be broadcast (16 bytes each).
BROADCAST_IDS = 500_000
_PLACE = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Piece hash, row, and in the chunk: anchor, first and last start of the strings of length bytes that it stands for."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none, none
    wide = length - gram + 1
    parts = []
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # a place in a block must fit into the low bits of a key; blocks overlap by what one string more needs
    for at in range(0, len(data) - length + 1, CHUNK - length + 1):
        block = data[at : at + CHUNK]
        if len(block) < length:
            break
        i = np.arange(len(block) - gram + 1)
        piece = mix(span_hashes(block, i, i + gram))
        # equal pieces: the last counts, whatever the other hash bits; the place is found in the key
        key = (piece & ~_PLACE) | (_PLACE - i.astype(np.uint64))
        padded = np.concatenate((key, np.full((-len(key)) % wide, ~np.uint64(0)))).reshape(-1, wide)
        ahead = np.minimum.accumulate(padded, 1).reshape(-1)
        back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].reshape(-1)
        n = len(key) - wide + 1
        place = (_PLACE - (np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n]) & _PLACE)).astype(np.int64)
        start = np.flatnonzero(row[at : at + n] == row[at + length - 1 : at + length - 1 + n])
        if len(start):
            place, r = place[start], row[at + start]
            cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (r[1:] != r[:-1]))))
            parts.append((piece[place[cut]], r[cut], at + place[cut], at + start[cut], at + start[np.append(cut[1:], len(start)) - 1]))
    if not parts:
        return none.astype(np.uint64), none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _each(part: pa.RecordBatch) -> Iterator[tuple]:
    """Anchors of a batch of (doc_id, text), by chunk: bytes, doc_id, offset of the text, and what anchors() tells."""
    ids = part[0].to_numpy(zero_copy_only=False)
    for first, data, offsets in chunks(part[1]):
        piece, row, place, low, high = anchors(data, offsets)
        yield data, ids[first + row], offsets[row], piece, place, low, high


def _heavy(sample: int) -> Callable:
    """Pieces of anchors in every so many'th slice, and how many."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part[0].to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(part[1]):
                phase = int(mix(np.array([ids[first]], np.int64).view(np.uint64))[0] % np.uint64(sample))
                found = [anchors(data[at : at + SLICE], np.clip(offsets - at, 0, min(SLICE, len(data) - at)))[0] for at in range(phase * SLICE, len(data), sample * SLICE)]
                if found:
                    piece, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(piece.view(np.int64)), pa.array(n.astype(np.int64))], names=["piece", "n"])

    return run


def _anchors(shared, of_hot: bool) -> Callable:
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for part in parts:
            for data, ids, offset, piece, place, low, high in _each(part):
                keep = np.isin(piece, hot) == of_hot
                ids, offset, piece, place, low, high = (x[keep] for x in (ids, offset, piece, place, low, high))
                shape = (place - low) << 8 | (high - low)
                context = mix(span_hashes(data, low, high + LENGTH) + shape.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids), pa.array(low - offset), pa.array(shape.astype(np.int32))], names=["piece", "context", "doc_id", "low", "shape"]
                )

    return run


_GROUPED = pa.schema([("kind", pa.int32()), ("repeat_id", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("first", pa.bool_()), ("shape", pa.int32())])
WHOLE, SUFFIX, WIDE = 0, 1, 2


def _grouped(group: int) -> Callable:
    """Sorted anchors to: occurrences of contexts that repeat whole, and anchors whose contexts are to be compared."""

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        piece, context, ids, low, shape = (t.column(i).to_numpy() for i in range(5))
        order = np.lexsort((low, ids, context, piece))
        piece, context, ids, low, shape = (x[order] for x in (piece, context, ids, low, shape))
        new_piece = np.concatenate(([True], piece[1:] != piece[:-1]))
        new = new_piece | np.concatenate(([True], context[1:] != context[:-1]))
        whole = ~(new & np.append(new[1:], True))  # the context has another occurrence
        different = np.bincount(np.cumsum(new_piece) - 1, new)[np.cumsum(new_piece) - 1]
        length = (shape & 255) + LENGTH
        compared = new & (different > 1)
        kind = np.where(different > group, WIDE, SUFFIX)
        for keep, k in ((whole, np.full(len(piece), WHOLE)), (compared, kind)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep].astype(kind_)) for x, kind_ in zip((k, np.where(k == WHOLE, context, piece), length, ids, low, new, shape), (np.int32, np.int64, np.int64, np.int64, np.int64, bool, np.int32), strict=True)], schema=_GROUPED
            )

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in parts:
            held.append(part)
            rows += part.num_rows
            if rows >= 1_000_000:  # the last piece may go on in the next batch
                t = pa.Table.from_batches(held)
                key = t.column(0).to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if cut:
                    yield from emit(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows -= cut
        if rows:
            yield from emit(pa.Table.from_batches(held))

    return run


def _contexts(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("piece", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])

    def rows() -> Iterator[tuple]:
        for part in parts:
            for doc_id, text, wanted in zip(part[0].to_pylist(), raw(part[1]), part[2].to_pylist(), strict=True):
                for x in wanted:
                    low, shape = x["start"], x["shape"]
                    place = low + (shape >> 8)
                    yield x["repeat_id"], doc_id, place, text[low:place], text[place : low + (shape & 255) + LENGTH]

    return batches(rows(), schema)


def _cut(width: int) -> Callable:
    """Contexts to blocks of width strings, as anchors: their place is the context's, their piece is told by the context's and the bytes that all strings of the block share."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc_id, text, wanted in zip(part[0].to_pylist(), raw(part[1]), part[2].to_pylist(), strict=True):
                data = np.frombuffer(text, np.uint8)
                low, shape, piece = (np.array([x[k] for x in wanted], np.int64) for k in ("start", "shape", "repeat_id"))
                place, high = low + (shape >> 8), low + (shape & 255)
                least, most = (place - high) // width, (place - low) // width
                n = most - least + 1
                low, high, place, piece = (np.repeat(x, n) for x in (low, high, place, piece.view(np.uint64)))
                block = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(least, n)
                a, b = np.maximum(low, place - block * width - width + 1), np.minimum(high, place - block * width)
                shape = (place - a) << 8 | (b - a)
                salt = np.uint64(0xD6E8FEB86659FD93)
                core = mix(span_hashes(data, place - block * width, place - block * width - width + 1 + LENGTH) + mix(piece + (block * 256 + width).astype(np.uint64)))
                context = mix(span_hashes(data, a, b + LENGTH) + shape.astype(np.uint64) * salt)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(context.view(np.int64)), pa.array(np.full(len(a), doc_id)), pa.array(a), pa.array(shape.astype(np.int32))], names=["piece", "context", "doc_id", "low", "shape"])

    return run


def _same(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Length, first and last of each common-prefix interval, deepest first; common[i] is what i shares with i - 1."""
    stack: list[tuple[int, int]] = []  # length, first
    for i in range(1, len(common) + 1):
        now, first = common[i] if i < len(common) else -1, i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            if i - 1 > first:
                yield length, first, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(members: list[tuple], length: int) -> Iterator[tuple[int, int, list[tuple]]]:
    """Left and right extent and members of each maximal repeat of at least length bytes around a common anchor.

    members: (left bytes, right bytes, anything) that agree at the anchor, no two of them in all bytes.
    """
    members = sorted(members, key=lambda m: m[1])
    common = [0, *(_same(a[1], b[1]) for a, b in zip(members, members[1:], strict=False))]
    lefts = [m[0][::-1] for m in members]
    rank = {i: k for k, i in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
    for right, low, high in intervals(common):
        least = length - right
        inside = range(low, high + 1)
        if least > max(len(lefts[i]) for i in inside):
            continue
        order = sorted(inside, key=rank.__getitem__)
        shared = [0, *(_same(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False))]
        for left, a, b in intervals(shared):
            if left < least:
                continue
            places = order[a : b + 1]
            if any(common[i] == right for i in range(min(places) + 1, max(places) + 1)):  # not all in a deeper interval
                yield left, right, [members[i] for i in places]


_FOUND = pa.schema([("repeat_id", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("first", pa.bool_())])


def _runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, those that overlap or touch as one."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def _compared(merged: bool) -> Callable:
    """Maximal repeats of each piece's contexts, with all occurrences; merged: only the runs of later occurrences."""

    def groups(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        now, held = None, []
        for part in parts:
            for piece, doc_id, place, left, right in zip(*(part[i].to_pylist() for i in range(5)), strict=True):
                if piece != now:
                    if held:
                        yield now, held
                    now, held = piece, []
                held.append((left, right, (doc_id, place)))
        if held:
            yield now, held

    def rows(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for piece, members in groups(parts):
            later: dict[tuple, set] = {}
            for left, right, found in maximal_repeats(members, LENGTH):
                first = min(m[2] for m in found)
                if merged:
                    for m in found:
                        if m[2] != first:
                            later.setdefault(m[2], set()).add((-left, right))
                    continue
                word = found[0][0][len(found[0][0]) - left :] + found[0][1][:right]
                name = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)
                for _, _, (doc_id, place) in found:
                    yield name, left + right, doc_id, place - left, (doc_id, place) == first
            for (doc_id, place), spans in later.items():
                for a, b in _runs([*spans]):
                    yield piece, b - a, doc_id, place + a, False

    return lambda parts: batches(rows(parts), _FOUND)


_ANCHOR = "piece long, context long, doc_id long, low long, shape int"


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences of contexts that repeat as a whole, and one of each context that differs from others of its piece (of _GROUPED).

    Both counts combine before the shuffle, and the join's large keys can be split, so a hot key meets in no task.
    """
    first = written(rows.groupBy("piece", "context").agg(F.min(F.struct("doc_id", "low", "shape")).alias("f"), F.count("*").alias("n")), "repeats-contexts")
    again = rows.join(first.filter("n > 1").select("piece", "context", "f"), ["piece", "context"])
    is_first = (F.col("doc_id") == F.col("f.doc_id")) & (F.col("low") == F.col("f.low"))
    length = (F.col("shape").bitwiseAND(255) + LENGTH).cast("long").alias("length")
    whole = again.select(F.col("context").alias("repeat_id"), length, "doc_id", F.col("low").alias("start"), is_first.alias("first"))
    different = written(first.groupBy("piece").count().filter("count > 1").withColumnRenamed("piece", "_piece"), "repeats-different")
    kind = F.when(F.col("count") > GROUP, WIDE).otherwise(SUFFIX).alias("kind")
    compared = first.join(different, first["piece"] == F.col("_piece")).select(
        kind, F.col("piece").alias("repeat_id"), F.lit(0).cast("long").alias("length"), "f.doc_id", F.col("f.low").alias("start"), F.lit(True).alias("first"), "f.shape"
    )
    return whole, compared


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text and, as x, the contexts wanted of each document that has any; ids, not texts, are built into hash tables."""
    wanted = written(wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("repeat_id", "start", "shape")).alias("x")), "repeats-wanted")
    few = wanted.limit(1 + BROADCAST_IDS).count() <= BROADCAST_IDS
    near = docs.join(F.broadcast(wanted.select("_id")), docs["doc_id"] == F.col("_id"), "left_semi") if few else docs
    return near.join(wanted.hint("shuffle_hash"), near["doc_id"] == wanted["_id"]).select("doc_id", "text", "x")


def _by_heat(docs: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Anchors of pieces that aren't hot, and those of hot pieces (none: there are no hot pieces).

    Up to HOT_BROADCAST hot pieces, by count, are broadcast, and anchors made for each side alone. More stay a table: anchors are
    written once and meet it in a join on the piece and a salt, so that a hot piece's anchors meet in no one task.
    """
    spark, n = docs.sparkSession, hot.limit(HOT_BROADCAST + 1).count()
    if n <= HOT_BROADCAST:
        known = np.sort(hot.toPandas()["piece"].to_numpy(np.int64)).view(np.uint64)  # HOT_BROADCAST rows at most
        shared = spark.sparkContext.broadcast(known)
        return docs.mapInArrow(_anchors(shared, False), _ANCHOR), docs.mapInArrow(_anchors(shared, True), _ANCHOR) if n else None
    none = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    every = written(docs.mapInArrow(_anchors(none, False), _ANCHOR), "repeats-anchors").withColumn("salt", F.pmod(F.xxhash64("doc_id", "low"), F.lit(SALTS)).cast("int"))
    salted = hot.select("piece", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return tuple(every.join(salted, ["piece", "salt"], how).select("piece", "context", "doc_id", "low", "shape") for how in ("left_anti", "left_semi"))


def occurrences(docs: DataFrame, merged: bool = False) -> DataFrame:
    """repeat_id, length, doc_id, start, first: occurrences of repeats of at least LENGTH bytes, for docs with different texts.

    Each string of LENGTH bytes that occurs twice lies in a repeat listed here for both, up to the context of its anchor.
    first marks the occurrence with the smallest doc_id, then start. merged: of contexts that differ, not every repeat is
    listed but the runs of bytes that repeats with an earlier occurrence cover.
    """
    spark = docs.sparkSession
    counts = docs.mapInArrow(_heavy(SAMPLE), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    hot = written(counts.filter(F.col("n") * SAMPLE >= HOT).select("piece"), "repeats-hot-pieces")
    rows, warm = _by_heat(docs, hot)
    grouped = rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(_grouped(GROUP), "kind int, repeat_id long, length long, doc_id long, start long, first boolean, shape int")
    grouped = written(grouped, "repeats-grouped")
    fields = ["repeat_id", "length", "doc_id", "start", "first"]
    found = [grouped.filter(F.col("kind") == WHOLE).select(fields)]
    compared = [grouped.filter(F.col("kind") != WHOLE)]
    if warm is not None:
        whole, more = _settled(written(warm, "repeats-hot"))
        found.append(whole)
        compared.append(more)
    for width in WIDTHS:
        wide = compared[-1].filter(F.col("kind") == WIDE)
        if width == WIDTHS[0] and len(compared) > 1:
            wide = wide.unionByName(compared[0].filter(F.col("kind") == WIDE))
        if wide.isEmpty():
            break
        whole, more = _settled(written(_with_texts(docs, wide).mapInArrow(_cut(width), _ANCHOR), f"repeats-blocks-{width}"))
        found.append(whole)
        compared.append(more)
    suffix = compared[0]
    for more in compared[1:]:
        suffix = suffix.unionByName(more)
    contexts = _with_texts(docs, suffix.filter(F.col("kind") == SUFFIX)).mapInArrow(_contexts, "piece long, doc_id long, place long, left binary, right binary")
    out = written(contexts.repartition("piece").sortWithinPartitions("piece").mapInArrow(_compared(merged), "repeat_id long, length long, doc_id long, start long, first boolean"), "repeats-compared")
    for whole in found:
        out = out.unionByName(whole)
    return out


_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def rows() -> Iterator[tuple]:
        for part in parts:
            for doc_id, text, spans in zip(part[0].to_pylist(), raw(part[1]), part[2].to_pylist(), strict=True):
                runs = _runs([(x["start"], x["stop"]) for x in spans])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                yield doc_id, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest()

    return batches(rows(), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of LENGTH bytes over it also starts earlier (in a smaller doc_id, or before in its text). A
    null text is the empty text; a text under LENGTH bytes keeps all. Copies of a whole text are settled by its SHA-256
    before: all but the smallest doc_id lose all bytes. Rows that repeat a doc_id and its text are one document, reported
    for each row; rows that repeat a doc_id with another text are documents of their own, in the order of their texts'
    SHA-256. A row with a null doc_id keeps its text and is no one's earlier string. An empty table gives no rows.
    """
    base = texts(docs)
    thin = written(base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "repeats-thin")
    named = thin.filter("doc_id is not null")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _removals(base, thin)
    # other ids, in the same order, so that each stands for one text
    names = written(numbered(named.select("doc_id", "sha").distinct(), "doc_id", "sha").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), F.col("number").alias("_rid")), "repeats-names")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    own = base.join(names.hint("shuffle_hash"), (base["doc_id"] == F.col("_id")) & (sha == F.col("_sha"))).select(F.col("_rid").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    own = written(own, "repeats-own")
    made = _removals(own, thin.join(names, (thin["doc_id"] == F.col("_id")) & (thin["sha"] == F.col("_sha"))).select(F.col("_rid").alias("doc_id"), "n_bytes", "sha").distinct())
    made = written(made.select(F.col("doc_id").alias("_made"), "n_removed", "n_spans", "kept_sha256"), "repeats-made")
    zero = F.lit(0).cast("long")
    rows = thin.join(names, (thin["doc_id"] == F.col("_id")) & (thin["sha"] == F.col("_sha")), "left").join(made, F.col("_rid") == F.col("_made"), "left")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def _removals(base: DataFrame, thin: DataFrame) -> DataFrame:
    """remove_repeats for doc_ids that don't repeat."""
    owners = thin.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha").alias("_sha"), "owner")
    owners = written(owners, "repeats-owners")  # then the join's both sides are dealt out for it, and a large group of copies can be split
    copies = written(thin.join(owners, thin["sha"] == F.col("_sha")).filter("doc_id <> owner").select(F.col("doc_id").alias("_copy")), "repeats-copies")
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = base.filter("doc_id is not null")
    own = own.join(F.broadcast(copies) if few else copies.hint("shuffle_hash"), own["doc_id"] == copies["_copy"], "left_anti")
    own = own.filter(F.octet_length("text") >= LENGTH)
    spans = occurrences(own, merged=True).filter("not first").select("doc_id", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    spans = written(spans.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "repeats-spans")
    few = spans.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    near = own.join(F.broadcast(spans.select("_id")), own["doc_id"] == F.col("_id"), "left_semi") if few else own
    cut = near.join(spans.hint("shuffle_hash"), near["doc_id"] == spans["_id"]).select("doc_id", "text", "spans").mapInArrow(_removed, _SCHEMA)
    cut = written(cut.select(F.col("doc_id").alias("_cut"), "n_removed", "n_spans", "kept_sha256"), "repeats-cut")
    nothing = hashlib.sha256(b"").hexdigest()
    gone = F.col("_copy").isNotNull() & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return thin.join(cut, thin["doc_id"] == cut["_cut"], "left").join(copies.distinct(), F.col("doc_id") == F.col("_copy"), "left").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
