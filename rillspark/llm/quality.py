"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Words are runs of letters, digits and non-ASCII bytes, and runs of other visible characters. Each word counts as itself
(ASCII lower case) and as its shape (case pattern, or the very characters of a symbol run). Features are hashed words and
word pairs and hashed shape n-grams up to three; a feature's value is the square root of its share of the text's
n-grams of that sort. A score is the logistic function of the sparse dot product with the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .ngrams import chunks, mix, span_hashes

BITS = 18
#: The expected number of labelled rows that train the model; of more, a share by hash is taken.
SAMPLE = 20_000
#: Independent learners whose weights are averaged, and passes of each over its rows.
LEARNERS, EPOCHS = 4, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
THRESHOLD = 0.3

_KIND = np.full(256, 2, np.uint8)  # 0: white space, 1: part of a word, 2: other
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of each feature of each text, sorted by row."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, np.zeros(0)
    kind = _KIND[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cut = np.concatenate(([True], (kind[1:] != kind[:-1]) | (row[1:] != row[:-1]), [True]))
    edge = np.flatnonzero(cut)
    begin, end = edge[:-1], edge[1:]
    seen = kind[begin] > 0
    begin, end = begin[seen], end[seen]
    if not len(begin):
        return none, none, np.zeros(0)
    doc, word = row[begin], span_hashes(_FOLD[data], begin, end)
    sums = lambda x: np.concatenate(([0], np.cumsum(x)))
    count = lambda s: s[end] - s[begin]
    upper, digit = count(sums((data >= 65) & (data < 91))), count(sums((data >= 48) & (data < 58)))
    first = (data[begin] >= 65) & (data[begin] < 91)
    shape = np.where(upper == 0, 0, np.where((upper == 1) & first, 1, np.where(upper > 1, 2, 3))) + 4 * (digit > 0)
    shape = np.where(kind[begin] == 1, shape.astype(np.uint64), word | np.uint64(64))
    follows = np.concatenate(([False], doc[1:] == doc[:-1]))
    back = lambda x, n: np.concatenate((np.zeros(n, x.dtype), x[:-n]))[: len(x)]
    second = follows & back(follows, 1)
    same = follows & (word == back(word, 1)) | second & (word == back(word, 2))
    k = [np.uint64(0x100000001B3 * (2 * i + 1)) for i in range(8)]
    shape = mix(shape * k[0] + np.uint64(7))
    sorts = [
        (np.ones(len(word), bool), mix(word * k[1] + k[1])),
        (follows, mix(word * k[2] + mix(back(word, 1)) + k[2])),
        (np.ones(len(word), bool), shape),
        (follows, mix(shape * k[3] + back(shape, 1) + k[3])),
        (second, mix(shape * k[4] + back(shape, 1) * k[5] + back(shape, 2) + k[4])),
        (follows, mix(same.astype(np.uint64) + k[6])),
    ]
    out = []
    for there, h in sorts:
        d, f = doc[there], (h[there] >> np.uint64(64 - bits)).astype(np.int64)
        if len(d):
            key, n = np.unique((d << bits) | f, return_counts=True)
            out.append((key, np.sqrt(n / np.bincount(d, minlength=len(offsets))[key >> bits])))
    key, value = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    return key >> bits, key & ((1 << bits) - 1), value


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last coordinate is the bias."""

    def __init__(self, bits: int = BITS) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One example with distinct coordinates."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _rows(part: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, offsets in chunks(part[column]):
        row, f, v = features(data, offsets)
        cut = np.searchsorted(row, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            yield first + i, f[cut[i] : cut[i + 1]], v[cut[i] : cut[i + 1]]


def _train(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of each learner whose rows are here, and a row that counts it."""
    rows: dict[int, list] = {}
    for part in parts:
        labels, learners = part[1].to_pylist(), part[2].to_pylist()
        for i, f, v in _rows(part, 0):
            at, first = np.unique(f, return_index=True)
            x = np.add.reduceat(v, first) if len(f) else v
            rows.setdefault(learners[i], []).append((np.append(at, 1 << BITS), np.append(x, 1.0), labels[i]))
    for own in rows.values():
        model = Ftrl()
        for _ in range(EPOCHS):
            for at, x, label in own:
                model.learn(at, x, label)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], 0.0)), pa.array(np.ones(len(at) + 1))], names=["at", "w", "one"])


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; of the empty text for a null."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights, 2**BITS and a bias, from labelled rows outside the held-out fold.

    A document with several labels counts as 1 if most are. Without labelled rows all weights are 0. What reaches the
    driver is bounded by 2**BITS, whatever the data.
    """
    known = labels.filter("quality is not null and doc_id is not null").filter(remainder() != 0).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).filter(F.col("h") < int(share * (1 << 30)))
    rows = texts(docs).join(F.broadcast(known), "doc_id").withColumn("learner", F.col("h") % LEARNERS)
    rows = rows.repartition(LEARNERS, "learner").sortWithinPartitions("h", "doc_id").select("text", "label", "learner")
    found = rows.mapInArrow(_train, "at long, w double, one double").groupBy("at").agg(F.sum("w").alias("w"), F.sum("one").alias("one")).toPandas()
    out, used = np.zeros((1 << BITS) + 1), max(1.0, found.loc[found["at"] == -1, "one"].sum())
    found = found[found["at"] >= 0]
    out[found["at"]] = found["w"] / used
    return out


def _scorer(shared) -> Callable:
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in parts:
            scores = []
            for _, data, offsets in chunks(part[part.schema.get_field_index("_text")]):
                row, f, v = features(data, offsets)
                scores.append(w[-1] + np.bincount(row, w[f] * v, minlength=len(offsets) - 1))
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(scores or [np.zeros(0)]), -30, 30)))
            keep = [c for c in part.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(part[part.schema.get_field_index(c)] for c in keep), pa.array(score)], names=[*keep, "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of each row of docs; a null or empty text scores as the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return texts(docs).withColumnRenamed("text", "_text").mapInArrow(_scorer(shared), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Empty tables give no rows; texts alone are scored."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without rows scored under the threshold, all columns as they are; nothing but the training rows is shuffled."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    fields = [*docs.schema.fields, docs.schema["text"]]
    names = [f"c{i}" for i in range(len(docs.columns))]  # names of other columns can't clash with ours
    renamed = docs.toDF(*names).withColumn("_text", F.coalesce(F.col(names[docs.columns.index("text")]), F.lit("")))
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=False))
    kept = renamed.mapInArrow(_scorer(weights), f"{schema}, score double").filter(F.col("score") >= THRESHOLD)
    return kept.drop("score").toDF(*docs.columns)
