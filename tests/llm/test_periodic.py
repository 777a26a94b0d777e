"""Runs of words against all lags of all words, and the query's digests."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from rillspark.llm import periodic


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = None
        for t in range(len(words) - q + 1):
            if t + q < len(words) and words[t] == words[t + q]:
                start = t if start is None else start
            elif start is not None:
                if t - start + q >= max(6, 4 * q):
                    found.setdefault((start, t - start + q), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def repetitive(rng, words):
    out = []
    for _ in range(rng.randint(0, 6)):
        base = [str(rng.randrange(words)) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 48, 64, 65, 129]))]
        out += (base * 8)[: int(len(base) * rng.uniform(0.5, 7))]
        out += [str(rng.randrange(words)) for _ in range(rng.choice([0, 0, 1, 20]))]
    return out


@pytest.mark.parametrize("words", [1, 2, 3, 60])
def test_runs_against_all_lags(words):
    rng = random.Random(words)
    documents = [[w.encode() for w in repetitive(rng, words)] for _ in range(150)]
    assert periodic.runs_of_documents(documents) == [plain_runs(d) for d in documents]


def test_runs_do_not_cross_documents():
    assert periodic.runs_of_documents([[b"a"] * 3, [b"a"] * 3, [], [b"a"] * 6]) == [[], [], [], [(0, 6, 1)]]


@pytest.mark.parametrize("block", [1, 4 << 20])
def test_report(spark, monkeypatch, block):
    monkeypatch.setattr(periodic, "BLOCK_BYTES", block)
    rng = random.Random(3)
    rows = [(i, " ".join(repetitive(rng, 4))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b "), (203, "a\u00a0b " * 9), (204, "x " * 5), (205, "x " * 6), (206, "ä ö " * 4), (None, "y " * 40), (7, rows[7][1]), (300, "p q r " * 4000), (301, "long" * 20000)]
    table = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, start string, period int").repartition(3)
    got = sorted((tuple(r) for r in periodic.collapse_runs(table, periodic.planted).collect()), key=str)
    short = [r for r in rows if len(r[1] or "") < 9000]
    want = [plain_report(*r) for r in short]
    assert [r for r in got if r[0] not in (300, 301)] == sorted(want, key=str)
    assert sum(r[0] == 300 for r in got) == sum(r[0] == 301 for r in got) == 1
    assert periodic.collapse_runs(table.limit(0)).count() == 0
    plain = sorted(tuple(r) for r in periodic.find_runs(table.filter("doc_id in (205, 300)")).collect())
    assert plain == [(205, 0, 6, 1), (300, 0, 12000, 3)]
