"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter
from math import exp, log, log2, log10

import numpy as np
import xxhash


def sha(b):
    return hashlib.sha256(b).hexdigest()


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {(i, max(g), len(g), i == max(g), sha(t.encode())) for t, g in groups.items() for i in g}


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(codes, most=3):
    """{id: smallest id reached} of {id: code}."""
    ids = sorted(codes)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array([codes[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= most):
            x, y = root(i), root(ids[k + 1 + int(j)])
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near(rows):
    codes = {i: fingerprint(t) for i, t in rows}
    return {(i, f"{codes[i]:016x}", c) for i, c in reachable(codes).items()}


def repeats(rows, n=100):
    seen, out = set(), set()
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = True
            seen.add(b[p : p + n])
        gone = gone[: len(b)]
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.add((i, len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def ascii_lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))


def contaminated(rows, items, n=13):
    windows = {}
    for item, t in items:
        w = words(t)
        for k in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = set()
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= names
        out.add((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


RULES = (
    (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    (r"AKIA[A-Z0-9]+", 0, 18),
    (r"[0-9a-f]+", 0, 16),
)


def secrets(text):
    """base_sha256 and the three counts."""
    spans = []
    for k, (pattern, group, least) in enumerate(RULES):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    kinds = ("assign", "access", "hex")
    listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*[sum(k == x[1] for x in spans) for k in range(3)], sha(listed.encode()))


def unigrams(rows):
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(x for i, ts in tokens.items() if not held[i] for x in ts)
    n, v = sum(c.values()), len(c)
    base = {i: sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts) for i, ts in tokens.items()}
    return {i: (held[i], len(ts), sum(c[x] > 0 for x in ts), n, base[i]) for i, ts in tokens.items()}


MASK = (1 << 64) - 1


def mixed_bits(h):
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & MASK
    h = (h ^ h >> 29) * 0xC2B2AE3D27D4EB4F & MASK
    return h ^ h >> 32


def polynomial(values):
    prime = 0x9E3779B97F4A7C15
    return sum((v + 1) * pow(prime, i, 1 << 64) for i, v in enumerate(values)) & MASK


def token_key(word):
    return mixed_bits(polynomial(word) + len(word) & MASK)


def spelling(counts, code, gates, bins, shards, step, prior, damping):
    """log10 of each token's spelling: the mixer decision by decision, with counts in dictionaries.

    counts: training occurrences by token. code: bits and nodes of each byte. All beginnings are counted in one place.
    """
    slots, tables = {}, [{} for _ in range(4)]

    def decisions(word):
        if word not in slots:
            out, line = [], word + b" "
            for i, byte in enumerate(line):
                last = [line[i - k] if i >= k else 32 for k in (1, 2, 3)]
                two = last[0] | last[1] << 8
                so_far = polynomial(word[:i]) + i & MASK
                for node, bit in code[byte]:
                    salt = node * 0x9E3779B97F4A7C15 & MASK
                    h = [(mixed_bits(x + (k << 60) & MASK) ^ salt) * 0xD6E8FEB86659FD93 & MASK for k, x in ((1, two), (2, two | last[2] << 16), (3, so_far))]
                    out.append((node, bit, (last[0] << 8 | node, h[0] >> 46, h[1] >> 44, (word[:i], node))))
            slots[word] = out
        return slots[word]

    for word, n in counts.items():
        for _, bit, at in decisions(word):
            for table, x in zip(tables, at, strict=True):
                table.setdefault(x, [0, 0])[bit] += n

    def inputs(word, own):
        for node, bit, at in decisions(word):
            n = [table.get(x, [0, 0]) for table, x in zip(tables, at, strict=True)]
            left = [[max(c[b] - own * (b == bit), 0) for b in (0, 1)] for c in n]
            x = np.array([log((c[1] + prior) / (c[0] + prior)) for c in left] + [0.3])
            yield x, min(15, int(log2(max(sum(n[3]) - own, 0) + 1))), node, bit

    start, made = np.tile([0.1, 0.15, 0.3, 0.5, 0.0], (gates, 1)), []
    # a home of its own for each token: no beginning is kept apart where all are common
    home = {w: mixed_bits(token_key(w) + 1 & MASK) for w in counts}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for shard in range(shards):
        words = sorted((w for w in counts if mixed_bits(home[w]) % shards == shard), key=lambda w: (signed(home[w]), w))
        weights, curve, final, at = start.copy(), np.zeros((gates, 5, 5)), np.zeros((256, bins, 2)), 0
        while at < len(words):
            block, width = [], 0
            while at < len(words) and (not block or width < step):
                block.append(words[at])
                width += len(words[at]) + 1
                at += 1
            slope = np.zeros((gates, 5))
            for w in block:
                for x, gate, node, bit in inputs(w, 1):
                    t = min(15, max(-15, float(x @ weights[gate])))
                    p = 1 / (1 + exp(-t))
                    slope[gate] += (bit - p) * counts[w] * x
                    curve[gate] += max(p * (1 - p), 1e-4) * counts[w] * np.outer(x, x)
                    place = (min(7.99, max(-8, t)) + 8) * (bins - 1) / 16
                    final[node, int(place), bit] += counts[w] * (1 - place % 1)
                    final[node, int(place) + 1, bit] += counts[w] * (place % 1)
            for g in range(gates):
                weights[g] += np.linalg.solve(curve[g] + damping * np.eye(5), slope[g])
        if words:
            made.append((len(words), weights, final))
    total = sum(m[0] for m in made)
    weights = sum(n / total * w for n, w, _ in made) if made else start
    final = sum(f for *_, f in made) if made else np.zeros((256, bins, 2))

    def scored(word):
        out = 0.0
        for x, gate, node, bit in inputs(word, 0):
            t = min(15, max(-15, float(x @ weights[gate])))
            place = (min(7.99, max(-8, t)) + 8) * (bins - 1) / 16
            refined = [(final[node, i, 1] + 20 / (1 + exp(8 - i * 16 / (bins - 1)))) / (final[node, i].sum() + 20) for i in (int(place), int(place) + 1)]
            p = 0.5 / (1 + exp(-t)) + 0.5 * (refined[0] * (1 - place % 1) + refined[1] * (place % 1))
            out += log10(min(1, max(1e-7, p if bit else 1 - p)))
        return out

    return scored


def weight_of_second(ratios, rounds=200):
    """Expectation maximization over (times the first's probability, places)."""
    w, total = 0.5, sum(n for _, n in ratios)
    for _ in range(rounds):
        w = sum(n * w * r / (1 - w + w * r) for r, n in ratios) / total
    return w


def language_model(rows, code, gates, bins, shards, step, prior, damping, segment, least):
    """{id: score}: every token and pair is known to all, as on tables small enough."""
    docs = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    train = [d for i, d in docs.items() if not held[i]]
    c1, c2, segs = Counter(w for d in train for w in d), Counter(p for d in train for p in zip([None, *d], d, strict=False)), Counter()
    n, starts = c1.total(), len(train)

    def cut(d):
        """Segments as (first, stop); the end is one of its own."""
        keys = [token_key(w) for w in d]
        at = [k for k in range(len(d)) if k in (0, len(d) - 1) or mixed_bits((keys[k - 1] * 3 + keys[k]) & MASK) % segment == 0]
        return list(zip(at, [*at[1:], len(d)], strict=True))

    for d in train:
        segs.update(tuple(d[a:b]) for a, b in cut(d) if b - a >= least)
    spelled = spelling(dict(c1), code, gates, bins, shards, step, prior, damping)
    s = {w: spelled(w) for d in docs.values() for w in d}
    ratios = Counter()
    for w, c in c1.items():
        ratios[10 ** max(-99.0, min(99.0, round(log10((c - 1) / (n - 1)) - s[w], 1))) if c > 1 else 0.0] += c
    spell = min(max(1 - weight_of_second(ratios.items()), 1e-6), 1 - 1e-6)
    plain = lambda w, own: log10(10 ** (s[w] + log10(spell)) + (1 - spell) * max(c1[w] - own, 0) / (n - own))
    size = lambda p: starts if p is None else c1[p]
    gate = lambda p: int(min(gates - 1, max(0, log2(n / size(p)))))
    places, cells = Counter(), {}
    for p in [None, *c1]:
        if p != b"":
            places[gate(p)] += size(p)
    for (p, q), c in c2.items():
        cells.setdefault(gate(p), []).append(((c - 1) / max(size(p) - 1, 1) / 10 ** plain(q, 1), c))
    weight = {g: min(0.99, weight_of_second([*x, (0.0, max(0, places[g] - sum(c for _, c in x)))])) for g, x in cells.items()}
    copied = (sum(c for c in segs.values() if c > 1) + 1) / (segs.total() + 2)
    out = {}
    for i, d in docs.items():
        own, value = int(not held[i]), []
        for p, q in zip([None, *d], d, strict=False):
            w = weight.get(gate(p), 0.0) if p is None or c1[p] else 0.0
            after = max(c2[p, q] - own, 0) / max(size(p) - own, 1) if w and c1[q] else 0.0
            value.append(log10((1 - w) * 10 ** plain(q, own) + w * after))
        score = 0.0
        for a, b in cut(d):
            elsewhere = segs[tuple(d[a:b])] - own if b - a >= least else -1
            score += sum(value[a:b]) + log10(1 - copied) * (b - a >= least) if elsewhere <= 0 else log10(copied * elsewhere / max(1, segs.total() - own))
        out[i] = score
    return out
