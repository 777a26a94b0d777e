"""Warping distances of batches of series.

Costs go along anti-diagonals: the cells of one depend on the two before alone, so three rolling rows hold a batch whatever
the length of the series, and a batch is as large as a core's cache. Pairs whose cost has passed their limit leave the batch. Paths keep one byte a cell, for the pairs
that need one, in batches of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The bytes that a batch's rolling rows may take (what a core's cache holds), and the steps of its paths.
CACHED, BYTES = 2 << 20, 48 << 20
#: Diagonals between two looks at which pairs have passed their limit.
LOOK = 32


def _diagonals(p: int, q: int) -> Iterator[tuple[int, int, int]]:
    """Number of each anti-diagonal, and its first and last row."""
    for k in range(p + q - 1):
        yield k, max(0, k - q + 1), min(p - 1, k)


def _wide(p: int) -> int:
    """Pairs in a batch."""
    return min(4096, max(128, CACHED // (3 * 8 * (p + 1))))


def _rows(p: int, n: int) -> list[np.ndarray]:
    """Three rolling rows of diagonals; place r + 1 is row r, place 0 stays infinite."""
    rows = [np.empty((p + 1, n)) for _ in range(3)]
    for row in rows:
        row[:2] = np.inf
    return rows


def _squares(a: np.ndarray, back: np.ndarray, k: int, low: int, high: int, out: np.ndarray) -> np.ndarray:
    """Squared differences along a diagonal; a and back are points first, back from the last one on, so it is a stretch of each."""
    q = len(back)
    cost = out[: high - low + 1]
    np.subtract(a[low : high + 1], back[q - 1 - k + low : q - k + high], out=cost)
    return np.multiply(cost, cost, out=cost)


def _closed(new: np.ndarray, low: int, high: int) -> None:
    """Infinite beside a diagonal, where the next two look."""
    new[low] = np.inf
    if high + 2 < len(new):
        new[high + 2] = np.inf


def _advance(rows: list[np.ndarray], cost: np.ndarray, k: int, low: int, high: int) -> None:
    one, two, new = rows[(k - 1) % 3], rows[(k - 2) % 3], rows[k % 3]
    to = new[low + 1 : high + 2]
    if k:
        np.minimum(one[low : high + 1], one[low + 1 : high + 2], out=to)
        np.minimum(to, two[low : high + 1], out=to)
        np.add(to, cost, out=to)
    else:
        to[:] = cost
    _closed(new, low, high)


def crossed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least summed squared cost of warping each row of x to each row of y.

    Some rows of x meet many of y at once, in rolling rows that stay in a core's cache.
    """
    out = np.empty((len(x), len(y)))
    if not out.size:
        return out
    p, q = x.shape[1], y.shape[1]
    wide = min(len(y), _wide(p))
    deep = min(len(x), max(1, _wide(p) // wide))
    for b in range(0, len(y), wide):
        back = np.tile(y[b : b + wide, ::-1].T, deep)
        w = back.shape[1] // deep
        rows, held = _rows(p, back.shape[1]), np.empty((min(p, q), back.shape[1]))
        for at in range(0, len(x), deep):
            a = np.repeat(x[at : at + deep].T, w, axis=1)
            if (n := a.shape[1]) < back.shape[1]:
                back, rows, held = back[:, :n], [row[:, :n] for row in rows], held[:, :n]
            for row in rows:
                row[:2] = np.inf
            for k, low, high in _diagonals(p, q):
                _advance(rows, _squares(a, back, k, low, high, held), k, low, high)
            out[at : at + deep, b : b + w] = rows[(p + q - 2) % 3][p].reshape(-1, w)
    return out


def warped(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """The least summed squared cost of warping x[i] to y[j] for each pair (i, j); infinite where it is above the pair's limit."""
    out = np.full(len(i), np.inf)
    step = _wide(x.shape[1])
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        out[part] = _batch(x, y, i[part], j[part], None if limit is None else limit[part])
    return out


def _batch(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray | None) -> np.ndarray:
    p, q, n = x.shape[1], y.shape[1], len(i)
    out = np.full(n, np.inf)
    alive = np.arange(n)
    a, back = x[i].T.copy(), y[j, ::-1].T.copy()
    rows, held = _rows(p, n), np.empty((min(p, q), n))
    for k, low, high in _diagonals(p, q):
        _advance(rows, _squares(a, back, k, low, high, held), k, low, high)
        if limit is not None and k % LOOK == LOOK - 1:
            before = rows[(k - 1) % 3][max(0, k - q) + 1 : min(p - 1, k - 1) + 2]
            keep = np.minimum(rows[k % 3][low + 1 : high + 2].min(0), before.min(0)) <= limit[alive]
            if keep.sum() < 0.75 * len(alive):
                alive, a, back = alive[keep], a[:, keep], back[:, keep]
                rows, held = [row[:, keep] for row in rows], np.empty((min(p, q), len(alive)))
                if not len(alive):
                    return out
    out[alive] = rows[(p + q - 2) % 3][p]
    return out if limit is None else np.where(out <= limit, out, np.inf)


def paths(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, point of x, point of y of all cells on the best path of each row of x to the same row of y, with the batch's rows
    and their costs; a batch after the other. Of equal steps the diagonal one is taken, then the one along x."""
    p, q = x.shape[1], y.shape[1]
    step = max(1, min(_wide(p), BYTES // (p * q)))
    lows = np.array([low for _, low, _ in _diagonals(p, q)])
    first = np.append(0, np.cumsum([high - low + 1 for _, low, high in _diagonals(p, q)]))[:-1] - lows  # a diagonal's row 0 among all cells
    for at in range(0, len(x), step):
        a, back = x[at : at + step].T.copy(), y[at : at + step, ::-1].T.copy()
        n = a.shape[1]
        rows, held, least = _rows(p, n), np.empty((min(p, q), n)), np.empty((min(p, q), n))
        ways = np.zeros((p * q, n), np.uint8)
        for k, low, high in _diagonals(p, q):
            cost = _squares(a, back, k, low, high, held)
            if k:
                one, two = rows[(k - 1) % 3], rows[(k - 2) % 3][low : high + 1]
                way, of = ways[first[k] + low : first[k] + high + 1], least[: high - low + 1]
                np.greater(one[low : high + 1], one[low + 1 : high + 2], out=way.view(bool))
                np.minimum(one[low : high + 1], one[low + 1 : high + 2], out=of)
                way += 1
                way *= two > of
                np.minimum(of, two, out=of)
                np.add(of, cost, out=rows[k % 3][low + 1 : high + 2])
            else:
                rows[k % 3][low + 1 : high + 2] = cost
            _closed(rows[k % 3], low, high)
        row = np.arange(n)
        i, j, found = np.full(n, p - 1), np.full(n, q - 1), []
        while len(row):
            found.append((row, i, j))
            way = ways[first[i + j] + i, row]
            i, j = i - (way < 2), j - (way != 1)
            going = (i >= 0) & (j >= 0)
            if not going.all():
                row, i, j = row[going], i[going], j[going]
        row, i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        yield row + at, i, j, np.arange(n) + at, rows[(p + q - 2) % 3][p].copy()


def lower_bounds(series: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """A bound below the cost of warping each series to each centre: the ends meet, and every point is at least as far as the
    other's envelope."""
    ends = (series[:, None, 0] - centres[None, :, 0]) ** 2
    if max(series.shape[1], centres.shape[1]) > 1:
        ends = ends + (series[:, None, -1] - centres[None, :, -1]) ** 2
    out = ends
    for a, b, turned in ((series, centres, False), (centres, series, True)):
        low, high = b.min(1), b.max(1)
        outside = np.stack([(np.maximum(0, np.maximum(a - h, l - a)) ** 2).sum(1) for l, h in zip(low, high, strict=True)], 1) if len(b) <= len(a) else np.stack([(np.maximum(0, np.maximum(r[None, :] - high[:, None], low[:, None] - r[None, :])) ** 2).sum(1) for r in a], 0)  # noqa: E741
        out = np.maximum(out, outside.T if turned else outside)
    return out * (1 - 1e-12)


def nearest(series: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each series and its cost; of equal ones the first.

    Centres come in the order of their bounds; those whose bound, or cost so far, is above the best cost known are left. Short
    series are held against all.
    """
    if series.shape[1] + centres.shape[1] <= LOOK:
        costs = crossed(centres, series)
        best = costs.argmin(0)
        return best, costs[best, np.arange(len(series))]
    bound = lower_bounds(series, centres)
    order = bound.argsort(1, kind="stable")
    n = np.arange(len(series))
    best, cost = np.zeros(len(series), np.int64), np.full(len(series), np.inf)
    for rank in range(len(centres)):
        c = order[:, rank]
        ask = n[bound[n, c] <= cost]
        if not len(ask):
            break
        new = warped(series, centres, ask, c[ask], cost[ask])
        better = (new < cost[ask]) | ((new == cost[ask]) & np.isfinite(new) & (c[ask] < best[ask]))
        best[ask[better]], cost[ask[better]] = c[ask[better]], new[better]
    return best, cost
