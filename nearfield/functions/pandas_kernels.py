"""Kernels that need dynamic programming or ordered greedy steps: pandas UDFs that treat all pairs of a batch at once.

The tables of the dynamic programs are swept along their anti-diagonals, whose cells do not depend on each
other: one numpy step serves a whole diagonal of every pair of a chunk.  Pairs of like size share a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Pairs of a chunk, and cells of one diagonal over all its pairs.
CHUNK_PAIRS = 2_048
CHUNK_CELLS = 500_000


def _chunks(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of pairs in chunks of like size."""
    order = np.argsort(n + m, kind="stable")
    at = 0
    while at < len(order):
        end = min(at + CHUNK_PAIRS, len(order))
        while end - at > 1 and (end - at) * max(n[order[at:end]].max(), 1) > CHUNK_CELLS:
            end = at + (end - at) // 2
        yield order[at:end]
        at = end


def _padded(rows: Sequence, kind: str) -> np.ndarray:
    out = np.zeros((len(rows), max(1, max((len(r) for r in rows), default=1))), dtype=kind)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _sizes(rows: Sequence) -> np.ndarray:
    return np.array([len(r) for r in rows], dtype="int64")


def _diagonals(n: int, m: int) -> Iterator[tuple[int, int, int]]:
    """(i + j, least i, greatest i) of the inner cells of an n x m table, diagonal after diagonal."""
    for k in range(1, n + m + 1):
        yield k, max(1, k - m), min(n, k - 1)


def align_batch(left: Sequence, right: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Matches and aligned lengths of global alignments with +1 / -1 / -1; ties prefer diagonal, then up, then left.

    Every cell carries the matches and the length of its preferred path, so nothing has to be traced back.
    """
    codes: dict = {}
    numbered: dict = {}  # a row that stands in many pairs is numbered once

    def number(row: Sequence) -> np.ndarray:
        if id(row) not in numbered:
            numbered[id(row)] = np.array([codes.setdefault(x, len(codes) + 1) for x in row], dtype="int32")
        return numbered[id(row)]

    left, right = list(left), list(right)
    a, b = [number(r) for r in left], [number(r) for r in right]
    n, m = _sizes(a), _sizes(b)
    matches, length = np.zeros(len(a), dtype="int64"), np.zeros(len(a), dtype="int64")
    for part in _chunks(n, m):
        x, y = (np.ascontiguousarray(_padded([rows[p] for p in part], "int32").T) for rows in (a, b))
        matches[part], length[part] = _align_columns(x, y, n[part], m[part])
    return matches, length


def _align_columns(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches and lengths of pairs that stand in columns.

    A cell is one number: score, two bits of preference, matches, length, from high to low, so that the largest of
    three is the one that is preferred; 32 bits where they are enough.
    """
    wide, most = len(x), len(x) + len(y)
    bits = int(most).bit_length() + 1
    kind = np.int32 if 3 * bits + 3 <= 32 else np.int64
    point, prefer, hit = 1 << (2 * bits + 2), 1 << (2 * bits), 1 << bits
    up, gain = kind(1 - point + prefer), kind(2 * point + hit)
    diagonal, across, clear = kind(1 - point + 2 * prefer), kind(1 - point), kind(~(3 * prefer))
    last, before, now = (np.zeros((wide + 1, x.shape[1]), dtype=kind) for _ in range(3))
    out = np.zeros(x.shape[1], dtype=kind)
    ends = n + m
    for k, lo, hi in _diagonals(wide, len(y)):
        now[0] = k * (1 - point)  # (0, k)
        if k <= wide:  # (k, 0)
            now[k] = k * (1 - point)
        if lo <= hi:
            step = (x[lo - 1 : hi] == y[k - hi - 1 : k - lo][::-1]) * gain
            step += before[lo - 1 : hi]
            step += diagonal
            np.maximum(step, last[lo - 1 : hi] + up, out=step)
            np.maximum(step, last[lo : hi + 1] + across, out=step)
            np.bitwise_and(step, clear, out=now[lo : hi + 1])
        end = np.flatnonzero(ends == k)
        if len(end):
            out[end] = now[n[end], end]
        before, last, now = last, now, before
    return ((out >> bits) & (hit - 1)).astype("int64"), (out & (hit - 1)).astype("int64")


def dtw_batch(left: Sequence, right: Sequence, window: int | None = None, limit: float = np.inf) -> np.ndarray:
    """Dynamic time warping with absolute differences, within a band of ``window`` (at least the difference of the lengths), over the sum of the lengths; infinite where it exceeds ``limit``."""
    n, m = _sizes(left), _sizes(right)
    out = np.full(len(n), np.inf)
    gap = np.abs(n - m)
    band = np.maximum(np.maximum(n, m) if window is None else window, gap)
    # pairs of one band together: beyond the window it is the difference of their lengths
    kind = np.zeros(len(n), dtype="int64") if window is None else np.where(gap <= window, 0, gap // 4 + 1)
    for c in np.unique(kind):
        here = np.flatnonzero((kind == c) & (n > 0) & (m > 0))
        for local in _chunks(n[here], m[here]):
            part = here[local]
            x, y = (np.ascontiguousarray(_padded([rows[p] for p in part], "float64").T) for rows in (left, right))
            out[part] = _dtw_columns(x, y, n[part], m[part], band[part], limit)
    return out


def _dtw_columns(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, band: np.ndarray, limit: float) -> np.ndarray:
    """Warping distances of pairs that stand in columns; of each diagonal only the cells within the widest band are visited.

    A path meets one of any two neighbouring diagonals: pairs whose least cells there exceed the limit are given up.
    """
    least, most, ends = int(band.min()), int(band.max()), n + m
    last, before, now = (np.full((len(x) + 2, x.shape[1]), np.inf) for _ in range(3))
    last[0] = 0.0  # the empty beginnings, on diagonal 0
    out, place = np.full(x.shape[1], np.inf), np.arange(x.shape[1])
    highest = limit * ends * (1 + 1e-9)
    for k, lo, hi in _diagonals(len(x), len(y)):
        lo, hi = max(lo, -((most - k) // 2)), min(hi, (k + most) // 2)
        if lo <= hi:
            step = x[lo - 1 : hi] - y[k - hi - 1 : k - lo][::-1]
            np.abs(step, out=step)
            reached = np.minimum(last[lo - 1 : hi], last[lo : hi + 1])
            np.minimum(reached, before[lo - 1 : hi], out=reached)
            np.add(step, reached, out=now[lo : hi + 1])
            if least < most:
                apart = np.abs(2 * np.arange(lo, hi + 1) - k)
                for i in np.flatnonzero(apart > least):
                    now[lo + i, band < apart[i]] = np.inf
        now[lo - 1] = np.inf  # what lies beside the visited cells is left of an earlier diagonal
        now[min(hi, len(x)) + 1] = np.inf
        end = np.flatnonzero(ends == k)
        if len(end):
            out[place[end]] = now[n[end], end] / k
        if limit < np.inf and k % 8 == 0 and lo <= hi:
            alive = np.flatnonzero((ends > k) & (np.minimum(now[lo : hi + 1].min(axis=0), last[lo - 1 : hi + 2].min(axis=0)) <= highest))
            if not len(alive):
                break
            if len(alive) < 0.75 * len(place):
                last, before, now, x, y = (v[:, alive] for v in (last, before, now, x, y))
                n, m, band, ends, highest, place = (v[alive] for v in (n, m, band, ends, highest, place))
        before, last, now = last, now, before
    return np.where(out <= limit * (1 + 1e-9), out, np.inf) if limit < np.inf else out


def spectrum_batch(left: Sequence, right: Sequence, tolerance: float = 0.01) -> np.ndarray:
    """Cosine of peak lists ``(mz, intensity)`` whose peaks are matched once each within the tolerance, from low to high mz.

    All pairs of a chunk go through their peaks in step: where the lowest open peaks of both sides match,
    both are used up, else the lower one is passed over.
    """
    a, b = ([sorted(p for p in r if p[1] > 0) for r in rows] for rows in (left, right))
    n, m = _sizes(a), _sizes(b)
    out = np.where((n == 0) & (m == 0), 1.0, 0.0)
    filled = np.flatnonzero((n > 0) & (m > 0))
    for local in _chunks(n[filled], m[filled]):
        part = filled[local]
        mass, strength = ([_padded([[p[f] for p in rows[k]] for k in part], "float64") for rows in (a, b)] for f in (0, 1))
        rows, total = np.arange(len(part)), np.zeros(len(part))
        i, j = np.zeros(len(part), dtype="int64"), np.zeros(len(part), dtype="int64")
        while True:
            open_ = np.flatnonzero((i < n[part]) & (j < m[part]))
            if not len(open_):
                break
            gap = mass[0][open_, i[open_]] - mass[1][open_, j[open_]]
            hit = np.abs(gap) <= tolerance
            total[open_[hit]] += strength[0][open_[hit], i[open_[hit]]] * strength[1][open_[hit], j[open_[hit]]]
            i[open_] += hit | (gap < 0)
            j[open_] += hit | (gap > 0)
        norm = [np.sqrt((s[rows] ** 2).sum(axis=1)) for s in strength]
        out[part] = np.clip(total / (norm[0] * norm[1]), 0.0, 1.0)
    return out


def spectrum_lots(df) -> tuple[np.ndarray, ...]:
    """Peaks of a lot (columns ``mz`` and ``intensity``) by rows: masses and strengths, the row of each, and the rows' norms."""
    mass, strength = (np.concatenate([np.asarray(v, dtype="float64") for v in df[c]]) for c in ("mz", "intensity"))
    row = np.repeat(np.arange(len(df)), [len(v) for v in df["mz"]])
    keep = (strength > 0) & ~np.isnan(mass)
    mass, strength, row = mass[keep], strength[keep], row[keep]
    order = np.lexsort((strength, mass, row))
    mass, strength, row = mass[order], strength[order], row[order]
    by_mass = np.argsort(mass, kind="stable")
    return mass, strength, row, np.sqrt(np.bincount(row, strength**2, len(df))), by_mass, np.searchsorted(row, np.arange(len(df) + 1))


def spectrum_grid(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], tolerance: float = 0.01) -> np.ndarray:
    """:func:`spectrum_batch` of every left with every right row of two lots.

    Walking both lists in step uses up the first open pair of peaks within the tolerance, by left and then right place,
    again and again: so only such pairs are listed, and those of all right rows are gone through at once.
    """
    mass, strength, _, norm, by_mass, _ = right
    sorted_mass, theirs = mass[by_mass], right[2][by_mass]
    out = np.zeros((len(left[3]), len(norm)))
    for q in range(len(out)):
        at, end = left[5][q : q + 2]
        x, w = left[0][at:end], left[1][at:end]
        slack = tolerance + 1e-9 * (1 + np.abs(x))
        lo, hi = np.searchsorted(sorted_mass, x - slack, "left"), np.searchsorted(sorted_mass, x + slack, "right")
        i = np.repeat(np.arange(len(x)), hi - lo)
        place = np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        near = np.abs(x[i] - sorted_mass[place]) <= tolerance
        i, place = i[near], place[near]
        row, j = theirs[place], by_mass[place]  # the right place grows with the mass within a row
        order = np.argsort(row, kind="stable")
        row, i, j = row[order], i[order], j[order]
        # the t-th pair of every row in one step
        first = np.searchsorted(row, np.arange(len(norm)))
        count = np.bincount(row, minlength=len(norm))
        ranks = np.argsort(-count, kind="stable")
        last_i, last_j, total = np.full(len(norm), -1), np.full(len(norm), -1), np.zeros(len(norm))
        for t in range(int(count.max(initial=0))):
            rows = ranks[: np.searchsorted(-count[ranks], -t, "left")]  # those with more than t pairs
            e = first[rows] + t
            ok = (i[e] > last_i[rows]) & (j[e] > last_j[rows])
            rows, e = rows[ok], e[ok]
            total[rows] += w[i[e]] * strength[j[e]]
            last_i[rows], last_j[rows] = i[e], j[e]
        both = norm * left[3][q]
        out[q] = np.where(both > 0, np.clip(np.divide(total, both, out=np.zeros_like(total), where=both > 0), 0.0, 1.0), 0.0)
        if at == end:
            out[q, np.diff(right[5]) == 0] = 1.0
    return out


def _udf(kernel: Callable[[list, list], np.ndarray], convert: Callable = lambda v: v):
    """A UDF of two columns that is null where either side is null and asks the kernel for all other pairs at once."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list = [None] * len(a)
        x, y = a.tolist(), b.tolist()
        both = [k for k in range(len(x)) if x[k] is not None and y[k] is not None]
        if both:
            for k, value in zip(both, kernel([convert(x[k]) for k in both], [convert(y[k]) for k in both]).tolist()):
                out[k] = value
        return pd.Series(out, dtype="object")

    return run


def _identity(a: Sequence, b: Sequence) -> np.ndarray:
    matches, length = align_batch(a, b)
    return np.where(length > 0, matches / np.maximum(length, 1), 1.0)


def _warped(a: Sequence, b: Sequence, form: str, scale: float, window: int | None, limit: float = np.inf) -> np.ndarray:
    d = dtw_batch(a, b, window, limit)
    n, m = _sizes(a), _sizes(b)
    near = np.exp(-d / scale) if form == "exp" else 1 / (1 + d / scale)
    return np.where((n == 0) | (m == 0), np.where(n == m, 1.0, 0.0), near)


def alignment_identity():
    """UDF of two strings or two arrays (K8, K9): matches / aligned length of a global alignment; both empty is 1."""
    return _udf(_identity)


def dtw_similarity(form: str = "exp", scale: float = 1.0, window: int | None = None):
    """UDF of two ``array<double>`` (K10); empty against non-empty is 0, both empty is 1."""
    return _udf(lambda a, b: _warped(a, b, form, scale, window))


def _every(a: list, b: list) -> tuple[list, list]:
    return [x for x in a for _ in b], [y for _ in a for y in b]


def alignment_grid(left: list, right: list) -> np.ndarray:
    """:func:`alignment_identity` of every left with every right row."""
    return _identity(*_every(left, right)).reshape(len(left), len(right))


def dtw_grid(scale: float = 1.0, window: int | None = None, least: float | None = None) -> Callable[[list, list], np.ndarray]:
    """:func:`dtw_similarity` of every left with every right row; with ``least`` (no empty rows), -inf below it.

    First and last values must meet (:func:`advanced.dtw_bound`), so most pairs that are too far apart are not warped at all.
    """

    def score(left: list, right: list) -> np.ndarray:
        if least is None or not 0 < least < 1:
            grid = _warped(*_every(left, right), "exp", scale, window).reshape(len(left), len(right))
            return grid if least is None else np.where(grid >= least, grid, -np.inf)
        ends, sizes = [np.array([(r[0], r[-1]) for r in rows]) for rows in (left, right)], [_sizes(rows) for rows in (left, right)]
        bound = sum(np.abs(ends[0][:, None, k] - ends[1][None, :, k]) for k in (0, 1))
        bound = np.where((sizes[0][:, None] > 1) | (sizes[1][None, :] > 1), bound, bound / 2) / (sizes[0][:, None] + sizes[1][None, :])
        limit = -np.log(least) * scale * (1 + 1e-9)
        grid = np.full(bound.shape, -np.inf)
        i, j = np.nonzero(bound <= limit)
        if len(i):
            near = _warped([left[k] for k in i], [right[k] for k in j], "exp", scale, window, limit)
            grid[i, j] = np.where(near >= least, near, -np.inf)
        return grid

    return score


def spectrum_similarity(tolerance: float = 0.01):
    """UDF of two arrays of peaks (K18); two empty lists are 1, one is 0."""
    return _udf(lambda a, b: spectrum_batch(a, b, tolerance), lambda peaks: [(p["mz"], p["intensity"]) for p in peaks])


def sinkhorn_similarity(epsilon: float = 0.1, rounds: int = 50, scale: float = 1.0):
    """UDF of two histograms (J12): exp(-cost / scale) of entropic transport with cost |i - j|, a whole batch at once.

    Negative parts count as 0; a zero histogram stays zero.
    """

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = np.maximum(np.stack(a.to_numpy()), 0.0), np.maximum(np.stack(b.to_numpy()), 0.0)
        for h in (x, y):
            s = h.sum(axis=1, keepdims=True)
            np.divide(h, s, out=h, where=s > 0)
        n = x.shape[1]
        cost = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :]).astype(float)
        kernel = np.exp(-cost / epsilon)
        u, v = np.ones_like(x), np.ones_like(y)
        for _ in range(rounds):
            u = x / np.maximum(v @ kernel.T, 1e-12)
            v = y / np.maximum(u @ kernel, 1e-12)
        return pd.Series(np.exp(-np.einsum("ri,ij,rj->r", u, kernel * cost, v) / scale))

    return run
