"""Numeric kernels on one read's or one sample's values, in numpy."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2, block: int = 1024) -> float:
    """ln of templates of m values that match within r standard deviations over those that go on to m + 1; 0 if either is none."""
    x = np.asarray(x, dtype=float)
    n = len(x) - m
    if n < 2:
        return 0.0
    limit = r * np.std(x, ddof=1)
    short = longer = 0
    for begin in range(0, n, block):
        rows = np.arange(begin, min(n, begin + block))
        pair = rows[:, None] < np.arange(n)[None, :]
        for k in range(m):
            pair &= ~(np.abs(x[rows + k][:, None] - x[k : k + n][None, :]) > limit)
        short += int(pair.sum())
        longer += int((pair & (np.abs(x[rows + m][:, None] - x[m : m + n][None, :]) <= limit)).sum())
    return math.log(short / longer) if short and longer else 0.0


def acf(x: np.ndarray, most: int) -> np.ndarray:
    """Autocorrelation at lags 0 to most; NaN for a constant."""
    x = np.asarray(x, dtype=float)
    d = x - x.mean()
    total = d @ d
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.array([d[: len(d) - k] @ d[k:] if k < len(d) else 0.0 for k in range(most + 1)]) / total


def pacf(x: np.ndarray, most: int) -> np.ndarray:
    """Partial autocorrelation at lags 1 to most, by the Durbin-Levinson recursion."""
    r = acf(x, most)
    out, phi = np.zeros(most), np.zeros(0)
    for k in range(1, most + 1):
        last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k])
        phi = np.append(phi - last * phi[::-1], last)
        out[k - 1] = last
    return out


def loess(x: np.ndarray, y: np.ndarray, span: float, at: np.ndarray | None = None) -> np.ndarray:
    """Local quadratic regression with tricube weights over the nearest share `span` of the points.

    A span above 1 widens the farthest distance by that factor. Outside the range of x the result is NaN.
    """
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    at = x if at is None else np.asarray(at, dtype=float)
    n = len(x)
    near = min(n, max(3, int(n * span + 1e-5)))
    out = np.full(len(at), np.nan)
    for i, center in enumerate(at):
        if not x.min() <= center <= x.max():
            continue
        d = np.abs(x - center)
        width = np.partition(d, near - 1)[near - 1] * max(1.0, span)
        inside = d < width * 0.999999 if width else d == 0
        u, w = (x[inside] - center) / (width or 1), (1 - (d[inside] / (width or 1)) ** 3) ** 3
        root = np.sqrt(w)
        design = np.stack([np.ones_like(u), u, u * u], axis=1) * root[:, None]
        out[i] = np.linalg.lstsq(design, y[inside] * root, rcond=None)[0][0]
    return out


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_cdf(t: float, df: float) -> float:
    tail = beta_share(df / (df + t * t), df / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def straight_line(x: np.ndarray, y: np.ndarray) -> dict:
    """Least squares: slope, intercept, confidence interval of the slope at 95 %, R squared and the slope's p-value."""
    n = len(x)
    if n < 2:
        return {"slope": math.nan, "intercept": float(y[0]) if n else math.nan, "low": math.nan, "high": math.nan, "r2": math.nan, "p": math.nan}
    dx, dy = x - x.mean(), y - y.mean()
    slope = float(dx @ dy / (dx @ dx))
    rest = float(((dy - slope * dx) ** 2).sum())
    total = float(dy @ dy)
    out = {"slope": slope, "intercept": float(y.mean() - slope * x.mean()), "r2": 1 - rest / total if total else math.nan}
    if n < 3:
        return out | {"low": math.nan, "high": math.nan, "p": math.nan}
    error = math.sqrt(rest / (n - 2) / float(dx @ dx))
    wide = t_quantile(0.975, n - 2) * error
    return out | {"low": slope - wide, "high": slope + wide, "p": 2 * (1 - t_cdf(abs(slope / error), n - 2)) if error else 0.0}


def estimate_nrl(counts: np.ndarray, mind: int = 140, use_peaks: Sequence[int] = (1, 2, 3, 4, 5), span1: float | None = None, span2: float | None = None) -> dict | None:
    """Nucleosome repeat length from counts of distances 1, 2, ...: slope of the peaks of the de-trended smooth; None, with a warning, if all are 0.

    use_peaks: numbers, from 1, of the peaks that the line is fitted to; of those that there are not, a warning tells.
    """
    counts = np.asarray(counts, dtype=float)
    n = len(counts)
    if not counts.any() or n <= mind + 3:
        warnings.warn("the repeat length is not estimated: there are no distances", stacklevel=2)
        return None
    at = np.arange(1, n + 1)
    used = at > mind
    smooth = loess(at[used], counts[used], 100 / n if span1 is None else span1)
    trend = loess(at[used], smooth, 1500 / n if span2 is None else span2)
    rest = smooth - trend
    edge = np.flatnonzero(np.diff(np.concatenate([[False], rest >= 0, [False]]).astype(int)))
    peaks = np.array([mind + 1 + a + int(np.argmax(rest[a:b])) for a, b in zip(edge[::2], edge[1::2])], dtype=float)
    chosen = np.array(sorted({int(k) for k in use_peaks if k <= len(peaks)}), dtype=int)
    if len(chosen) < len(set(use_peaks)):
        warnings.warn("there are fewer peaks than were chosen", stacklevel=2)
    fit = straight_line(chosen.astype(float), peaks[chosen - 1])
    return {"nrl": fit["slope"], "nrl_low": fit["low"], "nrl_high": fit["high"], "peaks": peaks, "chosen": chosen, "smooth": smooth, "trend": trend, "residual": rest, "first": mind + 1, "fit": fit}


def inverse_bands(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The diagonal of the inverse of a symmetric tridiagonal matrix (diagonal a, next to it b), and the two next to it."""
    n = len(a)
    down, up = a.astype(float).copy(), a.astype(float).copy()
    for i in range(1, n):
        down[i] -= b[i - 1] ** 2 / down[i - 1]
    for i in range(n - 2, -1, -1):
        up[i] -= b[i] ** 2 / up[i + 1]
    main = 1 / (down + up - a)
    first = -b / up[1:] * main[:-1]
    return main, first, -b[1:] / up[2:] * first[:-1]


def solve_bands(main: np.ndarray, first: np.ndarray, second: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solution of a symmetric positive definite system of five diagonals."""
    n = len(main)
    d, l1, l2, z = main.astype(float).tolist(), [0.0] * n, [0.0] * n, y.astype(float).tolist()
    first, second = [*first.tolist(), 0.0], [*second.tolist(), 0.0, 0.0]
    for i in range(n):
        if i >= 1:
            d[i] -= l1[i - 1] ** 2 * d[i - 1]
            z[i] -= l1[i - 1] * z[i - 1]
        if i >= 2:
            d[i] -= l2[i - 2] ** 2 * d[i - 2]
            z[i] -= l2[i - 2] * z[i - 2]
        l1[i] = (first[i] - (l1[i - 1] * l2[i - 1] * d[i - 1] if i else 0.0)) / d[i]
        l2[i] = second[i] / d[i]
    x = [v / w for v, w in zip(z, d)]
    for i in range(n - 2, -1, -1):
        x[i] -= l1[i] * x[i + 1] + (l2[i] * x[i + 2] if i + 2 < n else 0.0)
    return np.array(x)


def smoothing_spline(x: np.ndarray, y: np.ndarray, spar: float = 0.01) -> np.ndarray:
    """A natural cubic smoothing spline at the points themselves; repeated x share the mean of their y. Time and memory grow as the points."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    knots, place, weight = np.unique(x, return_inverse=True, return_counts=True)
    mean = np.bincount(place, y) / weight
    n = len(knots)
    if n < 4:
        return mean[place]
    h = np.diff((knots - knots[0]) / (knots[-1] - knots[0]))
    left, right = 1 / h[:-1], 1 / h[1:]
    mid = -left - right
    r_main, r_first = (h[:-1] + h[1:]) / 3, h[1:-1] / 6
    # second differences times themselves, over the weights and plain
    crossed = lambda v: (left**2 * v[:-2] + mid**2 * v[1:-1] + right**2 * v[2:], mid[:-1] * left[1:] * v[1:-2] + right[:-1] * mid[1:] * v[2:-1], right[:-2] * left[2:] * v[2:-2])
    trace = sum(k * float(a @ b) for k, a, b in zip((1, 2, 2), inverse_bands(r_main, r_first), crossed(np.ones(n))))
    penalty = weight.sum() / trace * 256.0 ** (3 * spar - 1)
    main, first, second = crossed(1 / weight)
    bend = solve_bands(r_main + penalty * main, r_first + penalty * first, penalty * second, left * mean[:-2] + mid * mean[1:-1] + right * mean[2:])
    back = np.zeros(n)
    back[:-2] += left * bend
    back[1:-1] += mid * bend
    back[2:] += right * bend
    return (mean - penalty * back / weight)[place]


def ward_order(d: np.ndarray) -> list[int]:
    """Leaf order of Ward clustering on squared distances; of two that merge, the tighter comes first."""
    n = len(d)
    own = {i: ([i], 0.0) for i in range(n)}
    far = np.asarray(d, dtype=float) ** 2
    np.fill_diagonal(far, np.inf)
    size = np.ones(n)
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(int(np.argmin(far)), far.shape))
        height = far[i, j]
        first, second = sorted((own[i], own.pop(j)), key=lambda c: (c[1], c[0][0]))
        own[i] = (first[0] + second[0], height)
        a, b, c = size[i], size[j], size
        with np.errstate(invalid="ignore"):
            merged = ((a + c) * far[i] + (b + c) * far[j] - c * height) / (a + b + c)
        merged[~np.isfinite(far[i]) | ~np.isfinite(far[j])] = np.inf
        far[i], far[:, i] = merged, merged
        far[j], far[:, j] = np.inf, np.inf
        far[i, i] = np.inf
        size[i] = a + b
    return next(iter(own.values()))[0] if own else []


#: Bins that are laid out densely at a time; share of a sum of squares below which a variance is computed from the values themselves.
DENSE_BINS, LEAST_VARIANCE = 2048, 1e-3


def correlations(one: list[tuple[np.ndarray, np.ndarray]], two: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of common bins, and correlation over these, of each of `one` with each of `two`: (rising bins, values) each.

    The correlation is NaN with fewer than two common bins, or where either is constant. Sums come from products of matrices,
    DENSE_BINS wide; where little of a sum of squares is left, or values are not finite, the pair's own values decide.
    """
    shape = len(one), len(two)
    count, sx, sy, sxx, syy, sxy = (np.zeros(shape) for _ in range(6))
    odd = [np.array([not np.isfinite(v).all() for _, v in x], dtype=bool) for x in (one, two)]
    flat = [[np.repeat(np.arange(len(x)), [len(b) for b, _ in x]), *(np.concatenate(c) if x else np.zeros(0) for c in zip(*x))] if x else None for x in (one, two)]
    if not all(flat):
        return count, np.full(shape, np.nan)
    wanted = np.intersect1d(flat[0][1], flat[1][1])
    for k in range(0, len(wanted), DENSE_BINS):
        bins, dense = wanted[k : k + DENSE_BINS], []
        for (row, at, value), n in zip(flat, shape):
            place = np.minimum(np.searchsorted(bins, at), len(bins) - 1)
            own = bins[place] == at
            there, v = np.zeros((n, len(bins))), np.zeros((n, len(bins)))
            there[row[own], place[own]] = 1
            v[row[own], place[own]] = np.where(np.isfinite(value[own]), value[own] - 0.5, 0)
            dense.append((there, v))
        (pa, va), (pb, vb) = dense
        count += pa @ pb.T
        sx += va @ pb.T
        sy += pa @ vb.T
        sxy += va @ vb.T
        sxx += (va * va) @ pb.T
        syy += pa @ (vb * vb).T
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = sxx - sx * sx / count, syy - sy * sy / count
        r = (sxy - sx * sy / count) / np.sqrt(vx * vy)
        unsure = (vx < LEAST_VARIANCE * sxx) | (vy < LEAST_VARIANCE * syy) | (sxx == 0) | (syy == 0) | odd[0][:, None] | odd[1][None]
    r[count < 2] = np.nan
    for i, j in zip(*np.nonzero(unsure & (count >= 2))):
        _, a, b = np.intersect1d(one[i][0], two[j][0], assume_unique=True, return_indices=True)
        x, y = one[i][1][a], two[j][1][b]
        if (x == x[0]).all() or (y == y[0]).all():
            r[i, j] = np.nan
            continue
        x, y = x - x.mean(), y - y.mean()
        r[i, j] = (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())
    return count, r


def ward_order_of(far: np.ndarray, n: int) -> list[int]:
    """As `ward_order`, of squared distances as one row over (0, 1), (0, 2) and so on, which are overwritten and may lie in a file.

    A chain of nearest neighbours ends at two that are nearest to each other; Ward's merges of these, in any order, make the
    same tree as merging the nearest of all at a time, but for ties.
    """
    begin = np.arange(n, dtype=np.int64)
    begin = begin * n - begin * (begin + 1) // 2 - begin - 1  # the place of (i, j) is begin[i] + j
    own = {i: ([i], 0.0) for i in range(n)}
    size, active, chain = np.ones(n), np.arange(n), []

    def places(i: int) -> np.ndarray:
        cut = np.searchsorted(active, i)
        return np.concatenate([begin[active[:cut]] + i, [-1], begin[i] + active[cut + 1 :]])

    def row_of(i: int) -> tuple[np.ndarray, np.ndarray]:
        at = places(i)
        row = far[at]
        row[at < 0] = np.inf
        return at, row

    while len(active) > 1:
        if not chain:
            chain.append(int(active[0]))
        i = chain[-1]
        at, row = row_of(i)
        k = int(np.argmin(row))
        if len(chain) < 2 or row[k] < row[np.searchsorted(active, chain[-2])]:
            chain.append(int(active[k]))
            continue
        del chain[-1]
        i, j = sorted((i, chain.pop()))
        while i in chain or j in chain:  # by rounding alone
            chain.pop()
        (at, near), (_, other) = row_of(i), row_of(j)
        a, b, c = size[i], size[j], size[active]
        height = float(near[np.searchsorted(active, j)])
        first, second = sorted((own[i], own.pop(j)), key=lambda c: (c[1], c[0][0]))
        own[i] = (first[0] + second[0], height)
        keep = (active != i) & (active != j)
        far[at[keep]] = (((a + c) * near + (b + c) * other - c * height) / (a + b + c))[keep]
        size[i] = a + b
        active = active[active != j]
    return next(iter(own.values()))[0] if own else []
