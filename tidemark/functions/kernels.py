"""Numpy kernels for one series or for a block of sliding windows; small helpers of the grouped operators."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd


def recurrence(x: np.ndarray, keep: float) -> np.ndarray:
    """s[t] = keep * s[t - 1] + x[t]."""
    if keep == 1 or len(x) < 2:
        return np.cumsum(x)
    scaled = x / (1 - keep)
    scaled[0] = x[0]
    return pd.Series(scaled).ewm(alpha=1 - keep, adjust=False).mean().to_numpy()


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean with alpha 2 / (n + 1), started by the plain mean of the first n values; null before."""
    s = pd.Series(x, dtype=float)
    if len(s) < n:
        return np.full(len(s), np.nan)
    seeded = s.copy()
    seeded.iloc[: n - 1] = np.nan
    seeded.iloc[n - 1] = s.iloc[:n].mean()
    return seeded.ewm(span=n, adjust=False).mean().to_numpy()


def rma(x: np.ndarray, n: int) -> np.ndarray:
    """Weighted mean with alpha 1 / n over all values so far (weights normalised), null before n values."""
    return pd.Series(x, dtype=float).ewm(alpha=1 / n, min_periods=n).mean().to_numpy()


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray, first: float = math.nan) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    out = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    if len(out):
        out[0] = first if math.isnan(first) else high[0] - low[0]
    return out


def atr(high, low, close, n: int = 14) -> np.ndarray:
    return rma(true_range(high, low, close), n)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    change = pd.Series(close, dtype=float).diff()
    up, down = rma(change.clip(lower=0), n), rma(change.clip(upper=0), n)
    with np.errstate(all="ignore"):
        return 100 * up / (up + np.abs(down))


def adx(high, low, close, n: int = 14) -> np.ndarray:
    up = np.diff(high, prepend=np.nan)
    down = -np.diff(low, prepend=np.nan)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    with np.errstate(all="ignore"):
        scale = 100 / atr(high, low, close, n)
        p, m = scale * rma(plus, n), scale * rma(minus, n)
        return rma(100 * np.abs(p - m) / (p + m), n)


def cusum(z: np.ndarray, k: float) -> np.ndarray:
    """1 where a running sum of z above or below zero passes k; both sums then start anew, as they do at unknown z."""
    return cusum_from(z, k)[0]


def cusum_from(z: np.ndarray, k: float, up: float = 0.0, down: float = 0.0) -> tuple[np.ndarray, float, float]:
    """cusum with the sums that earlier rows left, and the sums that it leaves."""
    out = np.zeros(len(z), np.int8)
    for i, v in enumerate(z.tolist()):
        if v != v:
            up = down = 0.0
            continue
        up, down = max(0.0, up + v), min(0.0, down + v)
        if up > k or down < -k:
            out[i] = 1
            up = down = 0.0
    return out, up, down


def cusum_filter_from(change: np.ndarray, limit: np.ndarray, up: float = 0.0, down: float = 0.0) -> tuple[np.ndarray, float, float]:
    """Symmetric filter: 1 where the sum of changes passes the limit up or down; only that side starts anew. Takes the sums
    that earlier rows left and gives those that it leaves."""
    out = np.zeros(len(change), np.int8)
    for i, (v, h) in enumerate(zip(change.tolist(), limit.tolist(), strict=True)):
        if v != v or h != h:
            continue
        up, down = max(0.0, up + v), min(0.0, down + v)
        if down < -h:
            out[i], down = 1, 0.0
        elif up > h:
            out[i], up = 1, 0.0
    return out, up, down


# windows: arrays of shape (rows, width), NaN where a value is missing ------------------------------------------------


def range_shares(windows: np.ndarray, bins: int) -> np.ndarray:
    """Shares of each window's values in equal bins over its own range; an empty range is one bin."""
    known = ~np.isnan(windows)
    with np.errstate(all="ignore"):
        low, high = np.nanmin(windows, 1, keepdims=True), np.nanmax(windows, 1, keepdims=True)
        place = np.where(high > low, (windows - low) / (high - low) * bins, bins // 2)
    at = np.where(known, np.clip(np.nan_to_num(place), 0, bins - 1), 0).astype(np.int64)
    flat = at + np.arange(len(windows))[:, None] * bins
    counts = np.bincount(flat.ravel(), known.ravel(), minlength=len(windows) * bins).reshape(-1, bins)
    with np.errstate(all="ignore"):
        return counts / counts.sum(1, keepdims=True)


def shannon(shares: np.ndarray) -> np.ndarray:
    """Entropy in bits of each row."""
    with np.errstate(all="ignore"):
        out = -np.where(shares > 0, shares * np.log2(shares), 0).sum(1)
    return np.where(np.isnan(shares[:, 0]), np.nan, out)


def renyi(shares: np.ndarray, q: float) -> np.ndarray:
    """Entropy of order q in nats; Shannon's near 1."""
    if abs(q - 1) < 1e-9:
        return shannon(shares) * math.log(2)
    with np.errstate(all="ignore"):
        return np.log(np.where(shares > 0, shares**q, 0).sum(1)) / (1 - q)


def _matches(window: np.ndarray, m: int, share: float) -> list[np.ndarray]:
    """Which templates of length m, and of m + 1, are within r (a share of the window's deviation) of each other by their
    largest difference; nothing where r is 0 or a value is missing."""
    r = share * window.std(ddof=1)
    if not r > 0:
        return []
    near, out = np.abs(window[:, None] - window[None, :]) <= r, []
    for size in (m, m + 1):
        n = len(window) - size + 1
        both = near[:n, :n].copy()
        for k in range(1, size):
            both &= near[k : k + n, k : k + n]
        out.append(both)
    return out


def approximate_entropy(windows: np.ndarray, m: int = 2, share: float = 0.2) -> np.ndarray:
    def one(x: np.ndarray) -> float:
        phi = [np.log(near.mean(1)).mean() for near in _matches(x, m, share)]
        return phi[0] - phi[1] if phi else math.nan

    return np.array([one(x) for x in windows])


def sample_entropy(windows: np.ndarray, m: int = 2, share: float = 0.2) -> np.ndarray:
    """-ln(A / B) without self-matches; unknown where either is 0."""

    def one(x: np.ndarray) -> float:
        found = _matches(x, m, share)
        if not found:
            return math.nan
        n = len(x) - m
        b, a = found[0][:n, :n].sum() - n, found[1].sum() - n
        return -math.log(a / b) if a > 0 and b > 0 else math.nan

    return np.array([one(x) for x in windows])


def lz_entropy_rate(codes: list[int], letters: int) -> float:
    """Entropy rate (nats) from match lengths: at each place the shortest string not seen from the `length` places before."""
    n = len(codes)
    if n < 2:
        return math.nan
    text, total = "".join(map(chr, codes)), 0
    for i in range(n):
        length = 1
        while i + length <= n and text.find(text[i : i + length], max(0, i - length), i + length - 1) >= 0:
            length += 1
        total += length
    return n * math.log(n, letters) / total * math.log(letters)


def lz_entropy(windows: np.ndarray, letters: int = 3) -> np.ndarray:
    return np.array([math.nan if np.isnan(x).any() else lz_entropy_rate((np.sign(x) + 1).astype(int).tolist(), letters) for x in windows])


def adf_t(y: np.ndarray, lags: int = 0, constant: bool = False, trend: bool = False) -> float:
    """t value of rho in dy = rho y(-1) [+ constant] [+ trend] [+ lagged dy]."""
    d = np.diff(y)
    n = len(d) - lags
    columns = [y[lags:-1]]
    columns += [d[lags - j - 1 : lags - j - 1 + n] for j in range(lags)]
    columns += [np.ones(n)] if constant else []
    columns += [np.arange(n, dtype=float)] if trend else []
    x, z = np.stack(columns, 1), d[lags:]
    if n <= x.shape[1]:
        return math.nan
    beta, *_ = np.linalg.lstsq(x, z, rcond=None)
    rest = z - x @ beta
    scale = rest @ rest / (n - x.shape[1])
    inverse = np.linalg.pinv(x.T @ x)
    error = math.sqrt(max(scale * inverse[0, 0], 0))
    return beta[0] / error if error > 0 else math.nan


def t_of_products(upper: np.ndarray, k: int, n: int) -> float:
    """t value of the first regressor from the products of all k columns (the last is what is explained) over n rows, given
    as the upper triangle by rows."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = upper
    m = m + np.triu(m, 1).T
    x, xy = m[:-1, :-1], m[:-1, -1]
    if n <= k - 1:
        return math.nan
    inverse = np.linalg.pinv(x, hermitian=True)
    beta = inverse @ xy
    rest = max(m[-1, -1] - beta @ xy, 0.0)
    error = math.sqrt(max(rest / (n - k + 1) * inverse[0, 0], 0.0))
    return float(beta[0] / error) if error > 0 else math.nan


def sadf(y: np.ndarray, least: int, lags: int = 0, constant: bool = False, trend: bool = False) -> float:
    """The largest ADF t value over all starts that leave `least` values to the end."""
    scores = [adf_t(y[s:], lags, constant, trend) for s in range(0, len(y) - least + 1)]
    scores = [s for s in scores if s == s]
    return max(scores) if scores else math.nan


# kernels over all earlier values of a series: results at rows first.. of y ------------------------------------------


def csw_references(y: np.ndarray, two_sided: bool = False) -> np.ndarray:
    """Which rows can be the best reference of a row after all of y. A rise is largest over its root from a row below all
    later ones (any other has a later one at most as high); where there is no rise, from a row below all earlier ones. Of
    falls (two_sided) it is a row above all later ones."""
    low, high = np.where(np.isnan(y), np.inf, y), np.where(np.isnan(y), -np.inf, y)
    after = lambda least, x, end: least.accumulate(np.append(x[1:], end)[::-1])[::-1]
    out = (low < np.minimum.accumulate(np.append(np.inf, low[:-1]))) | (low < after(np.minimum, low, np.inf))
    return out | (high > after(np.maximum, high, -np.inf)) if two_sided else out


def squared_changes(y: np.ndarray) -> tuple[float, int]:
    """Sum and number of the known squared changes from one row to the next."""
    change = np.diff(y)
    known = ~np.isnan(change)
    return float((change[known] ** 2).sum()), int(known.sum())


def mean_squares(y: np.ndarray, first: int = 0, before: tuple[float, int] | None = None) -> np.ndarray:
    """Squared changes up to each row over their number less one; before as in csw."""
    change = np.diff(y, prepend=np.nan) ** 2
    if before is not None:
        change[:first] = np.nan
    known = ~np.isnan(change)
    sums, number = before or (0.0, 0)
    sums, number = np.where(known, change, 0).cumsum() + sums, known.cumsum() + number
    with np.errstate(all="ignore"):
        return np.where(number > 1, sums / (number - 1), np.nan)


def csw(y: np.ndarray, first: int = 0, block: int = 256, ends: int = 256, two_sided: bool = False, before: tuple[float, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chu-Stinchcombe-White statistic over every earlier row, and the distance to the row that gives it (the farthest
    of equals). Blocks of rows are skipped only where their extremes at their nearest distance cannot reach the best.
    before: sum and number of the squared changes up to row first - 1, where y lacks rows before first that are no
    references."""
    n, mean_square = len(y), mean_squares(y, first, before)
    stat, distance = np.full(n - first, np.nan), np.full(n - first, np.nan)
    for a in range(first, n, ends):
        b = min(a + ends, n)
        t, at = y[a:b], np.arange(a, b)
        best, far = np.full(b - a, -np.inf), np.zeros(b - a)

        def take(rows: np.ndarray, lo: int, hi: int) -> None:
            back = at[rows, None] - np.arange(lo, hi)
            with np.errstate(all="ignore"):
                departure = t[rows, None] - y[lo:hi]
                score = np.where(back > 0, (np.abs(departure) if two_sided else departure) / np.sqrt(back), np.nan)
            score = np.where(np.isnan(score), -np.inf, score)
            j = score.argmax(1)
            top = score[np.arange(len(rows)), j]
            better = (top > best[rows]) | ((top == best[rows]) & (top > -np.inf))  # blocks come from near to far
            best[rows[better]], far[rows[better]] = top[better], back[np.arange(len(rows)), j][better]

        whole = a // block
        take(np.arange(b - a), whole * block, b)
        if whole:
            past = y[: whole * block].reshape(whole, block)
            empty = np.isnan(past).all(1)
            low, high = np.where(np.isnan(past), np.inf, past).min(1), np.where(np.isnan(past), -np.inf, past).max(1)
            low, high = np.where(empty, np.nan, low), np.where(empty, np.nan, high)
            nearest = np.sqrt(at[:, None] - (np.arange(whole) * block + block - 1))
            rise = t[:, None] - low
            bound = np.maximum(np.abs(rise), np.abs(t[:, None] - high)) / nearest if two_sided else rise / np.where(rise > 0, nearest, np.sqrt(at[:, None] - np.arange(whole) * block))
            for k in range(whole - 1, -1, -1):
                rows = np.flatnonzero(bound[:, k] >= best)
                if len(rows):
                    take(rows, k * block, (k + 1) * block)
        s = mean_square[a:b]
        ready = (best > -np.inf) & (s > 0)
        stat[a - first : b - first][ready] = best[ready] / s[ready]
        distance[a - first : b - first][ready] = far[ready]
    return stat, distance


def sadf_ends(y: np.ndarray, first: int, least: int, lags: int = 0, constant: bool = False, trend: bool = False) -> np.ndarray:
    """sadf over all starts from the beginning of y, for each end; missing values are left out.

    The products of a window's rows are sums that grow from its end to its start; regressors are swept out in turn.
    Windows whose products are close to singular are fitted one by one.
    """
    if trend and not constant:
        raise ValueError("a trend needs a constant")
    known = ~np.isnan(y)
    place, y, out = np.flatnonzero(known), y[known], np.full(len(known) - first, np.nan)
    d = np.diff(y)
    for e in np.flatnonzero(place >= first):
        if e + 1 < least or e - lags < 1:
            continue
        i = np.arange(e - 1, lags - 1, -1)  # rows of d from the end back
        level = y[e] if constant else 0.0  # a shift that the constant takes up
        columns = [np.ones(len(i))] if constant else []
        columns += [(i - e) / len(d)] if trend else []
        columns += [d[i - j] for j in range(1, lags + 1)]
        columns += [y[i] - level, d[i]]
        k = len(columns) - 1
        m = {(p, q): (columns[p] * columns[q]).cumsum()[max(0, least - lags - 2) :] for p in range(k + 1) for q in range(p, k + 1)}
        size = np.arange(len(i))[max(0, least - lags - 2) :] + 1
        whole = {p: m[p, p] for p in range(k + 1)}
        weak = np.zeros(len(size), bool)
        with np.errstate(all="ignore"):
            for p in range(k):
                weak |= ~(m[p, p] > 1e-9 * whole[p])
                if p < k - 1:
                    for q in range(p + 1, k + 1):
                        share = m[p, q] / m[p, p]
                        for r in range(q, k + 1):
                            m[q, r] = m[q, r] - share * m[p, r]
            rho = m[k - 1, k] / m[k - 1, k - 1]
            rest = m[k, k] - rho * m[k - 1, k]
            weak |= ~(rest > 1e-9 * whole[k])
            t = rho / np.sqrt(rest / (size - k) / m[k - 1, k - 1])
        t[size <= k] = np.nan
        for w in np.flatnonzero(weak & (size > k)):
            t[w] = adf_t(y[e - lags - size[w] : e + 1], lags, constant, trend)
        if not np.isnan(t).all():
            out[place[e] - first] = np.nanmax(t)
    return out


def adf_rows(y: np.ndarray, lags: int, constant: bool, trend: bool, level: float, origin: float, scale: float) -> np.ndarray:
    """Regressors and what they explain, one row a fit's row: [constant, trend,] lagged changes, y less level (with a constant,
    which takes that up), change. Rows begin after `lags` changes; the trend is (row - origin) / scale."""
    d = np.diff(y)
    i = np.arange(lags, len(d))
    columns = [np.ones(len(i))] if constant else []
    columns += [(i - lags - origin) / scale] if trend else []
    columns += [d[i - j] for j in range(1, lags + 1)]
    return np.stack([*columns, y[i] - (level if constant else 0.0), d[i]])


def moved(products: np.ndarray, shift: float, later: float, trend: bool) -> np.ndarray:
    """Products of adf_rows (with a constant) as they are with y higher by shift and the trend by later."""
    a = np.eye(len(products))
    a[-2, 0] = shift
    if trend:
        a[1, 0] = later
    return a @ products @ a.T


def sadf_between(ends: np.ndarray, starts: np.ndarray, between: np.ndarray, gap: int, least: int, lags: int = 0, constant: bool = False, trend: bool = False) -> np.ndarray:
    """The largest ADF t value for each end in one block over all starts in an earlier one. `ends` and `starts` are the blocks'
    values (with the lags + 1 values of the next block that their last rows need), gap is the rows from the first of
    starts to the first of ends, between the products of all rows in the blocks between, as adf_rows(ends) has them.

    Products grow from the end block's first row to both sides and are never differences of sums. Where they are close to
    singular, a window of these two blocks is fitted by itself; one with blocks between, of which only the products are
    here, by their pseudo-inverse. (Where values lie on a straight line and a fit leaves no residuals, t is rounding noise
    in any form.)
    """
    level, size = ends[lags], float(len(starts))
    after = adf_rows(ends, lags, constant, trend, level, 0.0, size)
    before = adf_rows(starts, lags, constant, trend, level, float(gap), size)
    k = len(after) - 1
    pairs = [(p, q) for p in range(k + 1) for q in range(p, k + 1)]
    grown = {(p, q): (before[p] * before[q])[::-1].cumsum()[::-1] + between[p, q] for p, q in pairs}
    added = {(p, q): (after[p] * after[q]).cumsum() for p, q in pairs}
    out = np.full(after.shape[1], np.nan)
    for b in range(after.shape[1]):
        rows = gap + b + 1 - np.arange(before.shape[1])
        m = {pq: grown[pq] + added[pq][b] for pq in pairs}
        whole, weak = {p: m[p, p] for p in range(k + 1)}, np.zeros(len(rows), bool)
        with np.errstate(all="ignore"):
            for p in range(k):
                weak |= ~(m[p, p] > 1e-9 * whole[p])
                if p < k - 1:
                    for q in range(p + 1, k + 1):
                        share = m[p, q] / m[p, p]
                        for r in range(q, k + 1):
                            m[q, r] = m[q, r] - share * m[p, r]
            rho = m[k - 1, k] / m[k - 1, k - 1]
            rest = m[k, k] - rho * m[k - 1, k]
            weak |= ~(rest > 1e-9 * whole[k])
            t = rho / np.sqrt(rest / (rows - k) / m[k - 1, k - 1])
        short = (rows <= k) | (rows < max(1, least - lags - 1))
        t[short] = np.nan
        for w in np.flatnonzero(weak & ~short):
            if gap == len(starts) - lags - 1:  # neighbours
                t[w] = adf_t(np.concatenate([starts[w:gap], ends[: b + lags + 2]]), lags, constant, trend)
            else:
                full = np.array([[grown[min(p, q), max(p, q)][w] + added[min(p, q), max(p, q)][b] for q in range(k + 1)] for p in range(k + 1)])
                plain = np.eye(k + 1)  # y itself and a trend of 0, 1, ..., as adf_t has them: a singular fit depends on that
                if constant:
                    plain[k - 1, 0] = level
                if trend:
                    plain[1, :2] = gap - w, size
                order = [k - 1, *range(int(constant) + int(trend), k - 1), *range(int(constant) + int(trend)), k]
                full = (plain @ full @ plain.T)[np.ix_(order, order)]
                t[w] = t_of_products(full[np.triu_indices(k + 1)], k + 1, int(rows[w]))
        if not np.isnan(t).all():
            out[b] = np.nanmax(t)
    return out


# kernels along one series --------------------------------------------------------------------------------------------


def rolling_moments(x: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Number of known values, mean and sums of the second to fourth powers about it, over the last `width` rows of each row
    (unknown before there are so many rows). Blocks of `width` rows are added up once from both ends; each window is the
    end of one block and the start of the next, whose moments merge, so the time does not depend on the width."""
    n, blocks = len(x), -(-len(x) // width)
    padded = np.full(blocks * width, np.nan)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    known = ~np.isnan(padded)
    centre = np.nanmedian(np.where(known.any(1)[:, None], padded, 0.0), axis=1)[:, None]  # near most values, whatever the outliers
    d = np.where(known, padded - centre, 0.0)
    powers = [known.astype(float), d, d * d, d**3, d**4]

    def central(sums: list[np.ndarray]) -> list[np.ndarray]:
        count, s1, s2, s3, s4 = sums
        m = s1 / np.maximum(count, 1)
        return [count, centre + m, s2 - count * m * m, s3 - 3 * m * s2 + 2 * count * m**3, s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * count * m**4]

    starts = [v.ravel() for v in central([p.cumsum(1) for p in powers])]
    ends = [v.ravel() for v in central([p[:, ::-1].cumsum(1)[:, ::-1] for p in powers])]
    at = np.arange(width - 1, n)
    first = at - width + 1
    whole = first % width == 0  # a block of its own
    a, b = [v[first] for v in ends], [np.where(whole, 0.0, v[at]) for v in starts]
    total = a[0] + b[0]
    with np.errstate(all="ignore"):
        gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
        share = gap / np.maximum(total, 1)
        mean = np.where(a[0] > 0, a[1] + share * b[0], b[1])
        second = a[2] + b[2] + gap * share * a[0] * b[0]
        third = a[3] + b[3] + gap * share * share * a[0] * b[0] * (a[0] - b[0]) + 3 * share * (a[0] * b[2] - b[0] * a[2])
        fourth = a[4] + b[4] + gap * share**3 * a[0] * b[0] * (a[0] ** 2 - a[0] * b[0] + b[0] ** 2) + 6 * share**2 * (a[0] ** 2 * b[2] + b[0] ** 2 * a[2]) + 4 * share * (a[0] * b[3] - b[0] * a[3])
    return tuple(np.concatenate([np.full(min(width - 1, n), np.nan), v]) for v in (total, mean, second, third, fourth))


def skewness_kurtosis(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bias-corrected skewness and excess kurtosis of full windows; unknown where all values of one are equal."""
    n, _, second, third, fourth = rolling_moments(x, width)
    row = np.arange(len(x))
    equal_since = np.maximum.accumulate(np.where(np.append(True, x[1:] != x[:-1])[: len(x)], row, 0)) if len(x) else row
    with np.errstate(all="ignore"):
        ready = (n == width) & (second > 0) & (row - equal_since + 1 < width)
        skew = np.where(ready, width**0.5 * third / second**1.5 * (width * (width - 1)) ** 0.5 / (width - 2), np.nan)
        excess = width * fourth / second**2 - 3
        kurtosis = np.where(ready, ((width + 1) * excess + 6) * (width - 1) / ((width - 2) * (width - 3)), np.nan)
    return skew, kurtosis


def rolling_quantiles(x: np.ndarray, width: int, shares: Sequence[float]) -> list[np.ndarray]:
    """Interpolated quantiles of full windows. One sorted window is kept up to date along the series: each row puts one value
    in and takes one out, and nothing is sorted anew."""
    out, window, values = [np.full(len(x), np.nan) for _ in shares], [], x.tolist()
    places = [(int(s * (width - 1)), s * (width - 1) % 1) for s in shares]
    for i, v in enumerate(values):
        if v == v:
            insort(window, v)
        if i >= width and values[i - width] == values[i - width]:
            del window[bisect_left(window, values[i - width])]
        if len(window) == width:
            for found, (low, part) in zip(out, places, strict=True):
                found[i] = window[low] + part * (window[low + 1] - window[low]) if part else window[low]
    return out


class FirstOver:
    """Finds, for every row, how many rows later a series first reaches a level: blocks of 2, 4, 8 ... rows know their
    maxima, and all rows climb and descend this tree at once, so no row looks at its path."""

    def __init__(self, x: np.ndarray):
        self.n, self.maxima, self.starts = len(x), [np.where(np.isnan(x), -np.inf, x)], [0]
        while len(self.maxima[-1]) > 1:
            last = self.maxima[-1]
            last = np.append(last, -np.inf) if len(last) % 2 else last
            self.maxima.append(np.maximum(last[::2], last[1::2]))
        self.flat = np.concatenate([np.append(m, -np.inf) for m in self.maxima])
        sizes = [len(m) + 1 for m in self.maxima]
        self.starts, self.sizes = np.cumsum([0, *sizes[:-1]]), np.array(sizes) - 1

    def after(self, level: np.ndarray, most: int) -> np.ndarray:
        """Rows from each row to the first later one at or over its level; 0 where none of the next `most` is, or the level
        is unknown."""
        out = np.zeros(self.n, np.int64)
        row = np.flatnonzero(~np.isnan(level))
        depth, block = np.zeros(len(row), np.int64), row + 1
        while len(row):
            inside = (block < self.sizes[depth]) & ((block << depth) - row <= most)
            row, depth, block = row[inside], depth[inside], block[inside]
            hit = self.flat[self.starts[depth] + block] >= level[row]
            done = hit & (depth == 0)
            out[row[done]] = block[done] - row[done]
            up = ~hit & (block % 2 == 1) & (depth + 1 < len(self.sizes))
            block = np.where(hit, block * 2, np.where(up, (block + 1) >> 1, block + 1))
            depth = np.where(hit, depth - 1, np.where(up, depth + 1, depth))
            row, depth, block = row[~done], depth[~done], block[~done]
        return np.where(out > most, 0, out)


def trend_scans(y: np.ndarray, at: np.ndarray, window: int, least: int, step: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of y from rows `at` on: the length (the shortest of equals) whose slope has the largest |t|, and t.
    Running sums of each event's own window, centred at its first value, give the fits of all its lengths."""
    n = np.arange(least, window, step)
    lengths, scores = np.zeros(len(at), np.int64), np.full(len(at), np.nan)
    skk, sk, k = n * (n * n - 1.0) / 12, n * (n - 1) / 2, np.arange(window)
    for a in range(0, len(at), 2048):
        rows = at[a : a + 2048]
        path = np.lib.stride_tricks.sliding_window_view(y, window)[rows]
        path = path - path[:, :1]
        sy, syy, sky = (v.cumsum(1)[:, n - 1] for v in (path, path * path, k * path))
        covary, vary = sky - sk * sy / n, syy - sy * sy / n
        slope = covary / skk
        with np.errstate(all="ignore"):
            t = slope / (np.sqrt(np.maximum(vary - slope * covary, 0) / (n - 2) / skk) + epsilon)
        size = np.where(np.isnan(t), -1, np.abs(t))
        best = size.argmax(1)
        lengths[a : a + 2048], scores[a : a + 2048] = n[best], t[np.arange(len(rows)), best]
    return lengths, scores
