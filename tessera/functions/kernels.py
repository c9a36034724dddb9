"""NumPy kernels over a matrix of series (one row each), in double precision."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

# transforms


def z_normalize(x: np.ndarray) -> np.ndarray:
    """(x - mean) / population deviation by row; a constant row becomes zeros."""
    sd = x.std(axis=1, keepdims=True)
    return np.where(sd > 0, (x - x.mean(axis=1, keepdims=True)) / np.where(sd > 0, sd, 1), 0.0)


def edges(dim: int, segments: int) -> np.ndarray:
    """Segment boundaries; the lengths differ by one at most."""
    return (np.arange(segments + 1) * dim) // segments


def paa(x: np.ndarray, segments: int) -> np.ndarray:
    """Mean of each segment."""
    e = edges(x.shape[1], segments)
    return np.add.reduceat(x, e[:-1], axis=1) / np.diff(e)


def gaussian_breakpoints(symbols: int) -> np.ndarray:
    """The quantiles of N(0, 1) that cut it into equally likely parts."""
    d = NormalDist()
    return np.array([d.inv_cdf(j / symbols) for j in range(1, symbols)])


def equidepth_breakpoints(values: np.ndarray, symbols: int) -> np.ndarray:
    """Linearly interpolated quantiles; those of fewer symbols (a power of two) are among those of more."""
    return np.quantile(values, np.arange(1, symbols) / symbols)


def symbolize(means: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Cuts strictly below each value: intervals are (cut, next cut]."""
    return np.searchsorted(cuts, means, side="left").astype(np.uint8)


def root_mask(word: np.ndarray, bits: int) -> np.ndarray:
    """The first bit of each symbol, packed first segment first."""
    top = (word >> (bits - 1)).astype(np.int64)
    return (top << np.arange(word.shape[1] - 1, -1, -1)).sum(axis=1)


def z_key(word: np.ndarray, bits: int) -> list[bytes]:
    """Symbols' bits interleaved, highest plane first: bytes that sort like the z-order curve."""
    planes = [(word >> b) & 1 for b in range(bits - 1, -1, -1)]
    return [r.tobytes() for r in np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)]


def envelope(x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and least value within ``band`` places of each place."""
    pad = np.pad(x, ((0, 0), (band, band)), constant_values=np.nan)
    windows = np.lib.stride_tricks.sliding_window_view(pad, 2 * band + 1, axis=1)
    return np.nanmax(windows, axis=2), np.nanmin(windows, axis=2)


def fourier(x: np.ndarray, coefficients: int, skip_mean: bool = False) -> np.ndarray:
    """(real, -imaginary) pairs of the first frequencies, scaled by sqrt(2 / n) so that they bound distances."""
    f = np.fft.rfft(x, axis=1) * np.sqrt(2.0 / x.shape[1])
    f = f[:, 1:] if skip_mean else f
    pairs = np.stack([f.real, -f.imag], axis=2).reshape(len(x), -1)[:, :coefficients]
    return pairs


def fourier_weights(dim: int, coefficients: int, skip_mean: bool = False) -> np.ndarray:
    """What each squared difference counts in the bound: half for the mean and for the frequency n / 2."""
    w = np.ones(coefficients + 2)
    if not skip_mean:
        w[0], w[1] = 0.5, 0.0
    last = dim // 2 - (1 if skip_mean else 0)
    if dim % 2 == 0 and 2 * last < len(w):
        w[2 * last] = 0.5
        w[2 * last + 1 : 2 * last + 2] = 0.0
    return w[:coefficients]


def quantize(values: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Cuts at or below each value, by column: intervals are [cut, next cut)."""
    return np.stack([np.searchsorted(bins[j], values[:, j], side="right") for j in range(values.shape[1])], axis=1).astype(np.uint8)


def sketch(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each segment."""
    e = edges(x.shape[1], segments)
    n = np.diff(e)
    m = np.add.reduceat(x, e[:-1], axis=1) / n
    centred = x - np.repeat(m, n, axis=1)
    return m, np.sqrt(np.add.reduceat(centred * centred, e[:-1], axis=1) / n)


# distances (squared, no root)


def l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of one series to each row, from differences."""
    d = x - q
    return np.einsum("ij,ij->i", d, d)


def dtw(q: np.ndarray, x: np.ndarray, band: int) -> np.ndarray:
    """Squared banded dynamic time warping of one series to each row."""
    n, m = x.shape
    return warp(np.repeat(np.asarray(q, np.float64)[:, None], n, axis=1), np.ascontiguousarray(x.T[::-1], np.float64), band)[1]


def warp(q: np.ndarray, back: np.ndarray, band: int, limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Squared banded dynamic time warping of pairs, in the arrays' own precision: (numbers of pairs, their distances).

    Both arrays have a column a pair; those of ``back`` run backwards, so that a diagonal of the table is a run of rows
    in both. All pairs advance together, by diagonals: a cell needs the two diagonals before its own, and these have
    cells of either parity of i - j, which are kept apart. Pairs that can't end within ``limits`` are left out early.
    """
    m, n = back.shape
    band = min(band, m - 1)
    middle = band + 1
    sides = [np.full((band + 2, n), np.inf, back.dtype) for _ in range(2)]
    sides[middle % 2][middle // 2] = 0
    cost, least = (np.empty((band + 1) * n, back.dtype) for _ in range(2))
    pairs, step = np.arange(n), max(8, m // 4)
    for k in range(2 * m - 1):
        if limits is not None and k >= m // 2 and k % step == 0:
            live = np.minimum(sides[0].min(axis=0), sides[1].min(axis=0)) <= limits
            if np.count_nonzero(live) < 0.75 * n:
                live = np.flatnonzero(live)  # take() keeps the columns of a row together, an index would not
                sides, q, back, limits, pairs = [s.take(live, axis=1) for s in sides], q.take(live, axis=1), back.take(live, axis=1), limits[live], pairs[live]
                n = len(pairs)
        reach = min(band, k, 2 * m - 2 - k)
        reach -= (reach - k) % 2
        w, i, j = reach + 1, (k - reach) // 2, m - 1 - (k + reach) // 2
        c, d = cost[: w * n].reshape(w, n), least[: w * n].reshape(w, n)
        low = middle - reach
        own, other = sides[low % 2][low // 2 : low // 2 + w], sides[1 - low % 2][(low - 1) // 2 : (low - 1) // 2 + w + 1]
        np.subtract(back[j : j + w], q[i : i + w], out=c)
        np.multiply(c, c, out=c)
        np.minimum(other[:-1], other[1:], out=d)
        np.minimum(d, own, out=d)
        np.add(c, d, out=own)
    return pairs, sides[middle % 2][middle // 2]


class Tile:
    """Banded warping of one series after another to the same rows, in 16-bit integers or single precision.

    ``back`` is as in ``warp``. Buffers and their slices are made once, so a diagonal is a few calls over all rows. Integers
    must be at most ``MOST`` in size; sums stop at ``FULL``: no cell is above it by more than one difference, as each second
    diagonal is cut down to it and a cell adds to one before it.
    """

    MOST = 85
    FULL = 65535 - (2 * MOST) ** 2

    def __init__(self, back: np.ndarray, band: int):
        m, n = back.shape
        self.m, self.band, self.back = m, min(band, m - 1), back
        self.whole = back.dtype.kind == "i"
        self.kind = np.dtype(np.uint16) if self.whole else back.dtype
        self.start = self.FULL if self.whole else np.inf
        self.sides = [np.empty((self.band + 2, n), self.kind) for _ in range(2)]
        self.steps = self._steps(self.sides, back, 0)
        self.looks = set(range(m // 2, 2 * m - 1, max(8, m // 8)))

    def _end(self, sides: list[np.ndarray]) -> np.ndarray:
        return sides[(self.band + 1) % 2][(self.band + 1) // 2]

    def _steps(self, sides: list[np.ndarray], back: np.ndarray, first: int) -> list[tuple]:
        """What each diagonal from ``first`` reads and writes."""
        m, band, n, steps = self.m, self.band, back.shape[1], []
        cost, least, full = np.empty((band + 1) * n, back.dtype), np.empty((band + 1) * n, self.kind), np.full((band + 1) * n if self.whole else 0, self.start, self.kind)
        for k in range(first, 2 * m - 1):
            reach = min(band, k, 2 * m - 2 - k)
            reach -= (reach - k) % 2
            w, i, j, low = reach + 1, (k - reach) // 2, m - 1 - (k + reach) // 2, band + 1 - reach
            c, d = cost[: w * n].reshape(w, n), least[: w * n].reshape(w, n)
            own, other = sides[low % 2][low // 2 : low // 2 + w], sides[1 - low % 2][(low - 1) // 2 : (low - 1) // 2 + w + 1]
            cut = full[: w * n].reshape(w, n) if self.whole and (k - band) % 2 else None
            steps.append((k, back[j : j + w], i, i + w, c, c.view(self.kind), other[:-1], other[1:], d, own, cut))
        return steps

    def within(self, q: np.ndarray, limit) -> np.ndarray:
        """Whether each row's distance may be at most ``limit``; exact but for the precision, unless very few rows are left."""
        for s in self.sides:
            s.fill(self.start)
        self._end(self.sides).fill(0)
        return self._run(q[:, None], limit, self.sides, self.back, self.steps)

    def _run(self, q: np.ndarray, limit, sides: list[np.ndarray], back: np.ndarray, steps: list[tuple]) -> np.ndarray:
        for k, x, i, j, c, plus, left, right, d, own, cut in steps:
            if k in self.looks and k > steps[0][0]:
                live = np.minimum(sides[0].min(axis=0), sides[1].min(axis=0)) <= limit
                n = np.count_nonzero(live)
                if n * 64 <= live.size:
                    return live
                if n * 5 <= live.size * 2 and n > 512:  # go on with these alone
                    at = np.flatnonzero(live)
                    sides, back = [s.take(at, axis=1) for s in sides], back[: self.m - (k - self.band) // 2].take(at, axis=1)
                    live[at] = self._run(q, limit, sides, back, self._steps(sides, back, k))
                    return live
            np.subtract(x, q[i:j], c)
            np.square(c, c)
            np.minimum(left, right, d)
            np.minimum(d, own, d)
            np.add(plus, d, own)
            if cut is not None:
                np.minimum(own, cut, own)
        return self._end(sides) <= limit


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """``x * scale`` rounded; what is cut at the ends differs by less than before, so warping bounds from below."""
    return np.clip(np.rint(x * scale), -Tile.MOST, Tile.MOST).astype(np.int16)


def integer_scale(limit: float, top: float, m: int) -> tuple[float, int]:
    """A scale for ``integers`` and what warping these can't exceed if the distance is within ``limit``; (0, 0) if series are too long.

    Rounding moves a difference by at most 1, and a path has at most 2 m - 1: roots move by the root of that. Scales are
    eighths of powers of two, so that queries of like limits have one.
    """
    slack, most = np.sqrt(2 * m - 1) * (1 + 1e-6), np.sqrt(Tile.FULL - 500)
    if slack > most / 4:
        return 0.0, 0
    root = np.sqrt(max(limit, 1e-6 * top * top, 1e-300))
    scale = 2.0 ** (np.floor(8 * np.log2((most - slack) / root)) / 8)
    return scale, int(np.ceil((scale * np.sqrt(limit) * (1 + 1e-9) + slack) ** 2))


def lb_keogh(upper: np.ndarray, lower: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What each row has outside the query's envelope, squared and summed; never above the DTW distance."""
    out = np.clip(x, lower, upper)
    np.subtract(x, out, out=out)
    return np.einsum("ij,ij->i", out, out)


def suffix_sums(parts: np.ndarray) -> np.ndarray:
    """Sum of each place and those after it."""
    return np.cumsum(parts[::-1])[::-1]


# lower bounds as tables: [segment][symbol] -> contribution


def sax_table(upper: np.ndarray, lower: np.ndarray, cuts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Contributions for a query whose segment means lie in [lower, upper] (both the means for L2, of the envelopes for DTW)."""
    lo, hi = np.concatenate(([-np.inf], cuts)), np.concatenate((cuts, [np.inf]))
    gap = np.maximum(0, np.maximum(lo[None, :] - upper[:, None], lower[:, None] - hi[None, :]))
    return lengths[:, None] * gap**2


def sfa_table(features: np.ndarray, bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    table = []
    for v, cuts, w in zip(features, bins, weights, strict=True):
        lo, hi = np.concatenate(([-np.inf], cuts)), np.concatenate((cuts, [np.inf]))
        table.append(w * np.maximum(0, np.maximum(lo - v, v - hi)) ** 2)
    return np.array(table)


def sax_tables(upper: np.ndarray, lower: np.ndarray, cuts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same for many queries at once: [segment][symbol][query]."""
    lo, hi = np.concatenate(([-np.inf], cuts)), np.concatenate((cuts, [np.inf]))
    gap = np.maximum(0, np.maximum(lo[None, :, None] - upper.T[:, None, :], lower.T[:, None, :] - hi[None, :, None]))
    return lengths[:, None, None] * gap**2


def sfa_tables(features: np.ndarray, bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.concatenate([sax_tables(features[:, [j]], features[:, [j]], bins[j], weights[[j]]) for j in range(features.shape[1])])


def one_hot(words: np.ndarray, symbols: int) -> np.ndarray:
    """A row a word with a one for each segment's symbol: its product with tables of contributions is the bound."""
    out = np.zeros((len(words), words.shape[1] * symbols), np.float32)
    out[np.arange(len(words))[:, None], np.arange(words.shape[1]) * symbols + words] = 1
    return out


def table_bound(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sum of each word's contributions: at most the distance of any series with that word."""
    total = np.zeros(len(words))
    for s in range(table.shape[0]):
        total += table[s][words[:, s]]
    return total


def sketch_bound(qm: np.ndarray, qd: np.ndarray, m: np.ndarray, d: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """From one sketch to each of others: at most the squared distance, as means and deviations can't differ more."""
    return ((m - qm) ** 2 + (d - qd) ** 2) @ lengths


def node_sketch_bound(qm, qd, m_max, m_min, d_max, d_min, lengths) -> np.ndarray:
    """From one sketch to boxes of sketches."""
    gm = np.maximum(0, np.maximum(m_min - qm, qm - m_max))
    gd = np.maximum(0, np.maximum(d_min - qd, qd - d_max))
    return (gm**2 + gd**2) @ lengths
