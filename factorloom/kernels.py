"""Factor operators over flat arrays: rows of many groups one after another, NaN where a value is missing.

Time operators need the rows of a ticker in order of date, cross-section operators those of a date.  ``Groups`` says where groups start; a
window never reaches over a start.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Windows of so many rows are ranked by looking at each row, of half as many sorted; longer ones go through a wavelet tree.
SHORT = 48
#: 2^18 + 1 leaves 35 of a double's 53 bits.
LEVEL = 2.0**18 + 1
#: A double of this size has twelve decimals.
TWELVE = 2.0**12


class Groups:
    """Places of rows within their groups."""

    def __init__(self, starts: np.ndarray, n: int):
        sizes = np.diff(np.append(starts, n))
        self.n, self.starts = n, starts
        self.code = np.repeat(np.arange(len(starts)), sizes)
        self.start = np.repeat(starts, sizes)
        self.at = np.arange(n) - self.start


def finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.nan)


def level(x: np.ndarray) -> np.ndarray:
    """x rounded to 35 bits: ranks and places take values that agree to about ten figures as ties, as rounding alone tells them apart."""
    big = x * LEVEL
    return np.where(np.isfinite(x), big - (big - x), x)


class Lanes:
    """Rows with ``n`` - 1 empty places before each group, so that every row has a window of n places that ends with it.

    What can be put together from two parts (sums, extremes, moments) is made for stretches of 1, 2, 4 ... places, and a window from the
    stretches of its length's bits: some log n steps over whole arrays, never a subtraction, and in an order that depends on
    the window alone, not on where the rows before it begin.
    """

    def __init__(self, g: Groups, n: int):
        self.n = n
        self.last = np.arange(g.n) + (g.code + 1) * (n - 1) if g.n else np.empty(0, np.int64)
        self.first = self.last - (n - 1)
        self.size = g.n + len(g.starts) * (n - 1)

    def laid(self, x: np.ndarray, empty: float = np.nan) -> np.ndarray:
        out = np.full(self.size, empty)
        out[self.last] = x
        return out

    def count(self, known: np.ndarray) -> np.ndarray:
        ends = np.append(0, np.cumsum(known))
        return ends[self.last + 1] - ends[self.first]

    def put_together(self, one: tuple[np.ndarray, ...], join: Callable) -> tuple[np.ndarray, ...]:
        """Each row's window from its places: ``join(older, newer, length of older)`` of neighbouring stretches."""
        before = lambda state, k: tuple(np.roll(x, k) for x in state) if k else state  # noqa: E731  what comes round is before all windows
        out, have, done, size = None, one, 0, 1
        while True:
            if self.n & size:
                out = have if out is None else join(before(have, done), out, size)
                done += size
            if done == self.n:
                return tuple(x[self.last] for x in out)
            have = join(before(have, size), have, size)
            size *= 2


def by(f: np.ufunc) -> Callable:
    return lambda a, b, _: (f(a[0], b[0]),)


def enough(lanes: Lanes, known: np.ndarray, n: int, least: int | None, x: np.ndarray) -> np.ndarray:
    return np.where(lanes.count(known) >= (n if least is None else least), x, np.nan)


def total(g, x, n, least=None):
    lanes, x = Lanes(g, n), finite(x)
    known = lanes.laid(~np.isnan(x), 0) > 0
    return enough(lanes, known, n, least, lanes.put_together((lanes.laid(np.nan_to_num(x), 0.0),), by(np.add))[0])


def mean(g, x, n, least=None):
    lanes, x = Lanes(g, n), finite(x)
    size = lanes.count(lanes.laid(~np.isnan(x), 0) > 0)
    sums = lanes.put_together((lanes.laid(np.nan_to_num(x), 0.0),), by(np.add))[0]
    return np.where(size >= max(1, n if least is None else least), sums / np.maximum(1, size), np.nan)


def moments(lanes: Lanes, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each window: how many rows have all columns, their means, and the sums of squared and crossed deviations; equal values deviate by exactly 0."""
    known = ~np.isnan(columns[0])
    for c in columns[1:]:
        known &= ~np.isnan(c)
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if lanes.n < 8:
        return _few(lanes, known, columns, pairs)
    one = [lanes.laid(known, 0.0), *[lanes.laid(np.where(known, c, 0.0), 0.0) for c in columns]]

    def join(a, b, _):
        size = a[0] + b[0]
        share = b[0] / np.maximum(1, size)
        apart = [np.where(a[0] > 0, y - x, 0.0) * (b[0] > 0) for x, y in zip(a[1 : 1 + k], b[1 : 1 + k], strict=True)]
        means = [np.where(a[0] > 0, x + d * share, y) for x, y, d in zip(a[1 : 1 + k], b[1 : 1 + k], apart, strict=True)]
        weight = a[0] * share
        return (size, *means, *[x + y + apart[i] * apart[j] * weight for (i, j), x, y in zip(pairs, a[1 + k :], b[1 + k :], strict=True)])

    return lanes.put_together((*one, *[np.zeros(lanes.size) for _ in pairs]), join)


def _few(lanes: Lanes, known: np.ndarray, columns: tuple[np.ndarray, ...], pairs: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """``moments`` of short windows, row by row and oldest first, from deviations against the first: products of equal ranks cancel to exactly 0, on which ties of covariances hang."""
    mask, rows = lanes.laid(known, 0) > 0, [lanes.laid(np.where(known, c, 0.0), 0.0) for c in columns]
    places = [lanes.last - k for k in range(lanes.n - 1, -1, -1)]
    size, base = np.zeros(len(lanes.last)), [np.zeros(len(lanes.last)) for _ in rows]
    for at in places:
        base = [np.where(size > 0, b, r[at]) for b, r in zip(base, rows, strict=True)]
        size = size + mask[at]
    sums = [sum(np.where(mask[at], r[at] - b, 0.0) for at in places) for b, r in zip(base, rows, strict=True)]
    means = [s / np.maximum(1, size) for s in sums]
    products = [np.zeros(len(size)) for _ in pairs]
    for at in places:
        away = [np.where(mask[at], r[at] - b - m, 0.0) for r, b, m in zip(rows, base, means, strict=True)]
        products = [p + away[i] * away[j] for p, (i, j) in zip(products, pairs, strict=True)]
    return (size, *[b + m for b, m in zip(base, means, strict=True)], *products)


def std(g, x, n, least=None):
    size, _, squares = moments(Lanes(g, n), finite(x))
    return np.where((size >= (n if least is None else least)) & (size > 1), np.sqrt(squares / np.maximum(1, size - 1)), np.nan)


def cov(g, x, y, n, least=None):
    size, *_, crossed, _ = moments(Lanes(g, n), finite(x), finite(y))
    return np.where((size >= (n if least is None else least)) & (size > 1), crossed / np.maximum(1, size - 1), np.nan)


def corr(g, x, y, n, least=None):
    """To twelve decimals, so that none is nearly 0; NaN where a side is constant."""
    size, _, _, a, c, b = moments(Lanes(g, n), finite(x), finite(y))
    return np.where(size >= (n if least is None else least), divided(c, np.sqrt(a) * np.sqrt(b)) + TWELVE - TWELVE, np.nan)


def _extreme(g, x, n, least, f, empty):
    lanes, x = Lanes(g, n), finite(x)
    known = ~np.isnan(x)
    return enough(lanes, lanes.laid(known, 0) > 0, n, least, lanes.put_together((lanes.laid(np.where(known, x, empty), empty),), by(f))[0])


def lowest(g, x, n, least=None):
    return _extreme(g, x, n, least, np.minimum, np.inf)


def highest(g, x, n, least=None):
    return _extreme(g, x, n, least, np.maximum, -np.inf)


def place_of(sign: float):
    def run(g, x, n):
        """Place of the first best value (largest of sign * x), the oldest being 1."""
        lanes, x = Lanes(g, n), level(finite(x))
        known = ~np.isnan(x)
        rows = lanes.laid(np.where(known, sign * x, -np.inf), -np.inf)

        def join(a, b, size):
            older = a[0] >= b[0]
            return np.where(older, a[0], b[0]), np.where(older, a[1], b[1] + size)

        return enough(lanes, lanes.laid(known, 0) > 0, n, None, lanes.put_together((rows, np.ones(lanes.size)), join)[1])

    return run


class Wavelet:
    """Counts and order statistics of any stretch of a row of whole numbers, in steps by their bits."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(1, int(codes.max(initial=0)).bit_length())
        self.levels = []
        v = codes
        for b in range(self.bits - 1, -1, -1):
            one = (v >> b & 1).astype(bool)
            self.levels.append((b, np.append(0, np.cumsum(~one))))
            v = np.concatenate([v[~one], v[one]])

    def below(self, first: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How many places of ``first`` to ``end`` (excluded) have a smaller number than ``code``."""
        out = np.zeros(len(first), np.int64)
        for b, zeros in self.levels:
            a, z = zeros[first], zeros[end]
            up = code >> b & 1 == 1
            out += np.where(up, z - a, 0)
            first, end = np.where(up, zeros[-1] + first - a, a), np.where(up, zeros[-1] + end - z, z)
        return np.where(code >> self.bits > 0, out + end - first, out)

    def smallest(self, first: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number of rank k, from 0."""
        out = np.zeros(len(first), np.int64)
        for b, zeros in self.levels:
            a, z = zeros[first], zeros[end]
            up = k >= z - a
            k, out = np.where(up, k - (z - a), k), np.where(up, out | 1 << b, out)
            first, end = np.where(up, zeros[-1] + first - a, a), np.where(up, zeros[-1] + end - z, z)
        return out


def _coded(lanes: Lanes, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct known values in order, and every place's index among them; those without a value come after all."""
    known = ~np.isnan(x)
    values, codes = np.unique(x[known], return_inverse=True)
    whole = np.full(len(x), len(values), np.int64)
    whole[known] = codes
    laid = np.full(lanes.size, len(values), np.int64)
    laid[lanes.last] = whole
    return values, laid


def rolling_rank(g, x, n, least=None):
    """Percentile rank of the last value among the known ones, ties averaged; infinities keep their place."""
    lanes, x = Lanes(g, n), level(x)
    if n <= SHORT:
        rows = lanes.laid(x)
        less, alike = np.zeros(g.n, np.int32), np.zeros(g.n, np.int32)
        for k in range(n):
            other = rows[lanes.last - k]
            less += other < x
            alike += other == x
        size = lanes.count(~np.isnan(rows))
        return np.where(~np.isnan(x) & (size >= (n if least is None else least)), (less + (alike + 1) / 2) / np.maximum(1, size), np.nan)
    values, codes = _coded(lanes, x)
    tree, mine = Wavelet(codes), codes[lanes.last]
    size = lanes.count(codes < len(values))
    less = tree.below(lanes.first, lanes.last + 1, mine)
    alike = tree.below(lanes.first, lanes.last + 1, mine + 1) - less
    out = (less + (alike + 1) / 2) / np.maximum(1, size)
    return np.where((mine < len(values)) & (size >= (n if least is None else least)), out, np.nan)


def quantile(g, x, n, q, least=None):
    """Linear interpolation between neighbouring known values."""
    lanes, x = Lanes(g, n), finite(x)
    if n <= SHORT // 2:
        rows = lanes.laid(x)
        w = np.sort(np.lib.stride_tricks.sliding_window_view(rows, n)[lanes.first], axis=1)  # NaN last
        size = lanes.count(~np.isnan(rows))
        at = np.maximum(0, size - 1) * q
        low, row = np.floor(at).astype(np.int64), np.arange(g.n)
        down, up = w[row, low], w[row, np.minimum(low + 1, np.maximum(0, size - 1))]
        return np.where(size >= max(1, n if least is None else least), down + (up - down) * (at - low), np.nan)
    values, codes = _coded(lanes, x)
    if not len(values):
        return np.full(g.n, np.nan)
    tree, size = Wavelet(codes), lanes.count(codes < len(values))
    at = np.maximum(0, size - 1) * q
    low = np.floor(at).astype(np.int64)
    value = lambda k: values[np.minimum(tree.smallest(lanes.first, lanes.last + 1, k), len(values) - 1)]
    down, up = value(low), value(np.minimum(low + 1, np.maximum(0, size - 1)))
    return np.where(size >= max(1, n if least is None else least), down + (up - down) * (at - low), np.nan)


def decay(g, x, n):
    """Weighted mean, the newest weighing n times the oldest."""
    lanes, x = Lanes(g, n), finite(x)
    rows = lanes.laid(np.nan_to_num(x), 0.0)
    weighed = lanes.put_together((rows, rows), lambda a, b, size: (a[0] + b[0], a[1] + b[1] + size * b[0]))[1]
    return enough(lanes, lanes.laid(~np.isnan(x), 0) > 0, n, None, weighed / (n * (n + 1) / 2))


def delay(g, x, k):
    out = np.full(g.n, np.nan)
    if k < g.n:
        out[k:] = x[: g.n - k]
    out[g.at < k] = np.nan
    return out


def delta(g, x, k):
    return x - delay(g, x, k)


def fill(g, x, seed=None):
    """The last known value; before a group's first one its ``seed``."""
    at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(g.n))) if g.n else np.arange(0)
    return np.where(at >= g.start, x[np.maximum(at, 0)] if g.n else x, np.nan if seed is None else seed)


def growth(g, x, seed=None):
    """Running product of 1 + x, from ``seed``; a gap is NaN and doesn't end it."""
    factors = np.where(np.isnan(x), 1.0, 1 + x)
    if seed is not None and g.n:
        first = np.where(np.isnan(seed[g.starts]), 1.0, seed[g.starts])
        factors[g.starts] = first * factors[g.starts]
    out = np.concatenate([np.cumprod(p) for p in np.split(factors, g.starts[1:])]) if g.n else factors
    return np.where(np.isnan(x), np.nan, out)


def rank(g, x):
    """Percentile rank within the group, ties averaged; NaN isn't counted."""
    x = level(x)
    order = np.lexsort((x, g.code))
    v, code = x[order], g.code[order]
    known = ~np.isnan(v)
    new = np.ones(g.n, bool)
    new[1:] = (code[1:] != code[:-1]) | (v[1:] != v[:-1])  # NaN differs from NaN
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, g.n))
    tie = np.cumsum(new) - 1
    average = (first - g.start[order][first] + (size + 1) / 2)[tie] if g.n else v
    count = np.bincount(code, known, len(g.starts))
    out = np.full(g.n, np.nan)
    out[order] = np.where(known, average / np.maximum(1, count[code]), np.nan)
    return out


def scale(g, x, k=1.0):
    """Absolute values of a group add up to k."""
    return divided(x * k, np.bincount(g.code, np.nan_to_num(np.abs(x), nan=0.0, posinf=np.inf), len(g.starts))[g.code])


def divided(a, b):
    """NaN where the divisor is 0."""
    a, b = np.broadcast_arrays(a, b)
    return np.divide(a, b, out=np.full(a.shape, np.nan), where=b != 0)


def ieee_divided(a, b):
    """Signed infinity where the divisor is 0, NaN for 0/0."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    return np.where(b == 0, np.where(a > 0, np.inf, np.where(a < 0, -np.inf, np.nan)), divided(a, b))


def flagged(f):
    return lambda a, b: f(a, b).astype(float)


ROW: dict[str, Callable[..., np.ndarray]] = {
    "+": np.add, "-": np.subtract, "*": np.multiply, "/": ieee_divided, "sdiv": divided, "pow": np.power, ">": flagged(np.greater), "<": flagged(np.less),
    ">=": flagged(np.greater_equal), "<=": flagged(np.less_equal), "==": flagged(np.equal), "or": np.fmax, "abs": np.abs, "sign": np.sign,
    "log": lambda a: np.log(np.where(a > 0, a, np.nan)), "least": np.fmin, "greatest": np.fmax, "where": lambda c, a, b: np.where(c > 0, a, b),
    "neg": np.negative, "safe_log": lambda a: np.log(np.abs(a) + 1e-6), "safe_sqrt": lambda a: np.sqrt(np.abs(a)), "safe_div": lambda a, b: finite(divided(a, b)),
}
#: Operators per ticker (arguments: columns, then whole numbers) and per date.
TIME: dict[str, Callable[..., np.ndarray]] = {
    "ts_sum": total, "mean": mean, "std": std, "ts_min": lowest, "ts_max": highest, "ts_rank": rolling_rank, "argmax": place_of(1.0), "argmin": place_of(-1.0),
    "corr": corr, "cov": cov, "delay": delay, "delta": delta, "decay": decay, "growth": growth, "fill": fill, "quantile": quantile,
}
DATE: dict[str, Callable[..., np.ndarray]] = {"rank": rank, "scale": scale}
