"""Numbers of tables in Pitman-Yor restaurants, drawn from their conditional distribution.

Given ``g``, a Gamma(strength / discount + tables) variable of a restaurant, its dishes are independent: a dish of
c customers has t tables with weight S(c, t) * (discount * g * p) ** t, where S are generalised Stirling numbers
and p is the parent's probability of the dish.  So a draw reseats every customer of a dish at once.

Up to EXACT customers S comes from its recursion.  Beyond, it is a saddle point of the sizes of t tables, with a
correction by t / c ** discount that the recursion yields at FIT customers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EXACT = 256
FIT = 2048
POINTS = 257  # of a large dish's distribution: all numbers that matter, or evenly spaced ones
DROP = 30.0  # logarithm below the mode from which numbers do not matter


def log_gamma(x):
    x = np.asarray(x, float)
    few = x < 16
    y = np.where(few, x + 16, x)
    z = 1 / y
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + z * (1 / 12 - z * z * (1 / 360 - z * z / 1260))
    if few.any():
        some = x[few]
        less = some.copy()
        for i in range(1, 16):
            less *= some + i
        out[few] -= np.log(less)
    return out


def beyond(m):
    """What log_gamma(m + 1) has more than Stirling's formula; nothing for very small m."""
    z = 1 / m
    out = z * (1 / 12 - z * z * (1 / 360 - z * z / 1260))
    few = m < 16
    if few.any():
        some = m[few]
        more = log_gamma(some + 1) - (some * np.log(some) - some + 0.5 * np.log(2 * np.pi * some))
        out[few] = np.where(some < 1e-3, 0.0, more)
    return out


class Stirling:
    """Logarithms of S(c, t) for one discount; up to a term of c alone beyond EXACT."""

    def __init__(self, discount: float):
        self.d = d = discount
        self.exact = np.full((EXACT + 1, EXACT + 1), -np.inf)
        row = np.array([0.0])  # of c = 1, from t = 1
        self.exact[1, 1] = 0.0
        for c in range(1, FIT):
            stay = row + np.log(c - d * np.arange(1, c + 1))
            row = np.logaddexp(np.append(stay, -np.inf), np.insert(row, 0, -np.inf))
            if c < EXACT:
                self.exact[c + 1, 1 : c + 2] = row
        self.by_tables = np.ascontiguousarray(self.exact.T)
        left = np.concatenate([np.linspace(-80, -3, 20000), np.log1p(-np.logspace(-0.0222, -9, 20000))])
        z = -np.expm1(left)
        self.left, self.rise = left, np.log(self._excess(left, z))  # falls
        t = np.arange(1, FIT, dtype=float)
        self.place, self.fix = np.log(t / FIT**d), np.zeros(FIT - 1)
        self.fix = row[:-1] - self(np.full(FIT - 1, float(FIT)), t)
        self.slope = (self.fix[8] - self.fix[0]) / (self.place[8] - self.place[0])
        self.fix -= self.fix[-1]

    def _excess(self, left, z):
        """Mean size of a table less one, where ``left`` is the logarithm of 1 - z."""
        small = z < 1e-4
        safe = np.where(small, 0.5, z)
        lq = np.where(small, np.log(0.5), left)
        mean = self.d * safe * np.exp((self.d - 1) * lq) / -np.expm1(self.d * lq)
        return np.where(small, (1 - self.d) / 2 * z, mean - 1)

    def __call__(self, c, t):
        """For more than EXACT customers; ``t`` from 1 to c, not only whole numbers."""
        return log_gamma(c + 1) + self.but_for_count(c, t)

    def but_for_count(self, c, t):
        """The same without what hangs on c alone."""
        d, t = self.d, np.minimum(t, c)
        m = np.maximum(c - t, 1e-6)
        left = np.interp(-np.log(m / t), -self.rise, self.left)
        z, power = -np.expm1(left), np.exp(d * left)
        mean = c / t
        spread = mean * (1 + (1 - d) * z / np.exp(left) - mean)
        spread = np.maximum(spread, 1e-12)
        at = t * np.log1p(-power) - c * np.log(z) - 0.5 * np.log(2 * np.pi * t * spread)
        at = np.where(c - t < 0.5, t * np.log(d), at - beyond(m))
        v = np.log(t) - d * np.log(c)
        fix = np.interp(v, self.place, self.fix)
        if hasattr(self, "slope"):
            fix = fix + np.minimum(v - self.place[0], 0) * self.slope
        return -log_gamma(t + 1) - t * np.log(d) + at + fix


@lru_cache(4)
def stirling(discount: float) -> Stirling:
    return Stirling(discount)


def draw(count, step, rng, discount, own=None, all_=None) -> np.ndarray:
    """Tables of each dish, all customers reseated.

    ``step`` is the logarithm of discount * g * p.  With ``own`` and ``all_`` it lacks p, and the j-th table after
    the first weighs (own + j) / (all_ + j) instead: what the parent has of the dish and in all, which grows with
    every table opened here.  (The first table is there in any case, so its weight does not matter.)
    """
    numbers = stirling(discount)
    tables = np.ones(len(count), np.int64)
    own = np.zeros(len(count)) if own is None else own
    all_ = own if all_ is None else all_
    two = np.flatnonzero(count == 2)  # most dishes
    second = numbers.exact[2, 2] - numbers.exact[2, 1] + step[two]
    second = np.exp(second) * (own[two] + 1) / (all_[two] + 1)
    tables[two] += rng.random(len(two)) * (1 + second) > 1
    size = 4
    while size <= EXACT:
        at = np.flatnonzero((count > size // 2) & (count <= size) & (count > 1))
        for some in np.array_split(at, max(1, len(at) * size // (1 << 20))):
            if not len(some):
                continue
            t = np.arange(1, size)[:, None]  # a row for each number of tables, so that long rows are added
            grown = np.log((own[some] + t) / (all_[some] + t)) + step[some]
            weight = numbers.by_tables[1 : size + 1].take(count[some], axis=1)
            weight[1:] += np.cumsum(grown, axis=0)
            weight = np.cumsum(np.exp(weight - weight.max(axis=0)), axis=0)
            tables[some] = 1 + (weight < rng.random(len(some)) * weight[-1]).sum(axis=0)
        size *= 2
    large = np.flatnonzero(count > EXACT)
    for some in np.array_split(large, max(1, len(large) // 512)):
        if len(some):
            tables[some] = _large(numbers, count[some].astype(float), step[some], own[some], all_[some], rng)
    return tables


def _large(numbers, c, step, own, all_, rng):
    def weight(t, i=slice(None)):
        grown = log_gamma(own[i] + t) - log_gamma(all_[i] + t)  # but for what hangs on the dish alone
        return numbers.but_for_count(c[i], t) + (t - 1) * step[i] + grown

    def first_where(test, low, high):
        while (high - low).max() >= 1:
            middle = np.floor((low + high) / 2)
            yes = test(middle)
            low, high = np.where(yes, low, np.minimum(middle + 1, high)), np.where(yes, middle, high)
        return high

    one = np.ones(len(c))
    mode = first_where(lambda t: weight(np.minimum(t + 1, c)) <= weight(t), one, c.copy())
    top = weight(mode)
    low = first_where(lambda t: weight(t) > top - DROP, one, mode.copy())
    high = first_where(lambda t: weight(t) < top - DROP, mode.copy(), c.copy())
    gap = np.maximum(1.0, (high - low) / (POINTS - 1))
    points, drawn, size = np.minimum(high - low + 1, POINTS), np.empty(len(c)), 0
    while size < POINTS:
        size, least = min(max(16, 2 * size), POINTS), size
        at = np.flatnonzero((points > least) & (points <= size))
        if not len(at):
            continue
        t = low[at, None] + gap[at, None] * np.arange(size)
        w = weight(np.minimum(t, c[at, None]).ravel(), np.repeat(at, size)).reshape(t.shape)
        w = np.where(t <= high[at, None] + 1e-9, np.exp(w - w.max(axis=1, keepdims=True)), 0)
        w = np.cumsum(w, axis=1)
        pick = (w < (rng.random(len(at)) * w[:, -1])[:, None]).sum(axis=1)
        drawn[at] = t[np.arange(len(at)), pick]
    spread = np.where(gap > 1, (rng.random(len(c)) - 0.5) * gap, 0)
    return np.clip(np.rint(drawn + spread), 1, c).astype(np.int64)
