"""Seatings of Chinese restaurants with Pitman-Yor discounts, in numpy, for many dishes at once.

The customers of one dish arrive one by one. With n of them at t tables the next one opens a table with weight
a + b * t, where a = (strength + discount * tables of other dishes) * p and b = discount * p, p being the parent's
probability of the dish, or joins a table with weight n - discount * t. A seating is kept as the places of the customers
that opened the second and later tables.

`arrive` draws single arrivals, and beyond the first STEPS of a dish it goes from one new table to the next, which has the
same distribution: the chance that none opens among many arrivals is a quotient of gamma functions, so a dish of a
billion customers costs as many draws as tables.
`resample` is a block Gibbs step by Metropolis and Hastings: all customers of a dish leave, arrive again, and the new
seating replaces the old one with the chance that makes the dish's distribution given all others stationary.
"""

from __future__ import annotations

import math

import numpy as np

from tidemark.llm.shingles import mix

#: Customers of a dish whose arrivals are drawn one by one, side by side with other dishes.
STEPS = 1024


def uniform(seed: np.ndarray, i: int | np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seeds and i alone, so that a task that runs again draws the same."""
    with np.errstate(over="ignore"):
        h = mix(seed + np.uint64(0x9E3779B97F4A7C15) * np.asarray(i + 1).astype(np.uint64))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers: Stirling's series, after a shift by eight where they are small."""
    small = x < 8
    low = np.where(small, x, 1.0)
    product = low.copy()
    for i in range(1, 8):
        product *= low + i
    y = np.where(small, x + 8, x)
    r = 1 / y
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r * (1 / 12 - r * r * (1 / 360 - r * r / 1260))
    return series - np.where(small, np.log(product), 0.0)


class Seatings:
    """Second and later tables of many dishes: `at` holds the places of their first customers, dish by dish."""

    def __init__(self, counts: np.ndarray, at: np.ndarray):
        self.counts, self.at = counts.astype(np.int64), at.astype(np.int64)

    @classmethod
    def single(cls, n: int) -> Seatings:
        return cls(np.zeros(n, np.int64), np.empty(0, np.int64))

    def cut(self, customers: np.ndarray) -> Seatings:
        """Without the last customers, so that as many stay; which are last does not matter, since arrivals are exchangeable."""
        own = np.repeat(np.arange(len(self.counts)), self.counts)
        keep = self.at < customers[own]
        return Seatings(np.bincount(own[keep], minlength=len(self.counts)), self.at[keep])

    def chosen(self, other: Seatings, take: np.ndarray) -> Seatings:
        """The other's seating where take is true."""
        a, b = np.repeat(~take, self.counts), np.repeat(take, other.counts)
        own = np.concatenate((np.repeat(np.arange(len(take)), self.counts)[a], np.repeat(np.arange(len(take)), other.counts)[b]))
        order = np.argsort(own, kind="stable")
        return Seatings(np.where(take, other.counts, self.counts), np.concatenate((self.at[a], other.at[b]))[order])


def arrive(customers: np.ndarray, a: np.ndarray, b: np.ndarray, d: float, seed: np.ndarray, begin: Seatings | None = None, present: np.ndarray | None = None) -> Seatings:
    """Seatings after customers beyond those present arrived; without begin, after all of them did."""
    size = len(customers)
    begin = begin or Seatings.single(size)
    seated = np.ones(size, np.int64) if present is None else present.astype(np.int64)
    tables = begin.counts + 1
    due = np.minimum(customers, STEPS)
    live = np.flatnonzero(due > seated)
    owners, places = [np.repeat(np.arange(size), begin.counts)], [begin.at]
    while len(live):
        n, t = seated[live], tables[live]
        weight = a[live] + b[live] * t
        new = live[uniform(seed[live], n) < weight / (weight + n - d * t)]
        owners.append(new)
        places.append(seated[new])
        tables[new] += 1
        seated[live] += 1
        live = live[due[live] > seated[live]]
    for i in np.flatnonzero(customers > seated).tolist():
        found = _openings(int(seated[i]), int(tables[i]), int(customers[i]), float(a[i]), float(b[i]), d, seed[i])
        owners.append(np.full(len(found), i))
        places.append(np.array(found, np.int64))
    own, at = np.concatenate(owners), np.concatenate(places)
    order = np.argsort(own, kind="stable")
    return Seatings(np.bincount(own, minlength=size), at[order])


def _openings(n: int, t: int, c: int, a: float, b: float, d: float, seed: np.uint64) -> list[int]:
    """Places of the customers from n to c - 1 that open tables, t being open."""
    out: list[int] = []
    u: list[float] = []
    draw = 1 << 40
    log_gamma = math.lgamma
    while n < c:
        if not u:
            u = np.log(uniform(np.full(64, seed), draw + np.arange(64)[::-1])).tolist()
            draw += 64
        chance, weight = u.pop(), a + b * t
        rest = log_gamma(weight + n - d * t) - log_gamma(n - d * t)

        def nobody(m: int, weight=weight, rest=rest, t=t) -> float:
            """Log of the chance that no customer from n to m - 1 opens a table."""
            return log_gamma(m - d * t) - log_gamma(weight + m - d * t) + rest

        low, step = n, max(1, int(chance / math.log1p(-weight / (weight + n - d * t))))
        high = min(c, n + step)
        while nobody(high) >= chance:
            if high == c:
                return out
            low, step = high, 2 * step
            high = min(c, high + step)
        while high - low > 1:
            middle = (low + high) // 2
            if nobody(middle) < chance:
                high = middle
            else:
                low = middle
        out.append(high - 1)
        n, t = high, t + 1
    return out


def log_weight(seatings: Seatings, customers: np.ndarray, a: np.ndarray, b: np.ndarray, d: float) -> np.ndarray:
    """Log of what the seating's probability must be multiplied by to be in proportion to the dish's distribution given all others."""
    size, counts = len(customers), seatings.counts
    # Stretches of arrivals between openings: their dish, first and last place, and the tables then open.
    own = np.repeat(np.arange(size), counts + 1)
    head = np.cumsum(counts + 1) - (counts + 1)
    first, end = np.ones(len(own)), np.empty(len(own))
    later = np.ones(len(own), bool)
    later[head] = False
    first[later] = seatings.at + 1
    end[np.flatnonzero(later) - 1] = seatings.at + 1
    end[head + counts] = customers
    t = np.arange(len(own)) - head[own] + 1
    base = a[own] + (b[own] - d) * t
    return np.bincount(own, lgamma(base + end) - lgamma(base + first), size)


def resample(now: Seatings, customers: np.ndarray, a: np.ndarray, b: np.ndarray, d: float, seed: np.ndarray) -> Seatings:
    """The next seating of every dish, now being the present one for as many customers."""
    new = arrive(customers, a, b, d, seed)
    gain = log_weight(new, customers, a, b, d) - log_weight(now, customers, a, b, d)
    return now.chosen(new, np.log(uniform(seed, 0)) < gain)
