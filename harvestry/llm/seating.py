"""Seatings of Pitman-Yor restaurants by tables alone.

Given c customers of one dish, all that the model needs is their number of tables t. Summed over who sits where, the seatings
of c customers at t tables have the weight S(c, t), a generalised Stirling number of the discount, so that t given all other
tables of the restaurant and of its parent has the probability

    p(t) ~ S(c, t) * prod(strength + d * (others + j), j < t) * prod(parent's weight of the dish with j more customers, j < t).

Up to EXACT customers t is drawn from p. Beyond, it moves by Metropolis steps that leave p as it is, with S from its generating
function, c! / t! times the coefficient of z^c in ((1 - (1 - z)^d) / d)^t: by its expansion at z = 1 for few tables, by the
saddle point for many (tests compare both with the recursion). The work for a dish does not grow with its customers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Customers up to which t is drawn from its whole distribution; Metropolis steps of a sweep beyond that.
EXACT, STEPS = 40, 6


@lru_cache(maxsize=8)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t) for c, t up to most; minus infinity where there is no seating."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(most + 1)
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - d * t, 0))
        out[c + 1] = np.logaddexp(stay, np.r_[-np.inf, out[c][:-1]])
    return out


_LANCZOS = (676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gammaln(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers (Lanczos)."""
    x = np.asarray(x, dtype=np.float64)
    small = x < 0.5
    y = np.where(small, x + 1, x) - 1
    total = np.full_like(y, 0.99999999999980993)
    for i, k in enumerate(_LANCZOS):
        total += k / (y + i + 1)
    w = y + 7.5
    out = 0.5 * np.log(2 * np.pi) + (y + 0.5) * np.log(w) - w + np.log(total)
    return np.where(small, out - np.log(np.maximum(x, 1e-300)), out)


def _series(c: np.ndarray, t: np.ndarray, d: float, terms: int = 44) -> np.ndarray:
    """log S(c, t) by the binomial expansion of the generating function; its terms cancel little for few tables."""
    once, which = np.unique(c, return_inverse=True)
    j = np.arange(1, terms + 1)
    left = np.maximum(once[:, None] - j * d, 1e-9)
    with np.errstate(divide="ignore"):
        size = gammaln(left) - gammaln(once - d)[:, None] + (gammaln(1 + j * d) + np.log(np.abs(np.sin(np.pi * j * d))))
    sign = np.where(j % 2 == 1, 1.0, -1.0) * np.sign(np.sin(np.pi * j * d))
    cells = (np.exp(np.minimum(size, 700)) * sign)[which] * (j <= c[:, None])
    choose = np.cumprod((t[:, None] - j + 1) / j, axis=1)
    total = np.maximum((cells * np.where(j <= t[:, None], choose, 0)).sum(axis=1), 1e-300)
    return np.log(total / np.pi) + gammaln(once - d)[which] - t * np.log(d) - gammaln(t + 1)


def _short(d: float) -> float:
    """Up to this many times c^d tables the series is used, else the saddle point; between them both are within 0.02 of the truth."""
    return min(max(2 - 3.3 * (d - 0.7), 1.2), 4.0)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) for large c, by series or by saddle point; S(c, c) is 1."""
    c, t = np.asarray(c, dtype=np.float64), np.asarray(t, dtype=np.float64)
    out = np.zeros(c.shape)
    short = (t < _short(d) * c**d) & (t < c)
    for some, f in ((short, _series), (~short & (t < c), _saddle)):
        if some.any():
            out[some] = f(c[some], t[some], d)
    return out


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    # with s = log(1 - z): t * d * z * (1 - z)^(d - 1) / (1 - (1 - z)^d) grows with z; where it is c is found by bisection
    low, high = np.full(c.shape, -60.0 / max(d, 0.05)), np.full(c.shape, -1e-12)
    for _ in range(60):
        mid = 0.5 * (low + high)
        over = -t * d * np.expm1(mid) * np.exp((d - 1) * mid) / -np.expm1(d * mid) > c
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    s = 0.5 * (low + high)
    z, rest = -np.expm1(s), -np.expm1(d * s)
    first = d * z * np.exp((d - 1) * s) / rest
    second = first + first * z * (1 - d) * np.exp(-s) - first * first
    value = t * np.log(rest / d) - c * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(t * second, 1e-300))
    return gammaln(c + 1) - gammaln(t + 1) + value


def _prior(t: np.ndarray, d: float, strength: float, others: np.ndarray, sent: np.ndarray, up: np.ndarray) -> np.ndarray:
    """log of the two products: rises of the own restaurant over t tables, and of the parent over t customers.

    sent: the parent's weight of the dish without them; up: its weight of all dishes.
    """
    base = others + strength / d
    first = np.where(sent > 0, sent, sent + 1)  # where the dish would be new to the parent, its first customer weighs the same for all t
    return t * np.log(d) + gammaln(base + t) - gammaln(base) + gammaln(sent + t) - gammaln(first) - gammaln(up + t) + gammaln(up)


def draw(c: np.ndarray, t: np.ndarray, d: float, strength: float, others: np.ndarray, sent: np.ndarray, up: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables of dishes with c customers, now at t tables; others: the restaurant's tables of other dishes."""
    out = np.asarray(t, dtype=np.int64).copy()
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    table = stirling(d)
    order = few[np.argsort(c[few], kind="stable")]
    starts = np.searchsorted(c[order], np.arange(EXACT + 2))
    for n in range(2, EXACT + 1):
        for at in range(starts[n], starts[n + 1], 1 << 15):
            own = order[at : min(at + (1 << 15), starts[n + 1])]
            j = np.arange(n)
            # the products term by term: cheaper than gamma functions for few customers
            step = np.log(strength + d * (others[own][:, None] + j)) + np.log(np.maximum(sent[own][:, None] + j, 1e-9) / (up[own][:, None] + j))
            p = np.cumsum(step, axis=1) + table[n, 1 : n + 1]
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p = np.cumsum(p, axis=1)
            out[own] = 1 + (p < (rng.random(len(own)) * p[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        n, now, rest = c[many].astype(np.float64), out[many].astype(np.float64), (others[many], sent[many], up[many])
        here = log_stirling(n, now, d) + _prior(now, d, strength, *rest)
        for _ in range(STEPS):
            # steps about as wide as the distribution; the width is fixed by c, so that the proposal is symmetric
            new = now + np.rint(rng.normal(size=len(n)) * np.maximum(1.0, 0.7 * n ** (d / 2)))
            there = np.full(len(n), -np.inf)
            fits = (new >= 1) & (new <= n) & (new != now)
            there[fits] = log_stirling(n[fits], new[fits], d) + _prior(new[fits], d, strength, *(x[fits] for x in rest))
            go = np.log(rng.random(len(n))) < there - here
            now, here = np.where(go, new, now), np.where(go, there, here)
        out[many] = now.astype(np.int64)
    return out
