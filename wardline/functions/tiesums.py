"""Finite sums over ties and counts in closed form, as vectorised numpy.

Sums of 1/m, 1/m^2 and log m over consecutive m are differences of digamma, trigamma and log-gamma.  Taken as such they
cancel, so the differences themselves are expanded (midpoint Euler-Maclaurin from ``SHIFT`` on); the first ``SHIFT`` terms
are added one by one.  The work per element is constant.
"""

from __future__ import annotations

import numpy as np

SHIFT = 24
# Midpoint Euler-Maclaurin factors of the first, third and fifth derivative.
MIDPOINT = (-1 / 24, 7 / 5760, -31 / 967680)


def _tail(derivatives, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Corrections to the integral from ``low`` to ``high``; ``derivatives`` gives the three derivatives at a place."""
    return sum(m * (b - a) for m, a, b in zip(MIDPOINT, derivatives(low), derivatives(high)))


def _blocks(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of 1/m, 1/m^2 and log m for m = x, ..., x + n - 1, x at least ``SHIFT``."""
    v0, v1 = x - 0.5, x + n - 0.5
    lg = np.log1p(n / v0)
    inverse = lg + _tail(lambda v: (-v ** -2, -6 * v ** -4, -120 * v ** -6), v0, v1)
    square = n / (v0 * v1) + _tail(lambda v: (-2 * v ** -3, -24 * v ** -5, -720 * v ** -7), v0, v1)
    logs = n * np.log(v1) + v0 * lg - n + _tail(lambda v: (1 / v, 2 * v ** -3, 24 * v ** -5), v0, v1)
    return inverse, square, logs


def rising(y: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over j < y of 1/(theta+j), 1/(theta+j)^2 and log(theta+j)."""
    y = np.asarray(y, float)
    out = [np.zeros(len(y)) for _ in range(3)]
    for j in range(SHIFT):
        m = np.where(y > j, theta + j, np.nan)
        for total, part in zip(out, (1 / m, 1 / m ** 2, np.log(m))):
            total += np.nan_to_num(part)
    rest = np.maximum(y - SHIFT, 0)
    return tuple(a + b for a, b in zip(out, _blocks(np.full(len(y), theta + SHIFT), rest)))


def _minus_leading(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """With L = -log(1-u) and q = u/(1-u): L - u, q - L, and q - 2L + u, each without cancellation."""
    small = u < 0.1
    s = np.where(small, u, 0.0)
    series = [np.zeros(len(u)) for _ in range(3)]
    power = s.copy()
    for k in range(2, 20):
        power = power * s
        for total, factor in zip(series, (1 / k, 1 - 1 / k, 1 - 2 / k)):
            total += power * factor
    b = np.where(small, 0.0, u)
    lg, q = -np.log1p(-b), b / (1 - b)
    return tuple(np.where(small, a, c) for a, c in zip(series, (lg - b, q - lg, q - 2 * lg + b)))


def efron(d: np.ndarray, s0: np.ndarray, d0: np.ndarray) -> np.ndarray:
    """Over the d tied events of a day, with f = l/d and s = S0 - f*D0 for l = 0, ..., d-1: sums of 1/s, f/s, 1/s^2,
    f/s^2, f^2/s^2 and log s, as six rows.  Days without events or with events of weight 0 are zero.
    """
    d, s0, d0 = (np.asarray(a, float) for a in (d, s0, d0))
    out = np.zeros((6, len(d)))
    use = (d > 0) & (d0 > 0)
    if not use.any():
        return out
    d, s0, d0 = d[use], s0[use], d0[use]
    b = d0 / d  # s = b * m with m = c - l
    c = np.maximum(s0 / b, d)
    one = np.zeros((6, len(d)))  # of 1/m, l/m, 1/m^2, l/m^2, l^2/m^2, log m
    for j in range(1, SHIFT + 1):
        seen = d >= j
        l = np.where(seen, d - j, 0.0)
        m = np.where(seen, c - l, 1.0)
        parts = (1 / m, l / m, 1 / m ** 2, l / m ** 2, (l / m) ** 2, np.log(m))
        one += np.where(seen, np.array(parts), 0.0)
    n = np.maximum(d - SHIFT, 0)
    more = n > 0
    if more.any():
        n, k = n[more], c[more]
        v1, v0 = k + 0.5, k - n + 0.5
        u = n / v1
        p, q, w = _minus_leading(u)
        inverse, square, logs = _blocks(k - n + 1, n)
        lg, flat = -np.log1p(-u), u / (1 - u) / v1
        one[:, more] += np.array([
            inverse,
            v1 * p - lg / 2 + _tail(lambda v: (-k * v ** -2, -6 * k * v ** -4, -120 * k * v ** -6), v0, v1),
            square,
            q - flat / 2 + _tail(lambda v: (v ** -2 - 2 * k * v ** -3, 6 * v ** -4 - 24 * k * v ** -5,
                                            120 * v ** -6 - 720 * k * v ** -7), v0, v1),
            v1 * w - q + flat / 4 + _tail(lambda v: (2 * k * v ** -2 - 2 * k ** 2 * v ** -3, 12 * k * v ** -4 - 24 * k ** 2 * v ** -5,
                                                     240 * k * v ** -6 - 720 * k ** 2 * v ** -7), v0, v1),
            logs])
    out[:, use] = [one[0] / b, one[1] / (b * d), one[2] / b ** 2, one[3] / (b ** 2 * d), one[4] / (b * d) ** 2,
                   one[5] + d * np.log(b)]
    return out
