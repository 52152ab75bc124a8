"""Exponentially weighted mean, gaps included.

A value ``x`` that comes ``g`` rows after the one before turns the mean ``y`` into
``(w*y + a*x) / (w + a)`` with ``w = q**g`` and ``q = 1 - a``: the old mean keeps the weight
it has left, and a row without a value changes nothing but that weight.  Without gaps this
is ``q*y + a*x``.  The first value is taken as it is.

Such affine steps ``y -> A*y + B`` are composed with those 1, 2, 4, ... rows before, so that
every row ends up with all steps of its series.  All ``A`` are at most 1 and nothing cancels out.
"""

from __future__ import annotations

import math

import numpy as np


def alpha_for_span(span: float) -> float:
    return 2.0 / (span + 1.0)


def memory_rows(alpha: float) -> int:
    """Values after which an old one's weight drops below 2**-53; each keeps at most q of it."""
    return math.ceil(53 * math.log(2) / -math.log1p(-alpha))


def exponential_mean(x: np.ndarray, given: np.ndarray, at: np.ndarray, alpha: float, min_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean at every row, what it was on rows without a value, and where ``min_periods`` values were seen.

    ``at`` is the row within the series, whose rows follow one another.
    """
    q, index = 1.0 - alpha, np.arange(len(x))
    start = index - at
    count = np.cumsum(given)
    n = count - (count - given)[start]
    last = np.maximum.accumulate(np.where(given, index, -1))
    gap = index - np.concatenate([[-1], last[:-1]])
    left = np.power(q, gap)
    step = given & (n > 1)
    total = np.where(gap == 1, 1.0, left + alpha)
    a = np.where(step, left / total, np.where(given, 0.0, 1.0))
    b = np.where(step, alpha * x / total, np.where(given, x, 0.0))
    d, longest = 1, int(at.max(initial=0))
    while d <= longest:
        same = at[d:] >= d
        b[d:] = np.where(same, a[d:] * b[:-d] + b[d:], b[d:])
        a[d:] = np.where(same, a[d:] * a[:-d], a[d:])
        d *= 2
    return b, n >= min_periods
