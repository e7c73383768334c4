"""All maximal scoring segments of a sequence (Ruzzo and Tompa 1999), and
their extreme-value statistics (Karlin and Altschul 1990, 1993)."""

from __future__ import annotations

import numpy as np


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """``(score, first, end)`` of every maximal segment of whole-number scores.

    Linear time: only positive scores are visited; what lies between is read
    off the running total. A candidate remembers the nearest earlier one that
    starts from a lower total, so a search follows links instead of scanning.
    """
    total = np.concatenate(([0], np.cumsum(scores)))
    low: list[int] = []  # running total before a candidate
    high: list[int] = []  # and after it
    span: list[tuple[int, int]] = []
    back: list[int] = []  # the nearest earlier candidate with a lower start
    for i in np.flatnonzero(scores > 0).tolist():
        lo, hi, first = int(total[i]), int(total[i + 1]), i
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= lo:
                j = back[j]
            if j < 0 or high[j] >= hi:
                break
            lo, first = low[j], span[j][0]  # it reaches above j: joined with it and all between
            del low[j:], high[j:], span[j:], back[j:]
        low.append(lo)
        high.append(hi)
        span.append((first, i + 1))
        back.append(j)
    return [(h - a, f, e) for a, h, (f, e) in zip(low, high, span, strict=True)]


def karlin_lambda(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * values)) = 1; the mean has to be negative."""
    if not (values[share > 0] > 0).any() or float((values * share).sum()) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    above = lambda x: np.log(share[share > 0]) + x * values[share > 0]
    while np.logaddexp.reduce(above(high)) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.logaddexp.reduce(above(mid)) < 0 else (low, mid)
    return high


def evidence(scores: list[float], n: int, lam: float, k: float) -> float:
    """The best sum statistic over the r highest segments of n tokens, for any r."""
    best, total, room = 0.0, 0.0, float(np.log(max(k * max(n, 1), 1.0)))
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += lam * s - room + np.log(r)  # the order of r segments doesn't matter: r!
        best = max(best, total)
        if lam * s + np.log(r + 1) < room:
            break
    return best
