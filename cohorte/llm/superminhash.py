"""SuperMinHash signatures (Ertl 2017), many sets at a time.

Each element draws a random permutation of the signature's places, step by
step; at step ``j`` it offers the value ``j + r`` with ``r`` in [0, 1) to its
next place, and a place keeps its least offer. The offers of one element are
ranks of one permutation, so the places are negatively correlated and the
similarity estimate varies less than with independent hash functions.

All sets of a batch take step ``j`` together. Offers of step ``j + 1`` are at
least ``j + 1``, so a set whose places all hold less than that is finished
(the early stop): a large set needs one or two steps.
"""

from __future__ import annotations

import numpy as np

from cohorte.llm.shingles import GOLDEN, mix

#: Elements handled at once; bounds the permutation table (one byte a place).
ELEMENTS = 120_000
_STEP = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of ``m`` unsigned 64-bit places (step in the upper half) per set."""
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    first = size = 0
    for i, s in enumerate(sets):
        if i > first and size + len(s) > ELEMENTS:
            _fill(out[first:i], sets[first:i])
            first, size = i, 0
        size += len(s)
    if sets:
        _fill(out[first:], sets[first:])
    return out


def _fill(out: np.ndarray, sets: list[np.ndarray]) -> None:
    m = out.shape[1]
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = None
    steps = np.arange(1, m + 1, dtype=np.uint64) * GOLDEN
    for j in range(m):
        if not len(elements):
            return
        drawn = mix(elements + steps[j])
        pick = ((drawn & _LOW) * np.uint64(m - j) >> _STEP).astype(np.int64) + j
        if order is None:
            place = pick
        else:
            rows = np.arange(len(elements))
            place = order[rows, pick]
            order[rows, pick] = order[:, j]
        np.minimum.at(flat, owner * m + place, (np.uint64(j) << _STEP) | (drawn >> _STEP))
        left = (out.max(axis=1) >= (np.uint64(j + 1) << _STEP))[owner]
        if order is None:
            elements, owner, pick = elements[left], owner[left], pick[left]
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
            order[np.arange(len(elements)), pick] = 0
        elif not left.all():
            elements, owner, order = elements[left], owner[left], order[left]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` places (len(sig) x bands)."""
    part = mix(sig[:, : bands * rows] + GOLDEN).reshape(len(sig), bands, rows)
    place = mix(np.arange(1, rows + 1, dtype=np.uint64) * GOLDEN)
    number = np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
    return mix((part * place).sum(axis=2, dtype=np.uint64) + number)
