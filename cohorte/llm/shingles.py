"""Vectorised word and shingle hashes of whole texts (numpy, inside tasks).

Words are runs of bytes other than ASCII white space, lower-cased for A-Z.
A batch of texts is hashed at once: a prefix sum of byte codes times powers
of an odd base gives every word's polynomial hash (modulo 2**64) as one
subtraction, so the cost is a few array passes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator (public domain)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed)) | np.uint64(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = stream(11, 256)
_BASE = stream(12, 1)[0]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = stream(13, 64)
_LENGTH = stream(14, 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 4096)
        both = []
        for base in (_BASE, _INVERSE):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers = (both[0], both[1])
    return _powers


def word_spans(texts: list[bytes], space_of: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, where their words start and end, and where each text begins (len(texts) + 1)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = space_of[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return buf, edge[0::2], edge[1::2], offsets


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers of the base, for :func:`hash_between`."""
    up, _ = powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=prefix[1:])
    return prefix


def hash_between(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings ``starts:ends`` of the buffer summed in ``prefix``."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and where each text's words begin (len(texts) + 1)."""
    buf, starts, ends, offsets = word_spans([t.lower() for t in texts])
    return hash_between(prefix_sums(buf), starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles.

    With fewer than ``k`` words the whole sequence is the one shingle; no
    words, or no text, give an empty set.
    """
    whole = [t or b"" for t in texts]
    for a, b in chunks(whole):
        yield from _sets(whole[a:b], k)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about CHUNK bytes."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    words, at = word_hashes(texts)
    if len(words) >= k:
        full = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            full += words[j : len(words) - k + 1 + j] * _PLACE[j]
        full = mix(full)
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            n = b - a
            yield mix((words[a:b] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _LENGTH[n])
        else:
            yield np.empty(0, np.uint64)
