"""Whole-array tokenising and shingle hashing for batches of texts (numpy, no per-token Python)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 white space, 1 letter, digit or underscore, 2 anything else."""
    out = np.full(0x110000, 2, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() or c == "_":
            out[i] = 1
        elif c.isspace():
            out[i] = 0
    return out


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(texts: list[str], words_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in order, and the offset of each text's first token.

    A token is the longest run of letters, digits and underscores, or any other single character that
    is not white space; with ``words_only``, a run that begins with no digit.
    """
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 << max(16, int(len(points)).bit_length())
    up, down = _powers(size)
    cls = _classes()[points]
    word, other = cls == 1, cls == 2
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    if words_only:
        other[:] = False
    starts, ends = np.flatnonzero(first | other), np.flatnonzero(last | other) + 1
    if words_only:
        letter = (points[starts] < 48) | (points[starts] > 57)
        starts, ends = starts[letter], ends[letter]
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint32(1)).astype(np.uint64) * up[: len(points)], out=sums[1:])
    tokens = mix((sums[ends] - sums[starts]) * down[starts])
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return tokens, np.searchsorted(starts, text_at)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` tokens."""
    tokens, at = token_hashes(texts)
    n = len(tokens) - k + 1
    if n <= 0:
        return [np.zeros(0, np.uint64) for _ in texts]
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _STEP + tokens[i : i + n]
    h = mix(h)
    return [np.unique(h[a : max(a, b - k + 1)]) for a, b in zip(at[:-1], at[1:])]
