"""Hashes of words and word shingles, computed for many texts at a time.

Words are ``[^\\x20\\x09-\\x0D]+``.  A word's 64-bit hash is a polynomial in its
bytes, taken from running sums, and mixed; the bytes are worked through in blocks
of about a quarter of a million, so one very long text needs no more memory than many short ones
(but for eight bytes a word).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

BLOCK = 1 << 18  # a worker keeps 32 bytes for each of them, and works on about as much
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NO_MARKS = bytes(32 if i < 128 and not chr(i).isalnum() and not _IS_SPACE[i] else i for i in range(256))
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(size, base % 2**64, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_STEP), of(pow(_STEP, -1, 2**64))


def _block_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and where the words begin."""
    data = np.frombuffer(body, np.uint8)
    edge = np.diff(_IS_SPACE[data].view(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = BLOCK * 2
    while size < len(data):
        size *= 2
    power, inverse = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start]), start


def folded(text: str | None) -> bytes:
    """Lower case, ASCII punctuation as blanks."""
    return (text or "").lower().encode().translate(_NO_MARKS)


def hash_words(texts: list[str | None], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the bounds of each text among them (one more than there are texts)."""
    bodies = [folded(t) if fold else (t or "").encode() for t in texts]
    joined = b"\n".join(bodies)
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(joined):
        to = at + BLOCK
        if to < len(joined):
            space = _SPACE.search(joined, to)
            to = space.end() if space else len(joined)
        found, start = _block_hashes(joined[at:to])
        hashes.append(found)
        starts.append(start + at)
        at = to
    ends = np.cumsum([len(b) + 1 for b in bodies])
    bounds = np.searchsorted(np.concatenate(starts), ends)
    return np.concatenate(hashes), np.concatenate([[0], bounds]).astype(np.int64)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; a shorter text with any words is one run."""
    if not len(words):
        return words
    size = max(1, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(min(n, len(words))):
        out = out * np.uint64(0xD1342543DE82EF95) + words[k : k + size]
    return mix(out)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order, from running sums, so long runs cost no more than short ones; a shorter text has none."""
    if len(words) < n:
        return words[:0]
    size = BLOCK * 2
    while size < len(words):
        size *= 2
    power, inverse = _powers(size)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse[: len(words) - n + 1])
