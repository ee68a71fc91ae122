"""Words of UTF-8 bytes as NumPy arrays of 64-bit hashes, for functions that run inside tasks."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PIECE = 1 << 18
_UP = np.cumprod(np.full(_PIECE + 1, _BASE, dtype=np.uint64))
_DOWN = np.cumprod(np.full(_PIECE + 1, _INVERSE, dtype=np.uint64))

#: A-Z lower-cased, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but the six white-space bytes; or letters, digits and non-ASCII bytes only.
PLAIN = np.ones(256, dtype=bool)
PLAIN[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes, inside: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Of each word in order: its hash, lower-cased, and its first byte's place. A word's hash is a polynomial of its bytes."""
    hashes, places, at = [], [], 0
    codes = np.frombuffer(text, dtype=np.uint8)
    while at < len(codes):
        piece = codes[at : at + _PIECE]
        word = inside[piece]
        if at + _PIECE < len(codes) and word[-1]:  # end behind a white space, if there is one
            gaps = np.flatnonzero(~word)
            if len(gaps):
                piece, word = piece[: gaps[-1] + 1], word[: gaps[-1] + 1]
            else:
                return _slow(text, inside)
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[LOWER[piece]] * _UP[: len(piece)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * _DOWN[start]))
        places.append(start + at)
        at += len(piece)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def _slow(text: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts with a word longer than a piece: the same hashes, by arrays as long as the text."""
    codes = np.frombuffer(text, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(inside[codes], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    up = np.cumprod(np.full(len(codes), _BASE, dtype=np.uint64))
    down = np.cumprod(np.full(len(codes), _INVERSE, dtype=np.uint64))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[LOWER[codes]] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes; with fewer words, one hash of them all (none: no hash)."""
    n = min(n, len(words))
    if n == 0:
        return words
    h = words[: len(words) - n + 1]
    for k in range(1, n):
        h = mix(h * _BASE + words[k : len(words) - n + 1 + k])
    return h
