"""Words, shingles and hashes of whole texts, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: fixed values: the white space that parts words, bytes 0x20 and 0x09 to 0x0D
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        step = np.uint64(pow(int(base), done, 1 << 64))
        out[done : done + take] = out[:take] * step
        done += take
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[e] - p[s] = base**s * hash of data[s:e], modulo 2**64."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=p[1:])
    return p


def range_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] from prefix_hash; equal bytes give equal hashes."""
    return mixed((p[end] - p[start]) * inverse[start])


def inverse_powers(n: int) -> np.ndarray:
    return powers(_BASE_INV, n)


def word_bounds(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of some bytes that hold texts in a row; no word spans two texts.

    begins: the first byte of each text, then the number of bytes.
    """
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = WHITE[data]
    other = np.zeros(len(data) + 1, bool)
    other[begins] = True
    solid = ~white
    return np.flatnonzero(solid[1:] & (white[:-1] | other)), np.flatnonzero(solid[:-1] & (white[1:] | other))


def chained(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words in a row; one for all words if there are fewer; none for none."""
    if not len(word):
        return word
    if len(word) < n:
        n = len(word)
    h = word[: len(word) - n + 1].copy()
    for i in range(1, n):
        h *= _ODD
        h ^= word[i : len(word) - n + 1 + i]
        h ^= h >> np.uint64(29)
    return mixed(h)
