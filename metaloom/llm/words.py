"""Hashes of all words of a byte string at once, in memory that a very long text doesn't raise."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed together, more only where a single word is longer.
CHUNK = 1 << 20
_seeded = np.random.Generator(np.random.PCG64(20))
_BYTES = _seeded.integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = 1 << (n - 1).bit_length()
            cls.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, _BASE, np.uint64))))
            cls.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, _UNBASE, np.uint64))))
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed_words(raw: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of raw and the bytes at which they start; inside says of each byte value whether it belongs to words."""
    data, hashes, places = np.frombuffer(raw, np.uint8), [], []
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + CHUNK)
        while end < len(data) and inside[data[end]]:  # to the end of the word
            outside = np.flatnonzero(~inside[data[end : end + CHUNK]])
            end += int(outside[0]) if len(outside) else min(CHUNK, len(data) - end)
        part = data[begin:end]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside[part], [False]))))
        starts, ends = edges[::2], edges[1::2]
        up, down = _Powers.of(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * up[:-1])))
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + begin)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)
