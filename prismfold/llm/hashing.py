"""Vectorised 64-bit hashes of words and of fixed-length byte strings."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte value.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, up to n."""
    if _powers[0].size <= n:
        size = max(n + 1, 2 * _powers[0].size)
        for k, base in enumerate((_ODD, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words (runs without ASCII white space) of a byte array."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _tables(data.size + 1)
    upto = np.zeros(data.size + 1, np.uint64)
    np.cumsum(BYTES[data] * power[: data.size], out=upto[1:], dtype=np.uint64)
    return mix((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; those that cross texts are for the caller to leave out."""
    count = max(0, words.size - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * _ODD + words[i : i + count]
    return mix(out)


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all byte strings of length n, by doubling."""
    have, size, out, done = BYTES[data], 1, None, 0
    bits, power = n, _ODD
    while True:
        if bits & 1:
            if out is None:
                out, done = have, size
            else:
                count = data.size - done - size + 1
                out = out[:count] * power + have[done : done + count] if count > 0 else np.empty(0, np.uint64)
                done += size
        bits >>= 1
        if not bits:
            return mix(out[: max(0, data.size - n + 1)])
        count = max(0, data.size - 2 * size + 1)
        have = have[:count] * power + have[size : size + count]
        size *= 2
        power = power * power
