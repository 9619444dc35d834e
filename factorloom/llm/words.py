"""Words and window hashes of whole Arrow batches with NumPy.

A word's hash is a chain over its bytes, eight at a time, with a bijection of 64
bits between them, so no arrangement of its letters cancels out. A window's hash is
a polynomial over its words' hashes modulo 2**64, taken from prefix sums: a prefix
sum over ``value * base**position`` gives the hash of any range as a difference
times a power of the inverse base. That is sound for windows of up to 512 words;
far longer ones could cancel out in the power of two.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: White space that separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F | 1))
WIDEST = 512  # words of a window
_LANES = 32  # of eight bytes; longer words are hashed by themselves
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1), or of its inverse."""
    found = _powers.get((int(base), inverse))
    if found is None or len(found) < n:
        step = np.uint64(pow(int(base), -1, 2**64)) if inverse else base
        found = np.full(max(n, 1 << 17), step, np.uint64)
        found[0] = 1
        found = np.cumprod(found, dtype=np.uint64)
        if n <= 1 << 21:
            _powers[int(base), inverse] = found
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(base, n), out=total[1:])
    return (total[ends] - total[starts]) * _power(base, n + 1, True)[starts]


def split(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) + _STEP)
    lanes = np.ndarray((len(data) + 1,), np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    at, left = np.arange(len(starts)), lengths
    for lane in range(_LANES):
        if not len(at):
            break
        some = lanes[starts[at] + 8 * lane] & _MASKS[np.minimum(left, 8)]
        out[at] = mix((out[at] + _STEP) ^ some)
        more = left > 8
        at, left = at[more], left[more] - 8
    for i in at:
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_hashes(words: np.ndarray, width: int, which: int = 0, most: int = 1 << 19) -> np.ndarray:
    """The hash of ``words[p : p + width]`` for each p where it fits; ``which`` chooses one of two independent hashes."""
    if width > WIDEST:
        raise ValueError(f"a window has at most {WIDEST} words")
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(count, np.uint64)
    for i in range(0, count, most):
        j = min(i + most, count)
        part = words[i : j + width - 1]
        part = mix(part + np.uint64(0x632BE59BD9B4E019)) if which else part
        at = np.arange(j - i)
        out[i:j] = mix(_ranges(part, at, at + width, _BASES[which]))
    return out
