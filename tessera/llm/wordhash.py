"""64-bit hashes of words and of runs of words, computed over whole texts at once.

Words are the runs of bytes other than space and \\t \\n \\v \\f \\r. All arithmetic
is modulo 2**64 over numpy arrays: a prefix sum of byte times power gives the hash
of every word by one subtraction, and a second prefix sum over mixed word hashes
gives the hash of every run of words. The multipliers are fixed, so the hashes
are the same in every process. Operators that pick candidates by these hashes confirm
them on the text where they say so; windows of repeated passages (128 bits) and shingles and classes of
near copies (64 bits) are told apart by hashes alone.
"""

from __future__ import annotations

import numpy as np

_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so they have inverses
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 1 << 22:  # longer texts are rare: their tables are not kept
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers_of(base, len(values))[0], out=out[1:])
    return out


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of the words of a UTF-8 text."""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sums = _prefix(b, _BYTE)
    return mix((sums[ends] - sums[starts]) * _powers_of(_BYTE, len(b) + 1)[1][starts] + (ends - starts).astype(np.uint64))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n consecutive words; run i starts at word i."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    sums = _prefix(hashes, _WORD)
    return mix((sums[n:] - sums[:-n]) * _powers_of(_WORD, len(hashes))[1][: len(hashes) - n + 1] + np.uint64(n))
