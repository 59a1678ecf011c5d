"""Vectorised 64-bit hashes of the words of a text, on its UTF-8 bytes.

A word's hash is a polynomial in an odd multiplier, modulo 2^64, mixed afterwards. It is read off prefix
sums, so one pass of array arithmetic hashes all words of a block. Blocks are cut at white space, which
bounds the memory for texts of any length (a block only grows beyond BLOCK for a single longer word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the multiplier and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK + 1)
            factors = np.full(n, _R)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = _R_INVERSE
            self.down = np.multiply.accumulate(factors)


_powers = _Powers()


def run_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the runs of bytes from `start` to `end` of a block."""
    _powers.to(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[b] if lower else b).astype(np.uint64) * _powers.up[: len(b)], out=sums[1:])
    value = (sums[end] - sums[start]) * _powers.down[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _block_words(b: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a block of bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[b], [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    return start, end, run_hashes(b, start, end, lower)


def blocks(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Offset and bytes of consecutive blocks that end at white space."""
    whole, at = np.frombuffer(data, dtype=np.uint8), 0
    while at < len(whole):
        stop = min(at + BLOCK, len(whole))
        while stop < len(whole) and not _SPACE[whole[stop - 1]]:
            gap = np.flatnonzero(_SPACE[whole[stop : stop + BLOCK]])
            stop = stop + int(gap[0]) + 1 if len(gap) else min(stop + BLOCK, len(whole))
        yield at, whole[at:stop]
        at = stop


def words(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of the words (runs without ASCII white space) of `data`.

    With `lower`, A-Z count as a-z.
    """
    found = [(at + s, at + e, h) for at, b in blocks(data) for s, e, h in [_block_words(b, lower)]]
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]
