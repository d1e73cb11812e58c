"""A cheap permutation of the ids below 2^scale, in wrapping 64-bit arithmetic."""

from __future__ import annotations

import numpy as np

from .rng import draw, seed_state, skip

# Fixed values of the permutation.
ODD0 = 0x4519840211493211
ODD1 = 0x3050852102C843A5
WORD = 0xFFFFFFFF


def reverse_bits(x: np.ndarray) -> np.ndarray:
    """The 64 bits of each value in reverse order."""
    x = np.ascontiguousarray(x, np.uint64)
    by_bit = np.unpackbits(x.view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1)
    return np.packbits(by_bit, axis=1, bitorder="little").view("<u8").reshape(x.shape).astype(np.uint64)


def constants(seed1: int, seed2: int) -> tuple[int, int]:
    """The two numbers that name a permutation, from four draws far down the stream."""
    state, out = skip(seed_state(seed1, seed2), 50, 7, 0), []
    for _ in range(2):
        a, state = draw(state)
        b, state = draw(state)
        out.append((a * WORD + b) & (1 << 64) - 1)
    return out[0], out[1]


def scramble(ids: np.ndarray, scale: int, values: tuple[int, int]) -> np.ndarray:
    """Two rounds of add, multiply by an odd number, and reversal of the lowest bits."""
    if scale == 0:
        return np.zeros(len(ids), np.int64)
    v0, v1 = values
    v = np.asarray(ids).astype(np.uint64)
    with np.errstate(over="ignore"):
        v = v + np.uint64((v0 + v1) & (1 << 64) - 1)
        for factor in (v0 | ODD0, v1 | ODD1):
            v = reverse_bits(v * np.uint64(factor)) >> np.uint64(64 - scale)
    return v.astype(np.int64)
