"""A multiple recursive random number generator with random access.

The state (z1 .. z5) moves by ``z' = (X z1 + Y z5) mod P``; n steps are one
product with the n-th power of a 5 x 5 matrix, so any place of the stream is
reached directly and every task can begin where it likes. Arrays hold values
below P = 2^31 - 1 as uint64: a product stays below 2^62 and is reduced before
sums are taken.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of the generator.
P = 2147483647
X = 107374182
Y = 104480
UNIT = 4.65661287524579692e-10
UNIT2 = 2.168404346990492787e-19

Matrix = tuple[tuple[int, ...], ...]
#: One step; n steps are its n-th power.
STEP: Matrix = ((X, 0, 0, 0, Y), (1, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 1, 0))
IDENTITY: Matrix = tuple(tuple(int(i == j) for j in range(5)) for i in range(5))


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(5)) % P for j in range(5)) for i in range(5))


def power(m: Matrix, n: int) -> Matrix:
    out = IDENTITY
    while n:
        if n & 1:
            out = multiply(out, m)
        m, n = multiply(m, m), n >> 1
    return out


def apply(m: Matrix, state: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sum(m[i][k] * state[k] for k in range(5)) % P for i in range(5))


def seed_state(seed1: int, seed2: int) -> tuple[int, ...]:
    """The first state for two 64-bit seeds: 30 bits each, and what is left in the last place."""
    low = 0x3FFFFFFF
    return ((seed1 & low) + 1, (seed1 >> 30 & low) + 1, (seed2 & low) + 1, (seed2 >> 30 & low) + 1, (seed2 >> 60 << 4) + (seed1 >> 60) + 1)


def skip(state: tuple[int, ...], high: int, middle: int, low: int) -> tuple[int, ...]:
    """The state ``high * 2^128 + middle * 2^64 + low`` steps on."""
    return apply(power(STEP, (high << 128) + (middle << 64) + low), state)


def draw(state: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    state = apply(STEP, state)
    return state[0], state


def draw_real(state: tuple[int, ...]) -> tuple[float, tuple[int, ...]]:
    """A real in [0, 1) from two draws."""
    a, state = draw(state)
    b, state = draw(state)
    return a * UNIT + b * UNIT2, state


def reals(n: int, seed1: int, seed2: int, position: int) -> list[float]:
    """``n`` reals of the stream from a position; a real takes two draws."""
    state, out = skip(seed_state(seed1, seed2), 2, 0, 2 * position), []
    for _ in range(n):
        x, state = draw_real(state)
        out.append(x)
    return out


@lru_cache(maxsize=64)
def byte_powers(byte: int) -> np.ndarray:
    """(256, 5, 5): the powers of the step for each value of one byte of a 192-bit distance."""
    base, out = power(STEP, 1 << 8 * byte), [IDENTITY]
    for _ in range(255):
        out.append(multiply(out[-1], base))
    return np.array(out, np.uint64)


def _product(matrices: np.ndarray, states: np.ndarray) -> np.ndarray:
    return (matrices * states[..., None, :] % P).sum(axis=-1) % P


def states_at(state: tuple[int, ...], indices: np.ndarray, first_byte: int = 8, high: int = 0) -> np.ndarray:
    """(n, 5): the states ``indices * 256^first_byte`` (and ``high * 2^128``) steps on."""
    start = skip(state, high, 0, 0) if high else state
    indices = np.asarray(indices, np.uint64)
    out = np.broadcast_to(np.array(start, np.uint64), (len(indices), 5))
    # neighbours share all bytes but the last, so the rest is done once for each group
    rest, group = np.unique(indices >> np.uint64(8), return_inverse=True)
    shared = np.broadcast_to(np.array(start, np.uint64), (len(rest), 5))
    byte = 1
    left = rest.copy()
    while left.any():
        shared = _product(byte_powers(first_byte + byte)[(left & np.uint64(255)).astype(int)], shared)
        left >>= np.uint64(8)
        byte += 1
    out = shared[group]
    return _product(byte_powers(first_byte)[(indices & np.uint64(255)).astype(int)], out)


def next_draw(states: np.ndarray) -> np.ndarray:
    """One step for every row of ``states``, in place; the draws."""
    new = (states[:, 0] * np.uint64(X) % np.uint64(P) + states[:, 4] * np.uint64(Y) % np.uint64(P)) % np.uint64(P)
    states[:, 1:] = states[:, :-1].copy()
    states[:, 0] = new
    return new
