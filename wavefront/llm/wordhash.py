"""Words of whole batches of texts as 64-bit hashes, without a Python object for a word.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. Its
hash is a polynomial of its bytes modulo 2^64, read off the running sums of a
whole stretch of text, with its bits spread afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import offsets_of

#: Bytes that are hashed at once.
STRETCH = 1 << 20

_rng = np.random.default_rng(20)
#: What each byte adds to a hash, and the base of the polynomial with its inverse.
_ADDED = _rng.integers(1, 1 << 64, 256, np.uint64)
_ADDED[65:91] = _ADDED[97:123]
_BASE = int(_rng.integers(1, 1 << 64, dtype=np.uint64)) | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int) -> np.ndarray:
    out = np.full(STRETCH + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_FORWARD, _BACK = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _polynomials(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of some words of ``raw``; a word that is longer than STRETCH comes alone."""
    if len(raw) <= STRETCH:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_ADDED[raw] * _FORWARD[: len(raw)], out=sums[1:])
        return (sums[ends] - sums[starts]) * _BACK[starts]
    total = 0
    for k, at in enumerate(range(0, len(raw), STRETCH)):
        part = raw[at : at + STRETCH]
        total += int((_ADDED[part] * _FORWARD[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, k * STRETCH, 1 << 64)
    return np.array([total % (1 << 64)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a hash over all places; different ones stay different."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """``hashes`` of all words in order; ``per_text``: how many of them each text has."""

    hashes: np.ndarray
    per_text: np.ndarray
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def last_bytes(self, n: int) -> np.ndarray:
        """The last bytes of each word (A-Z as a-z) as a number, 0 in the place of bytes that it lacks."""
        out = _LOWER[self.raw[self.ends - 1]].astype(np.uint32)
        for k in range(1, n):
            out = out << np.uint32(8) | np.where(self.ends - self.starts > k, _LOWER[self.raw[self.ends - 1 - k]], 0)
        return out


def words(texts: pa.Array) -> Words:
    """The words of some non-null texts. Memory is in proportion to the texts' size."""
    data, offsets = texts.buffers()[2], offsets_of(texts)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    space = _SPACE[raw]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    cuts = offsets[:-1][np.diff(offsets) > 0]  # words end with their text
    first[cuts] = ~space[cuts]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = ~space[cuts]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH, "right")))
        hashes[at:end] = _polynomials(raw[starts[at] : ends[end - 1]], starts[at:end] - starts[at], ends[at:end] - starts[at])
        at = end
    return Words(mixed(hashes), np.diff(np.searchsorted(starts, offsets)), raw, starts, ends)
