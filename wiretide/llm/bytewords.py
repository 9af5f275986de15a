"""Words of many texts at once, as positions and hashes over their UTF-8 bytes."""

from __future__ import annotations

import functools

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15


def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and keeps every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def alnum_table() -> np.ndarray:
    """Bytes of words made of digits, letters and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def words(buffer: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of ``letters`` and the row that holds it; no word crosses a row border."""
    if buffer.size == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = letters[buffer]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    borders = offsets[offsets < buffer.size]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[borders[borders > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_PAGE_BITS = 16


@functools.lru_cache(maxsize=64)
def _powers(base: int, count: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    steps = np.full(count, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _power(base: int, places: np.ndarray, largest: int) -> np.ndarray:
    """base ** place for each place, from two small tables."""
    low = _powers(base, 1 << _PAGE_BITS)
    high = _powers(pow(base, 1 << _PAGE_BITS, 1 << 64), (largest >> _PAGE_BITS) + 1)
    return high[places >> _PAGE_BITS] * low[places & ((1 << _PAGE_BITS) - 1)]


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(29)
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice: a polynomial in its bytes, from prefix sums over the whole buffer."""
    sums = np.zeros(buffer.size + 1, np.uint64)
    np.cumsum(_byte_values()[buffer] * _power(_MULTIPLIER, np.arange(buffer.size), buffer.size), out=sums[1:])
    back = _power(pow(_MULTIPLIER, -1, 1 << 64), starts, buffer.size)
    return mixed((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))
