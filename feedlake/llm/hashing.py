"""Array forms of rolling hashes and of Golomb-Rice codes for sorted hashes."""

from __future__ import annotations

import numpy as np

FACTOR = 0x9E3779B97F4A7C15
_SEEDED = np.random.default_rng(20240611)
BYTE = _SEEDED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = FACTOR) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept while the worker lives."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps)
        _powers[base] = known if n <= (8 << 20) else _powers.get(base, known[:1])
    return known[:n]


INVERSE = pow(FACTOR, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any byte ranges of one array, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, INVERSE)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rice_encode(values: np.ndarray, low: int) -> bytes:
    """Golomb-Rice code of sorted hashes at or above ``low``; repeated values are allowed."""
    n = len(values)
    if not n:
        return b""
    steps = np.diff(values, prepend=np.uint64(low))
    mean = (int(values[-1]) - low) / n
    k = max(0, int(mean * 0.6931).bit_length() - 1)
    high, rest = (steps >> np.uint64(k)), steps & np.uint64((1 << k) - 1)
    ends = np.cumsum(high.astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    whole, odd = divmod(k, 8)
    parts = [np.array([n, k], "<u4").tobytes(), np.ascontiguousarray(rest.view(np.uint8).reshape(n, 8)[:, :whole]).tobytes()]
    if odd:
        top = (rest >> np.uint64(8 * whole)).astype(np.uint8)
        parts.append(np.packbits(np.unpackbits(top[:, None], axis=1)[:, 8 - odd :].ravel()).tobytes())
    parts.append(np.packbits(unary).tobytes())
    return b"".join(parts)


def rice_decode(code: bytes, low: int) -> np.ndarray:
    if not code:
        return np.zeros(0, np.uint64)
    n, k = (int(x) for x in np.frombuffer(code, "<u4", 2))
    whole, odd = divmod(k, 8)
    at = 8 + n * whole
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :whole] = np.frombuffer(code, np.uint8, n * whole, 8).reshape(n, whole)
    rest = rest.view("<u8").ravel()
    if odd:
        size = (n * odd + 7) // 8
        bits = np.unpackbits(np.frombuffer(code, np.uint8, size, at), count=n * odd).reshape(n, odd)
        top = np.packbits(np.concatenate([np.zeros((n, 8 - odd), np.uint8), bits], axis=1), axis=1).ravel()
        rest = rest | (top.astype(np.uint64) << np.uint64(8 * whole))
        at += size
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, offset=at)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    return np.uint64(low) + np.cumsum((high.astype(np.uint64) << np.uint64(k)) | rest)


def owner_bounds(owners: int, bits: int) -> np.ndarray:
    """First hash of each owner, and the end of the last: equal shares of 0 .. 2 ** bits."""
    return np.array([((1 << bits) * i) // owners for i in range(owners + 1)], dtype=object)


def split_by_owner(values: np.ndarray, owners: int, bits: int) -> list[tuple[int, int, int, int]]:
    """(owner, first, end, low) for the owners that have any of the sorted values."""
    bounds = owner_bounds(owners, bits)
    cuts = np.searchsorted(values, np.array([int(b) for b in bounds[1:-1]], np.uint64))
    edges = [0, *cuts.tolist(), len(values)]
    return [(i, a, b, int(bounds[i])) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
