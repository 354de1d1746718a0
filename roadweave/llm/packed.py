"""Compact arrays for shuffles: a few large binary rows instead of millions of small ones."""

from __future__ import annotations

import numpy as np


def pack(a: np.ndarray) -> bytes:
    """Whole numbers at the smallest width that holds them; sorted ones as differences."""
    a = np.asarray(a, np.int64)
    if not len(a):
        return b""
    ordered = bool((a[1:] >= a[:-1]).all())
    base = int(a[0] if ordered else a.min())
    rest = np.diff(a, prepend=a[0]) if ordered else a - base
    most = int(rest.max()) if int(rest.min()) >= 0 else 2**63 - 1  # a difference that wrapped keeps full width
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w) or w == 8)
    return bytes([width, ordered]) + base.to_bytes(8, "little", signed=True) + rest.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    rest = np.frombuffer(data, f"<u{data[0]}", offset=10).astype(np.int64)
    base = int.from_bytes(data[2:10], "little", signed=True)
    return np.cumsum(rest) + base if data[1] else rest + base


def low_bytes(a: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def mix(a: np.ndarray) -> np.ndarray:
    """Evenly spread 64-bit values."""
    a = a.astype(np.uint64)
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def deal(a: np.ndarray, n: int) -> np.ndarray:
    return (mix(a) % np.uint64(n)).astype(np.int64)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Positions at which a new group begins in arrays that are sorted by the keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)
