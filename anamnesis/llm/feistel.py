"""Keyed pseudorandom permutations of 0..n-1: a balanced Feistel network with cycle-walking, vectorised."""

from __future__ import annotations

import numpy as np

from .common import mix

ROUNDS = 6


def _halves(n: int) -> tuple[np.uint64, np.uint64]:
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    return np.uint64(half), np.uint64((1 << half) - 1)


def _round_keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([key & (2**64 - 1)], np.uint64)))


def _once(x: np.ndarray, half: np.uint64, mask: np.uint64, keys: np.ndarray, back: bool) -> np.ndarray:
    left, right = x >> half, x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix(left + k) & mask), left
        else:
            left, right = right, left ^ (mix(right + k) & mask)
    return left << half | right


def _walk(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    half, mask = _halves(n)
    keys = _round_keys(key)
    out = _once(np.asarray(x, np.uint64).copy(), half, mask, keys, back)
    beyond = np.flatnonzero(out >= n)
    while len(beyond):  # the domain is under 4 n, so few steps follow
        out[beyond] = _once(out[beyond], half, mask, keys, back)
        beyond = beyond[out[beyond] >= n]
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each index of 0..n-1 goes."""
    return _walk(x, n, key, False)


def invert(y: np.ndarray, n: int, key: int) -> np.ndarray:
    """Which index goes to each place."""
    return _walk(y, n, key, True)
