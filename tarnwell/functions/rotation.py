"""Vectors as signs of random rotations, with the factor that makes their inner products unbiased."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BITS = 512  # at least; a multiple of the dimension


@lru_cache(maxsize=8)
def frame(dim: int, bits: int = BITS) -> np.ndarray:
    """Rotations below each other, the same everywhere: bits x dim."""
    rng = np.random.default_rng([11, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]).astype(np.float32)


def code(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(signs as 0 and 1, correction factors) of rows of unit length."""
    turned = x.astype(np.float32) @ frame(x.shape[1], bits).T
    return (turned > 0).astype(np.uint8), np.abs(turned).sum(axis=1) * np.sqrt(x.shape[1]) / turned.shape[1]


def estimates(q: np.ndarray, packed: np.ndarray, factor: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Unbiased estimates of the inner products of queries of unit length and coded vectors."""
    turned = q.astype(np.float32) @ frame(q.shape[1], bits).T
    signs = np.unpackbits(packed, axis=1)[:, : turned.shape[1]].astype(np.float32) * 2 - 1
    return (turned @ signs.T) * np.sqrt(q.shape[1]) / turned.shape[1] / factor[None, :]
