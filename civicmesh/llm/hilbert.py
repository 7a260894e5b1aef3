"""Hilbert keys of points on a grid, for many points at once."""

from __future__ import annotations

import numpy as np


def _digits(cells: np.ndarray, bits: int) -> np.ndarray:
    """Per dimension and row of ``cells`` (integers below 2 ** bits), the bits that it adds to the position along the Hilbert curve.

    From the coarsest bit plane on, each dimension's set bit flips the first one's lower bits and a clear bit swaps them with its own;
    Gray decoding of the planes then gives the digits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for d in range(dims):
            is_set = (x[d] >> plane & 1).astype(bool)
            swap = np.where(is_set, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> plane & 1, (1 << plane) - 1, 0)
    return x ^ turn


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells`` (integers below 2 ** bits); dimensions times bits must be below 63."""
    x = _digits(cells, bits)
    key = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = key << 1 | (x[d] >> plane & 1)
    return key


def hilbert_bytes(cells: np.ndarray, bits: int) -> np.ndarray:
    """The same positions of up to 62 bits and eight dimensions, a byte for each bit plane from the coarsest on, so that rows of bytes compare like them."""
    x = _digits(cells, bits)
    return np.stack([sum((row >> plane & 1) << len(x) - 1 - d for d, row in enumerate(x)).astype(np.uint8) for plane in range(bits - 1, -1, -1)], axis=1)
