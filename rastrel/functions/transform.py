"""Integer transforms over stacks of 4x4 blocks (..., 4, 4); all shifts floor."""

from __future__ import annotations

import numpy as np


def fdct(block: np.ndarray) -> np.ndarray:
    """Forward transform of residual blocks."""
    d = block.astype(np.int64)
    outer, inner = d[..., 0] + d[..., 3], d[..., 1] + d[..., 2]
    low, high = d[..., 1] - d[..., 2], d[..., 0] - d[..., 3]
    t = np.stack([8 * (outer + inner), (2217 * low + 5352 * high + 1812) >> 9, 8 * (outer - inner), (2217 * high - 5352 * low + 937) >> 9], -1)
    outer, inner = t[..., 0, :] + t[..., 3, :], t[..., 1, :] + t[..., 2, :]
    low, high = t[..., 1, :] - t[..., 2, :], t[..., 0, :] - t[..., 3, :]
    return np.stack([(outer + inner + 7) >> 4, ((2217 * low + 5352 * high + 12000) >> 16) + (high != 0), (outer - inner + 7) >> 4, (2217 * high - 5352 * low + 51000) >> 16], -2)


def fwht(dc: np.ndarray) -> np.ndarray:
    """Forward Walsh-Hadamard transform of the 4x4 DC values."""

    def half(x: np.ndarray, axis: int) -> np.ndarray:
        a, b, c, d = (np.take(x, i, axis) for i in range(4))
        even, odd, up, down = a + c, b + d, a - c, b - d
        return np.stack([even + odd, up + down, up - down, even - odd], axis)

    return half(half(dc.astype(np.int64), -1), -2) >> 1


def iwht(c: np.ndarray) -> np.ndarray:
    """Inverse Walsh-Hadamard transform: the DC values of the 16 blocks."""

    def half(x: np.ndarray, axis: int, add: int) -> np.ndarray:
        a, b, c2, d = (np.take(x, i, axis) for i in range(4))
        a = a + add
        out, mid, diff, spread = a + d, b + c2, b - c2, a - d
        return np.stack([out + mid, spread + diff, out - mid, spread - diff], axis)

    return half(half(c.astype(np.int64), -2, 0), -1, 3) >> 3


def idct(c: np.ndarray) -> np.ndarray:
    """Inverse transform of dequantised blocks, the residual to add to the prediction."""
    big = lambda x: ((x * 20091) >> 16) + x
    small = lambda x: (x * 35468) >> 16

    def half(x: np.ndarray, axis: int) -> np.ndarray:
        a, b, c2, d = (np.take(x, i, axis) for i in range(4))
        s, t = a + c2, a - c2
        u, v = small(b) - big(d), big(b) + small(d)
        return np.stack([s + v, t + u, t - u, s - v], axis)

    x = half(c.astype(np.int64), -2)
    x[..., 0] += 4
    return half(x, -1) >> 3
