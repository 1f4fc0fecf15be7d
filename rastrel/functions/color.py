"""Colour conversion and padding."""

from __future__ import annotations

import numpy as np

# BT.601 in 16-bit fixed point.
Y = (16839, 33059, 6420)
U = (-9719, -19081, 28800)
V = (28800, -24116, -4684)


def luma(rgb: np.ndarray) -> np.ndarray:
    """(..., 3) to 0..255."""
    return np.clip((rgb.astype(np.int64) @ np.array(Y) + (1 << 15) + (16 << 16)) >> 16, 0, 255)


def chroma(sums: np.ndarray, weights: tuple[int, int, int]) -> np.ndarray:
    """From the sums of 2x2 pixels."""
    return np.clip((sums.astype(np.int64) @ np.array(weights) + (1 << 17) + (128 << 18)) >> 18, 0, 255)


def even(a: np.ndarray) -> np.ndarray:
    """Odd sizes grow by one row or column, a copy of the last."""
    return np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2), *((0, 0),) * (a.ndim - 2)), mode="edge")


def to_grid(plane: np.ndarray, cell: int) -> np.ndarray:
    """Pads rows and columns with the edge to a multiple of cell."""
    return np.pad(plane, ((0, -plane.shape[0] % cell), (0, -plane.shape[1] % cell)), mode="edge")


def yuv420(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes on the macroblock grid: 16 for luma, 8 for chroma."""
    rgb = even(rgb)
    h, w = rgb.shape[:2]
    sums = rgb.astype(np.int64).reshape(h // 2, 2, w // 2, 2, 3).sum((1, 3))
    return to_grid(luma(rgb), 16), to_grid(chroma(sums, U), 8), to_grid(chroma(sums, V), 8)


def rgb_from_yuv(y: np.ndarray, u: np.ndarray, v: np.ndarray, h: int, w: int) -> np.ndarray:
    """Back to (h, w, 3), chroma repeated."""
    y = y[:h, :w].astype(np.int64)
    u, v = (np.repeat(np.repeat(c, 2, 0), 2, 1)[:h, :w].astype(np.int64) for c in (u, v))
    # The inverse in 14-bit fixed point, 8 + 6 bits.
    yy = (y * 19077) >> 8
    r = (yy + ((v * 26149) >> 8) - 14234) >> 6
    g = (yy - ((u * 6419) >> 8) - ((v * 13320) >> 8) + 8708) >> 6
    b = (yy + ((u * 33050) >> 8) - 17685) >> 6
    return np.clip(np.stack([r, g, b], -1), 0, 255).astype(np.uint8)


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    """Over all channels; -1 for different shapes, 99 for equal ones."""
    if a.shape != b.shape:
        return -1.0
    mse = float(((a.astype(np.int64) - b.astype(np.int64)) ** 2).mean()) if a.size else 0.0
    return 99.0 if mse == 0 else 10 * float(np.log10(255.0**2 / mse))
