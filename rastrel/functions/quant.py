"""Quantiser set-up: the dimension table (quality, plane, position) that quantising joins with."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed values (RFC 6386, section 14.1): quantiser steps by index, and the scan order of a 4x4 block.
DC = [
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28,
    29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118, 122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
]
AC = [
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35,
    36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76,
    78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108, 110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152,
    155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209, 213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
]
ZIGZAG = [0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15]
# How much luma AC coefficients are sharpened by position, and the rounding biases (DC, AC).
SHARPEN = [0, 30, 60, 90, 30, 60, 90, 90, 60, 90, 90, 90, 90, 90, 90, 90]
BIAS = {"y1": (96, 110), "y2": (96, 108), "uv": (110, 115)}
FIX, MOST = 17, 2047


def quality_index(quality: float) -> int:
    """The quantiser index of a quality from 1 to 100."""
    share = min(max(quality, 1), 100) / 100
    line = 2 * share / 3 if share < 0.75 else 2 * share - 1
    return int(127 * (1 - line ** (1 / 3)))


@dataclass(frozen=True)
class Steps:
    """Per position: step, reciprocal, rounding bias, zero threshold, sharpening."""

    q: np.ndarray
    iq: np.ndarray
    bias: np.ndarray
    zero: np.ndarray
    sharpen: np.ndarray

    @property
    def mean(self) -> int:
        return (int(self.q.sum()) + 8) >> 4


def _steps(plane: str, dc: int, ac: int) -> Steps:
    q = np.full(16, ac, np.int64)
    q[0] = dc
    bias = np.full(16, BIAS[plane][1] << (FIX - 8), np.int64)
    bias[0] = BIAS[plane][0] << (FIX - 8)
    iq = (1 << FIX) // q
    sharpen = np.array(SHARPEN) * q >> 11 if plane == "y1" else np.zeros(16, np.int64)
    return Steps(q, iq, bias, ((1 << FIX) - 1 - bias) // iq, sharpen)


def matrices(index: int) -> dict[str, Steps]:
    """The three sets of steps of a quantiser index."""
    return {
        "y1": _steps("y1", DC[index], AC[index]),
        "y2": _steps("y2", 2 * DC[index], max(8, AC[index] * 155 // 100)),
        "uv": _steps("uv", DC[min(max(index - 2, 0), 117)], AC[index]),
    }


def filter_level(index: int) -> int:
    level = min(AC[index] >> 2, 63) * 300 // 356
    return level if level >= 2 else 0


def table(qualities: range = range(1, 101)) -> list[tuple]:
    """Rows (quality, plane, k, q, iq, bias, zero, sharpen) of the dimension table: 48 a quality."""
    return [(q, p, k, *(int(a[k]) for a in (s.q, s.iq, s.bias, s.zero, s.sharpen))) for q in qualities for p, s in matrices(quality_index(q)).items() for k in range(16)]


SCHEMA = "quality int, plane string, k int, q long, iq long, bias long, zero long, sharpen long"


def quantize(coeffs: np.ndarray, s: Steps) -> np.ndarray:
    """Levels of (..., 16) raster coefficients, in raster order."""
    size = np.abs(coeffs) + s.sharpen
    level = np.minimum((size * s.iq + s.bias) >> FIX, MOST)
    return np.where(size > s.zero, np.sign(coeffs) * level, 0)


def dequantize(levels: np.ndarray, s: Steps) -> np.ndarray:
    return levels * s.q
