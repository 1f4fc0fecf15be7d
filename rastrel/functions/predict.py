"""Intra prediction: whole blocks (DC, TM, V, H) and the ten 4x4 modes."""

from __future__ import annotations

import numpy as np

DC, TM, VERTICAL, HORIZONTAL = range(4)
ABOVE_FRAME, LEFT_OF_FRAME = 127, 129


def whole(top: np.ndarray, left: np.ndarray, corner: np.ndarray, has_top, has_left) -> np.ndarray:
    """The four predictions (..., 4, n, n) from top (..., n), left (..., n) and corner (...); has_top and has_left: bools or (...)."""
    n = top.shape[-1]
    bits = n.bit_length() - 1
    t, lf = top.sum(-1), left.sum(-1)
    one = (np.where(has_top, t, lf) + n // 2) >> bits
    dc = np.where(np.logical_and(has_top, has_left), (t + lf + n) >> (bits + 1), np.where(np.logical_or(has_top, has_left), one, 128))
    shape = (*top.shape[:-1], n, n)
    rows, cols = np.broadcast_to(left[..., :, None], shape), np.broadcast_to(top[..., None, :], shape)
    tm = np.clip(rows + cols - corner[..., None, None], 0, 255)
    return np.stack([np.broadcast_to(dc[..., None, None], shape), tm, cols, rows], -3)


# The edge of a 4x4 block is 13 pixels: left from the bottom up (0-3), corner (4), top and top right (5-12).
# Modes after the first three smooth along the edge: three or two pixels around a place of it. A mode is a
# 4x4 grid of (place, taps); the grids are built from the direction each mode runs in.


def _grid(f) -> np.ndarray:
    return np.array([[f(y, x) for x in range(4)] for y in range(4)])


_DOWN_RIGHT = _grid(lambda y, x: (4 + x - y, 3))
_DOWN_LEFT = _grid(lambda y, x: (6 + x + y, 3))


def _vr(y: int, x: int) -> tuple[int, int]:
    k = 2 * x - y
    if k >= 0:
        return (4 + k // 2, 2) if k % 2 == 0 else (4 + (k + 1) // 2, 3)
    return (4, 3) if k == -1 else (5 - y, 3)


def _hd(y: int, x: int) -> tuple[int, int]:
    k = 2 * y - x
    if k >= 0:
        return (3 - k // 2, 2) if k % 2 == 0 else (4 - (k + 1) // 2, 3)
    return (4, 3) if k == -1 else (3 + x, 3)


def _vl(y: int, x: int) -> tuple[int, int]:
    if (y, x) == (2, 3):
        return 10, 3
    if (y, x) == (3, 3):
        return 11, 3
    return (5 + x + y // 2, 2) if y % 2 == 0 else (6 + x + y // 2, 3)


def _hu(y: int, x: int) -> tuple[int, int]:
    k = 2 * y + x
    if k > 5:
        return 0, 1
    if k == 5:
        return 0, 4
    return (2 - k // 2, 2) if k % 2 == 0 else (2 - k // 2, 3)


_GRIDS = [_DOWN_RIGHT, _grid(_vr), _DOWN_LEFT, _grid(_vl), _grid(_hd), _grid(_hu)]


def fours(edge: np.ndarray) -> np.ndarray:
    """The ten predictions (..., 10, 4, 4), in the order DC TM VE HE RD VR LD VL HD HU, from edges (..., 13)."""
    e = edge.astype(np.int64)
    left, corner, top = e[..., 3::-1], e[..., 4], e[..., 5:9]
    shape = (*e.shape[:-1], 4, 4)
    # means around each place; the last top right pixel stands for the one behind it
    wide = np.concatenate([e[..., :1], e, e[..., -1:]], -1)
    three = (wide[..., :-2] + 2 * wide[..., 1:-1] + wide[..., 2:] + 2) >> 2
    two = (e + wide[..., 2:] + 1) >> 1
    bottom = (e[..., 1:2] + 3 * e[..., :1] + 2) >> 2
    out = [
        np.broadcast_to(((top.sum(-1) + left.sum(-1) + 4) >> 3)[..., None, None], shape),
        np.clip(left[..., :, None] + top[..., None, :] - corner[..., None, None], 0, 255),
        np.broadcast_to(three[..., None, 5:9], shape),
        np.broadcast_to(np.concatenate([three[..., 3:0:-1], bottom], -1)[..., :, None], shape),
    ]
    source = np.stack([np.zeros_like(e), e, two, three, np.broadcast_to(bottom, e.shape)], -1)
    for g in _GRIDS:
        out.append(source[..., g[..., 0], g[..., 1]])
    return np.stack(out, -3)


def cut(p: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray, h: int, w: int) -> np.ndarray:
    """(k, h, w): from planes (B, H, W), the part of plane i from (y, x) on, for each of k places."""
    return p[i[:, None, None], y[:, None, None] + np.arange(h)[:, None], x[:, None, None] + np.arange(w)]


def put(p: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> None:
    p[i[:, None, None], y[:, None, None] + np.arange(v.shape[1])[:, None], x[:, None, None] + np.arange(v.shape[2])] = v


def block(p: np.ndarray, i: np.ndarray, r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The four predictions of the n x n blocks at rows r and columns c of bordered planes."""
    y, x = r * n, c * n
    top, left = cut(p, i, y, x + 1, 1, n)[:, 0], cut(p, i, y + 1, x, n, 1)[..., 0]
    return whole(top, left, p[i, y, x], r > 0, c > 0)


def edges(p: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray, right_row: np.ndarray, width: np.ndarray) -> np.ndarray:
    """(k, 13): the edge pixels of the 4x4 blocks at (y, x) of bordered planes, each ``width`` wide; the right part of the top is taken from right_row."""
    left = cut(p, i, y + 1, x, 4, 1)[:, ::-1, 0]
    top = cut(p, i, y, x, 1, 5)[:, 0]
    right = p[i[:, None], right_row[:, None], np.minimum(np.minimum(x[:, None] + np.arange(5, 9), width[:, None]), p.shape[-1] - 1)]
    return np.concatenate([left, top, right], -1)


def bordered(plane: np.ndarray) -> np.ndarray:
    """A border row of 127 (with the corner) and a border column of 129."""
    out = np.empty((*plane.shape[:-2], plane.shape[-2] + 1, plane.shape[-1] + 1), np.int64)
    out[..., 1:, 1:] = plane
    out[..., :, 0] = LEFT_OF_FRAME
    out[..., 0, :] = ABOVE_FRAME
    return out
