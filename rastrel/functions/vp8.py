"""Lossy key frames: mode decision, closed loop, tokens, and the decoder.

The probabilities that the format defines (first coefficient probabilities, those of their updates, and
those of 4x4 modes, 3,012 numbers) are a parameter, ``Tables``: ``Tables.load`` reads them from the text of
RFC 6386, from which alone come streams that other decoders read; ``Tables.plain`` builds others by rule, for
streams that stay with this engine. A stream can be read with the tables it was written with. Everything else
follows RFC 6386. Images of one call may differ in size: their planes are padded with zeros to the largest, and
what an image's own part is coded as doesn't depend on the padding.

The syntax of headers and modes is walked by the same functions for writing and reading: ``code(bit, prob)``
writes the bit, or ignores it and reads one. Tokens are written by whole frames and read one by one, by code
of their own. The rest of the decoder shares only transforms and predictors with the encoder.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from . import boolcoder, color, predict, quant, transform

ZIG = np.array(quant.ZIGZAG)
# Coefficient bands, extra bits of the large categories, costs of whole-block modes, weights of the decision.
BANDS = [0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7, 0]
EXTRA = {3: (11, [173, 148, 140]), 4: (19, [176, 155, 140, 135]), 5: (35, [180, 157, 141, 134, 130]), 6: (67, [254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129])}
COST_16, COST_UV = [663, 919, 872, 919], [302, 984, 439, 642]
WEIGHT_SSE, WEIGHT_16, WEIGHT_4, WEIGHT_UV, PENALTY_4 = 256, 106, 11, 120, 1000
START = b"\x9d\x01\x2a"
# The shapes of the three tables, and the place of each 4x4 mode in the RFC's order.
SHAPES = [(4, 8, 3, 11), (4, 8, 3, 11), (10, 10, 9)]
RFC_MODES = [0, 1, 2, 3, 5, 6, 4, 7, 8, 9]


@dataclass(frozen=True)
class Tables:
    """coeff and update: (4, 8, 3, 11); mode: (10, 10, 9)."""

    coeff: np.ndarray
    update: np.ndarray
    mode: np.ndarray

    @classmethod
    def load(cls, path: str) -> Tables:
        """From a JSON object with the lists coeff, update and mode, or from the arrays in the text of RFC 6386 (or of a C source that names them so)."""
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
        if text.lstrip().startswith("{"):
            d = json.loads(text)
            return cls(*(np.array(d[k], np.int64).reshape(s) for k, s in zip(("coeff", "update", "mode"), SHAPES, strict=True)))
        text = re.sub(r"^.*(\[Page \d+\]|^RFC \d+ ).*$", "", text, flags=re.M)  # page feet and heads
        text = re.sub(r"/\*.*?\*/|//[^\n]*", "", text, flags=re.S)
        found = []
        for name, shape in zip(("default_coeff_probs", "coeff_update_probs", "kf_bmode_probs"), SHAPES, strict=True):
            m = re.search(rf"\b{name}\b[^=;]*=\s*(\{{.*?\}})\s*;", text, re.S)
            numbers = [int(x) for x in re.findall(r"\d+", m[1])] if m else []
            if len(numbers) != math.prod(shape) or not all(0 <= x <= 255 for x in numbers):
                raise ValueError(f"{path} holds no array {name} of {math.prod(shape)} probabilities")
            found.append(np.array(numbers, np.int64).reshape(shape))
        at = np.array(RFC_MODES)
        return cls(found[0], found[1], found[2][at[:, None], at[None, :]])

    @classmethod
    def plain(cls) -> Tables:
        """By rule: zeros likelier at high bands and after zeros; updates rare; all 4x4 modes alike."""
        band, ctx, node = np.arange(8)[:, None, None], np.arange(3)[None, :, None], np.arange(11)[None, None, :]
        p = np.where(node == 0, 96 + 60 * ctx - 8 * band, np.where(node == 1, 90 + 14 * band - 30 * ctx, 150 + 6 * node))
        coeff = np.broadcast_to(np.clip(p, 1, 254), (4, 8, 3, 11)).copy()
        return cls(coeff, np.full((4, 8, 3, 11), 250), np.full((10, 10, 9), 128))


@lru_cache(4)
def _plain() -> Tables:
    return Tables.plain()


def _tree(mode: int | None, p: list[int], code) -> int:
    """Walks the tree of the 4x4 modes."""
    m = -1 if mode is None else mode
    if not code(m != 0, p[0]):
        return 0
    if not code(m != 1, p[1]):
        return 1
    if not code(m != 2, p[2]):
        return 2
    if not code(m >= 6, p[3]):
        if not code(m != 3, p[4]):
            return 3
        return 4 + code(m != 4, p[5])
    if not code(m != 6, p[6]):
        return 6
    if not code(m != 7, p[7]):
        return 7
    return 8 + code(m != 8, p[8])


def mode_costs(t: Tables) -> np.ndarray:
    """The cost of each 4x4 mode after each (above, left), in 256ths of a bit."""
    out = np.zeros((10, 10, 10), np.int64)
    for a in range(10):
        for b in range(10):
            for m in range(10):
                bits = 0.0

                def code(bit, p):
                    nonlocal bits
                    bits -= math.log2((256 - p if bit else p) / 256)
                    return int(bit)

                _tree(m, t.mode[a, b].tolist(), code)
                out[a, b, m] = round(256 * bits)
    return out


def _blocks(x: np.ndarray, n: int = 4) -> np.ndarray:
    """(..., H, W) to (..., H/n, W/n, n, n)."""
    h, w = x.shape[-2] // n, x.shape[-1] // n
    return np.moveaxis(x.reshape(*x.shape[:-2], h, n, w, n), -3, -2)


def _join(b: np.ndarray) -> np.ndarray:
    """(..., h, w, n, n) to (..., h * n, w * n)."""
    h, w, n = b.shape[-4], b.shape[-3], b.shape[-1]
    return np.moveaxis(b, -2, -3).reshape(*b.shape[:-4], h * n, w * n)


@dataclass
class Modes:
    """For each macroblock: whether it has 4x4 modes, the whole-block luma and chroma modes, the 16 small ones."""

    small: np.ndarray
    luma: np.ndarray
    chroma: np.ndarray
    fours: np.ndarray


def decide(y: np.ndarray, u: np.ndarray, v: np.ndarray, index: int, t: Tables, width: np.ndarray | None = None) -> Modes:
    """Open-loop decision from source pixels: least weighted error; ties go to the smaller mode. Planes: (B, H, W); width: of each image's own luma."""
    batch, mh, mw = y.shape[0], y.shape[1] // 16, y.shape[2] // 16
    width = np.full(batch, y.shape[2]) if width is None else width
    planes = [predict.bordered(p) for p in (y, u, v)]
    shape = (batch, mh, mw)
    i, r, c = (x.ravel() for x in np.indices(shape))
    luma, chroma, score = (np.zeros(len(i), np.int64) for _ in range(3))
    for at in np.array_split(np.arange(len(i)), -(-len(i) // 1024)):
        ii, rr, cc = i[at], r[at], c[at]
        cost = []
        for p, n in zip(planes, (16, 8, 8), strict=True):
            own = predict.cut(p, ii, rr * n + 1, cc * n + 1, n, n)[:, None]
            cost.append(((own - predict.block(p, ii, rr, cc, n)) ** 2).sum((-1, -2)))
        full = cost[0] * WEIGHT_SSE + np.array(COST_16) * WEIGHT_16
        luma[at], score[at] = full.argmin(1), full.min(1)
        chroma[at] = ((cost[1] + cost[2]) * WEIGHT_SSE + np.array(COST_UV) * WEIGHT_UV).argmin(1)
    luma, chroma, score = (x.reshape(shape) for x in (luma, chroma, score))
    # errors of all ten modes; the right part of the top edge is that of the row above the macroblock
    p, h, w = planes[0], y.shape[1], y.shape[2]
    sse = np.empty((batch, h // 4, w // 4, 10), np.int64)
    bi, by, bx = (x.ravel() for x in np.indices((batch, h // 4, w // 4)))
    for at in np.array_split(np.arange(len(bi)), -(-len(bi) // 8192)):
        yy, xx = 4 * by[at], 4 * bx[at]
        guess = predict.fours(predict.edges(p, bi[at], yy, xx, np.where(xx % 16 == 12, yy // 16 * 16, yy), width[bi[at]]))
        own = predict.cut(p, bi[at], yy + 1, xx + 1, 4, 4)
        sse[bi[at], by[at], bx[at]] = ((own[:, None] - guess) ** 2).sum((-1, -2))
    costs = mode_costs(t) * WEIGHT_4
    small, fours = np.zeros(shape, bool), np.zeros((*shape, 16), np.int64)
    above, beside = np.zeros((batch, w // 4), np.int64), np.zeros((batch, h // 4), np.int64)
    start = PENALTY_4 * quant.matrices(index)["y1"].mean ** 2
    four = np.arange(4)
    for i, r, c in waves(batch, mh, mw, 1):
        cols, rows = 4 * c[:, None] + four, 4 * r[:, None] + four
        total, up, lf = np.full(len(i), start), above[i[:, None], cols], beside[i[:, None], rows]
        own, who = np.empty((len(i), 16), np.int64), np.arange(len(i))
        for k in range(16):
            a, b = divmod(k, 4)
            cost = sse[i, 4 * r + a, 4 * c + b] * WEIGHT_SSE + costs[up[:, b], lf[:, a]]
            m = cost.argmin(1)
            total += cost[who, m]
            up[:, b] = lf[:, a] = own[:, k] = m
        better = total < score[i, r, c]
        whole = luma[i, r, c, None]
        small[i, r, c] = better
        fours[i, r, c] = np.where(better[:, None], own, whole)
        above[i[:, None], cols], beside[i[:, None], rows] = np.where(better[:, None], up, whole), np.where(better[:, None], lf, whole)
    return Modes(small, luma, chroma, fours)


def waves(batch: int, mh: int, mw: int, lag: int):
    """(picture, row, column) of macroblocks that don't wait for one another: the sum of column and lag times row is equal.

    With lag 1 a macroblock comes after those to its left and above, with lag 2 also after the one above to the right.
    """
    r, c = (x.ravel() for x in np.indices((mh, mw)))
    key = c + lag * r
    order = np.argsort(key, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        yield np.repeat(np.arange(batch), len(at)), np.tile(r[at], batch), np.tile(c[at], batch)


def _token(a: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The bits of a level of size a: (node of the tree, bit), and (fixed probability, bit) of what follows, the sign left out."""
    if a < 2:
        return ([(1, 1), (2, 0)] if a else [(1, 0)]), []
    out = [(1, 1), (2, 1), (3, int(a > 4))]
    if a <= 4:
        return out + [(4, int(a > 2))] + ([(5, int(a == 4))] if a > 2 else []), []
    if a <= 10:
        return out + [(6, 0), (7, int(a > 6))], [(159, int(a == 6))] if a <= 6 else [(165, (a - 7) >> 1), (145, (a - 7) & 1)]
    c = max(c for c, (base, _) in EXTRA.items() if a >= base)
    base, probs = EXTRA[c]
    high = int(c > 4)
    return out + [(6, 1), (8, high), (9 + high, (c - 3) & 1)], [(x, (a - base) >> (len(probs) - 1 - k) & 1) for k, x in enumerate(probs)]


@lru_cache(1)
def _token_nodes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every size of level: which nodes give 0, which give 1, and the cost of its fixed bits and its sign."""
    zero, one, rest = np.zeros((quant.MOST + 1, 11)), np.zeros((quant.MOST + 1, 11)), np.zeros(quant.MOST + 1)
    for a in range(quant.MOST + 1):
        nodes, extra = _token(a)
        for node, bit in nodes:
            (one if bit else zero)[a, node] += 1
        rest[a] = sum(-256 * math.log2((256 - x if bit else x) / 256) for x, bit in extra) + 256 * (a > 0)
    return zero, one, rest


@lru_cache(8)
def _token_costs(coeff: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In 256ths of a bit, by kind, place and context: (4, 17, 3, sizes) of each level, (4, 17, 3) of going on and of ending a block."""
    p = np.frombuffer(coeff, np.int64).reshape(4, 8, 3, 11)[:, BANDS]
    c0, c1 = -256 * np.log2(p / 256), -256 * np.log2(1 - np.minimum(p, 255) / 256)
    zero, one, rest = _token_nodes()
    return c0 @ zero.T + c1 @ one.T + rest, c1[..., 0], c0[..., 0]


def trellis(coeffs: np.ndarray, s: quant.Steps, first: int, weight: float | np.ndarray, t: Tables, context: int = 1) -> np.ndarray:
    """Levels of (N, 16) raster luma coefficients by rate and error: each is rounded down or one larger, whichever path costs least.

    The rate is that of the tokens under t: states are the contexts that a level leaves to the next one (it was 0, 1 or
    more), and a block may end after any level that isn't 0. ``context`` stands for the first one, which its neighbours settle.
    """
    token, more, stop = (x[3 if first == 0 else 0] for x in _token_costs(t.coeff.astype(np.int64).tobytes()))
    size = (np.abs(coeffs) + s.sharpen)[:, ZIG]
    step = s.q[ZIG]
    low = np.minimum((size * s.iq[ZIG]) >> quant.FIX, quant.MOST)
    n, row = len(coeffs), np.arange(len(coeffs))
    tail = np.zeros((n, 17))
    tail[:, :16] = np.cumsum((256.0 * size**2)[:, ::-1], 1)[:, ::-1]  # the error if nothing more comes
    best = np.full((n, 3), np.inf)
    best[:, context] = 0
    final, last = weight * stop[first, context] + tail[:, first], np.full((n, 2), -1)
    back = []
    for k in range(first, 16):
        new, source = np.full((n, 3), np.inf), np.zeros((n, 3, 2), np.int64)
        for add in (0, 1):
            v = np.minimum(low[:, k] + add, quant.MOST)
            error = 256.0 * (size[:, k] - v * step[k]) ** 2
            state = np.minimum(v, 2)
            for before in range(3):
                rate = token[k, before, v] + (0 if before == 0 and k > first else more[k, before])
                cost = best[:, before] + weight * rate + error
                better = cost < new[row, state]
                new[row[better], state[better]] = cost[better]
                source[row[better], state[better], 0] = before
                source[row[better], state[better], 1] = v[better]
        best = new
        back.append(source)
        for state in (1, 2):
            whole = best[:, state] + (weight * stop[k + 1, state] if k < 15 else 0) + tail[:, k + 1]
            better = whole < final
            final = np.where(better, whole, final)
            last[better] = k, state
    out = np.zeros((n, 16), np.int64)
    state = np.zeros(n, np.int64)
    for k in range(15, first - 1, -1):
        state = np.where(last[:, 0] == k, last[:, 1], state)
        on = row[last[:, 0] >= k]
        before = back[k - first][on, state[on]]
        out[on, ZIG[k]] = before[:, 1]
        state[on] = before[:, 0]
    return np.sign(coeffs) * out


@dataclass
class Levels:
    """Raster levels of each macroblock: DC transform (16), luma (16, 16), chroma (8, 16)."""

    y2: np.ndarray
    y: np.ndarray
    uv: np.ndarray

    def empty(self) -> np.ndarray:
        return ~(self.y2.any(-1) | self.y.any((-1, -2)) | self.uv.any((-1, -2)))


def _restore_luma(levels: np.ndarray, y2: np.ndarray, m: dict[str, quant.Steps]) -> np.ndarray:
    """Residual (B, 16, 4, 4) of whole-block macroblocks."""
    c = quant.dequantize(levels, m["y1"])
    c[..., 0] = transform.iwht(quant.dequantize(y2, m["y2"]).reshape(-1, 4, 4)).reshape(-1, 16)
    return transform.idct(c.reshape(*c.shape[:-1], 4, 4))


def _luma_levels(d: np.ndarray, s: quant.Steps, first: int, strength: np.ndarray, t: Tables) -> np.ndarray:
    """Levels of the blocks d (N, ..., 16); strength: of each of the N."""
    if not strength.any():
        return quant.quantize(d, s)
    weight = np.maximum(1.0, strength * (7 * s.mean**2 / 8 if first == 0 else s.mean**2 / 4))
    out = trellis(d.reshape(-1, 16), s, first, np.repeat(weight, d[0].size // 16), t).reshape(d.shape)
    if (plain := strength == 0).any():
        out[plain] = quant.quantize(d[plain], s)
    return out


def code_loop(y: np.ndarray, u: np.ndarray, v: np.ndarray, modes: Modes, index: int, strength: float | np.ndarray = 0.0, width: np.ndarray | None = None, t: Tables | None = None) -> tuple[Levels, list[np.ndarray]]:
    """The closed loop over planes (B, H, W): predict from what the decoder will have, transform, quantise, restore."""
    batch, mh, mw = modes.luma.shape
    out = Levels(*(np.zeros((batch, mh, mw, *s), np.int64) for s in ((16,), (16, 16), (8, 16))))
    return out, _loop(modes, index, out, [p.astype(np.int64) for p in (y, u, v)], strength, width, t)


def _loop(modes: Modes, index: int, lv: Levels, sources: list[np.ndarray] | None, strength: float | np.ndarray = 0.0, width: np.ndarray | None = None, t: Tables | None = None) -> list[np.ndarray]:
    """Restores planes from levels, wave by wave; with sources, finds the levels first."""
    batch, mh, mw = modes.luma.shape
    m = quant.matrices(index)
    strength = np.broadcast_to(np.asarray(strength, float), batch)
    width = np.full(batch, 16 * mw) if width is None else width
    planes = [predict.bordered(np.zeros((batch, mh * n, mw * n), np.int64)) for n in (16, 8, 8)]
    for i, r, c in waves(batch, mh, mw, 2):
        small = modes.small[i, r, c]
        for whole in (True, False):
            k = np.flatnonzero(small != whole)
            if len(k):
                (_whole if whole else _small)(planes[0], sources and sources[0], modes, lv, m, i[k], r[k], c[k], strength[i[k]], width[i[k]], t or _plain())
        for n, p in enumerate(planes[1:]):
            a, b = 8 * r, 8 * c
            guess = predict.block(p, i, r, c, 8)[np.arange(len(i)), modes.chroma[i, r, c]]
            at = slice(4 * n, 4 * n + 4)
            if sources:
                d = transform.fdct(_blocks(predict.cut(sources[n + 1], i, a, b, 8, 8) - guess)).reshape(len(i), 4, 16)
                lv.uv[i, r, c, at] = quant.quantize(d, m["uv"])
            res = transform.idct(quant.dequantize(lv.uv[i, r, c, at], m["uv"]).reshape(-1, 2, 2, 4, 4))
            predict.put(p, i, a + 1, b + 1, np.clip(guess + _join(res), 0, 255))
    return [p[:, 1:, 1:] for p in planes]


def _whole(p, source, modes, lv, m, i, r, c, strength, _width, t) -> None:
    """Macroblocks with one luma mode."""
    guess = predict.block(p, i, r, c, 16)[np.arange(len(i)), modes.luma[i, r, c]]
    if source is not None:
        d = transform.fdct(_blocks(predict.cut(source, i, 16 * r, 16 * c, 16, 16) - guess)).reshape(len(i), 16, 16)
        lv.y2[i, r, c] = quant.quantize(transform.fwht(d[..., 0].reshape(-1, 4, 4)).reshape(-1, 16), m["y2"])
        ac = _luma_levels(d, m["y1"], 1, strength, t)
        ac[..., 0] = 0
        lv.y[i, r, c] = ac
    res = _restore_luma(lv.y[i, r, c], lv.y2[i, r, c], m).reshape(-1, 4, 4, 4, 4)
    predict.put(p, i, 16 * r + 1, 16 * c + 1, np.clip(guess + _join(res), 0, 255))


def _small(p, source, modes, lv, m, i, r, c, strength, width, t) -> None:
    """Macroblocks with sixteen luma modes."""
    for k in range(16):
        a, b = 16 * r + k // 4 * 4, 16 * c + k % 4 * 4
        guess = predict.fours(predict.edges(p, i, a, b, 16 * r if k % 4 == 3 else a, width))[np.arange(len(i)), modes.fours[i, r, c, k]]
        if source is not None:
            lv.y[i, r, c, k] = _luma_levels(transform.fdct(predict.cut(source, i, a, b, 4, 4) - guess).reshape(-1, 16), m["y1"], 0, strength, t)
        res = transform.idct(quant.dequantize(lv.y[i, r, c, k], m["y1"]).reshape(-1, 4, 4))
        predict.put(p, i, a + 1, b + 1, np.clip(guess + res, 0, 255))


def _read_block(code, p: list, ctx: int, first: int, out: np.ndarray) -> int:
    """One block in scan order into out (raster); returns whether it has a level."""
    i, q, free, some = first, p[BANDS[first]][ctx], False, 0
    while i < 16:
        if not free and not code(None, q[0]):
            break
        if not code(None, q[1]):
            i, free = i + 1, True
            q = p[BANDS[i]][0]
            continue
        nxt = 2
        if not code(None, q[2]):
            a, nxt = 1, 1
        elif not code(None, q[3]):
            a = 2 if not code(None, q[4]) else 3 + code(None, q[5])
        elif not code(None, q[6]):
            a = 5 + code(None, 159) if not code(None, q[7]) else 7 + 2 * code(None, 165) + code(None, 145)
        else:
            high = code(None, q[8])
            a, probs = EXTRA[3 + 2 * high + code(None, q[9 + high])]
            for k, x in enumerate(probs):
                a += code(None, x) << (len(probs) - 1 - k)
        out[quant.ZIGZAG[i]] = -a if code(None, 128) else a
        i, free, some = i + 1, False, 1
        q = p[BANDS[i]][nxt]
    return some


def _read_tokens(codes: list, probs: list, small: np.ndarray, skip: np.ndarray) -> Levels:
    """All blocks of a frame; small and skip: (mh, mw). Rows of macroblocks take turns in the partitions, of which codes has one reader each."""
    mh, mw = small.shape
    out = Levels(*(np.zeros((mh, mw, *s), np.int64) for s in ((16,), (16, 16), (8, 16))))
    above = [[0] * 9 for _ in range(mw)]
    for r in range(mh):
        lf, code = [0] * 9, codes[r % len(codes)]
        for c in range(mw):
            up, four = above[c], bool(small[r, c])
            if skip[r, c]:
                up[:8], lf[:8] = [0] * 8, [0] * 8
                if not four:
                    up[8] = lf[8] = 0
                continue
            if not four:
                up[8] = lf[8] = _read_block(code, probs[1], up[8] + lf[8], 0, out.y2[r, c])
            kind, first = (probs[3], 0) if four else (probs[0], 1)
            for k in range(16):
                i, j = divmod(k, 4)
                up[j] = lf[i] = _read_block(code, kind, up[j] + lf[i], first, out.y[r, c, k])
            for k in range(8):
                i, j = 4 + 2 * (k // 4) + k % 4 // 2, 4 + 2 * (k // 4) + k % 2
                up[j] = lf[i] = _read_block(code, probs[2], up[j] + lf[i], 0, out.uv[r, c, k])
    return out


#: Places in the list of probabilities that recorded tokens refer to: below 256 the probability itself, then one for each slot.
SLOTS = (256 + np.arange(4 * 8 * 3 * 11)).reshape(4, 8, 3, 11)


def _neighbours(nz: np.ndarray) -> np.ndarray:
    """The flag above plus the flag to the left, 0 outside."""
    out = np.zeros_like(nz)
    out[1:] += nz[:-1]
    out[:, 1:] += nz[:, :-1]
    return out


def _last_valid(x: np.ndarray, valid: np.ndarray, axis: int) -> np.ndarray:
    """Before each place along an axis, the last valid value, or 0."""
    x, valid = np.moveaxis(x, axis, 0), np.moveaxis(valid, axis, 0)
    at = np.maximum.accumulate(np.where(valid, np.arange(len(x))[:, None], -1), 0)
    out = np.zeros_like(x)
    out[1:] = np.where(at[:-1] >= 0, np.take_along_axis(x, np.maximum(at[:-1], 0), 0), 0)
    return np.moveaxis(out, 0, axis)


def tokens(small: np.ndarray, skip: np.ndarray, lv: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of all blocks of a frame in order, the slots of their probabilities, and their rows of macroblocks.

    Contexts come from whole planes of flags. Every place of a block that is sent has a row of at most nineteen bits,
    of which those that apply are taken.
    """
    mh, mw = small.shape
    coded = ~skip
    scan = [x[..., ZIG] for x in (lv.y2[:, :, None], lv.y, lv.uv)]
    scan[1] = np.where((np.arange(16) > 0) | small[..., None, None], scan[1], 0)
    flag = [(x != 0).any(-1) & coded[..., None] for x in scan]
    whole = flag[0][..., 0] & ~small
    ctx2 = sum(_last_valid(whole.astype(np.int64), ~small, axis) for axis in (0, 1))
    grid = lambda x, n: x.reshape(mh, mw, n, n).transpose(0, 2, 1, 3).reshape(mh * n, mw * n).astype(np.int64)
    back = lambda x, n: x.reshape(mh, n, mw, n).transpose(0, 2, 1, 3).reshape(mh, mw, n * n)
    ctx = np.concatenate([ctx2[..., None], back(_neighbours(grid(flag[1], 4)), 4), *(back(_neighbours(grid(flag[2][..., k : k + 4], 2)), 2) for k in (0, 4))], -1)
    four = np.broadcast_to(small[..., None], (mh, mw, 16))
    kind = np.concatenate([np.full((mh, mw, 1), 1), np.where(four, 3, 0), np.full((mh, mw, 8), 2)], -1)
    sent = np.concatenate([(coded & ~small)[..., None], np.broadcast_to(coded[..., None], (mh, mw, 24))], -1).ravel()
    v = np.concatenate(scan, 2).reshape(-1, 16)[sent]
    ctx, kind = ctx.ravel()[sent], kind.ravel()[sent]
    first = (kind == 0).astype(np.int64)
    a = np.abs(v)
    last = np.where(a.any(1), 15 - (a[:, ::-1] != 0).argmax(1), -1)
    place = np.arange(16)
    inside = (place >= first[:, None]) & (place <= last[:, None])
    end = place == np.maximum(last + 1, first)[:, None]
    b, i = np.nonzero(inside | end)
    own, value, size = inside[b, i], v[b, i], a[b, i]
    before = np.where(i > 0, a[b, np.maximum(i - 1, 0)], 0)
    start = i == first[b]
    slot = SLOTS[kind[b], np.array(BANDS)[i], np.where(start, ctx[b], np.minimum(before, 2))]  # (n, 11)
    bits, at, on = (np.zeros((len(b), 19), k) for k in (bool, np.int64, bool))

    def put(column, when, bit, where):
        on[:, column] |= when
        bits[:, column] = np.where(when, bit, bits[:, column])
        at[:, column] = np.where(when, where, at[:, column])

    put(0, ~own | start | (before > 0), own, slot[:, 0])
    put(1, own, size > 0, slot[:, 1])
    put(2, size > 0, size > 1, slot[:, 2])
    two = size > 1
    put(3, two, size > 4, slot[:, 3])
    low = two & (size <= 4)
    put(4, low, size > 2, slot[:, 4])
    put(5, low & (size > 2), size == 4, slot[:, 5])
    put(4, size > 4, size > 10, slot[:, 6])
    mid = (size > 4) & (size <= 10)
    put(5, mid, size > 6, slot[:, 7])
    put(6, mid & (size <= 6), size == 6, 159)
    put(6, mid & (size > 6), (size - 7) >> 1 & 1, 165)
    put(7, mid & (size > 6), (size - 7) & 1, 145)
    big, high = size > 10, size >= 35
    put(5, big, high, slot[:, 8])
    put(6, big, size >= np.where(high, 67, 19), np.where(high, slot[:, 10], slot[:, 9]))
    for c, (base, probs) in EXTRA.items():
        when = big & (size >= base) & (size < (EXTRA[c + 1][0] if c < 6 else 1 << 30))
        for k, p in enumerate(probs):
            put(7 + k, when, (size - base) >> (len(probs) - 1 - k) & 1, p)
    put(18, size > 0, value < 0, 128)
    row = np.repeat(np.arange(mh), 25 * mw)[sent]
    return bits[on], at[on], np.repeat(row[b], on.sum(1))


def _walk_modes(coder, t: Tables, modes: Modes | None, skip: np.ndarray | None, prob_skip: int | None, mh: int, mw: int) -> tuple[Modes, np.ndarray]:
    out = Modes(np.zeros((mh, mw), bool), *(np.zeros((mh, mw), np.int64) for _ in range(2)), np.zeros((mh, mw, 16), np.int64))
    skipped = np.zeros((mh, mw), bool)
    code, probs = coder.code, t.mode.tolist()
    above = [[0] * 4 for _ in range(mw)]
    for r in range(mh):
        beside = [0] * 4
        for c in range(mw):
            if prob_skip is not None:
                skipped[r, c] = code(None if skip is None else int(skip[r, c]), prob_skip)
            l, k = (None, None) if modes is None else (int(modes.luma[r, c]), int(modes.chroma[r, c]))
            up = above[c]
            out.small[r, c] = not code(None if modes is None else int(not modes.small[r, c]), 145)
            if out.small[r, c]:
                for b in range(16):
                    i, j = divmod(b, 4)
                    m = _tree(None if modes is None else int(modes.fours[r, c, b]), probs[up[j]][beside[i]], code)
                    up[j] = beside[i] = out.fours[r, c, b] = m
            else:
                if code(l in (1, 3), 156):
                    m = 1 if not code(l == 3, 128) else 3
                else:
                    m = 2 if code(l == 2, 163) else 0
                out.luma[r, c] = m
                out.fours[r, c] = m
                up[:] = beside[:] = [m] * 4
            if not code(k != 0, 142):
                out.chroma[r, c] = 0
            elif not code(k != 2, 114):
                out.chroma[r, c] = 2
            else:
                out.chroma[r, c] = 3 if not code(k != 3, 183) else 1
    return out, skipped


def fit_probabilities(n0: np.ndarray, n1: np.ndarray, old: np.ndarray, update: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slot the fitted probability of a 0, and whether the bits saved pay for sending it."""
    n = n0 + n1
    new = np.clip((n0 * 256 + n // 2) // np.maximum(n, 1), 1, 255)
    bits = lambda p: -(n0 * np.log2(p / 256) + n1 * np.log2(1 - p / 256))
    send = 8 + np.log2(update / (256 - update))
    return new, (n >= 24) & (bits(old) - bits(new) > np.maximum(14, send))


def write_frame(h: int, w: int, modes: Modes, levels: Levels, index: int, t: Tables | None = None, adapt: bool = True, partitions: int = 1) -> bytes:
    """One image's key frame, with 1, 2, 4 or 8 partitions of tokens. With adapt, fitted probabilities are sent if the frame gets smaller so.

    The tokens are bits with the slots of their probabilities; counts by slot give the fitted probabilities and the
    bits that either choice takes.
    """
    t = t or _plain()
    mh, mw = modes.luma.shape
    skip = levels.empty()
    prob = int((~skip).sum()) * 255 // skip.size
    prob_skip = prob if prob < 250 and skip.any() else None
    if prob_skip is None:
        skip = np.zeros_like(skip)
    one, at, row = tokens(modes.small, skip, levels)
    n1 = np.bincount(at[one], minlength=256 + SLOTS.size)[256:].reshape(SLOTS.shape)
    n0 = np.bincount(at, minlength=256 + SLOTS.size)[256:].reshape(SLOTS.shape) - n1
    fitted = None
    if adapt:
        new, send = fit_probabilities(n0, n1, t.coeff, t.update)
        cost = lambda p: -(n0 * np.log2(p / 256) + n1 * np.log2(1 - p / 256)).sum()
        flags = np.where(send, 8 - np.log2(1 - t.update / 256), 0).sum() + np.log2(t.update / 256)[send].sum()
        if cost(np.where(send, new, t.coeff)) + flags < cost(t.coeff):
            fitted = new, send
    if partitions not in (1, 2, 4, 8):
        raise ValueError("1, 2, 4 or 8 partitions")
    head, bodies = boolcoder.Writer(), [boolcoder.Writer() for _ in range(partitions)]
    probs, _ = _walk_header(head, index, t, fitted, prob_skip, partitions)
    _walk_modes(head, t, modes, skip, prob_skip, mh, mw)
    prob = np.concatenate([np.arange(256), probs.ravel()])[at]
    for k, body in enumerate(bodies):
        mine = row % partitions == k
        body.run(one[mine].tolist(), prob[mine].tolist())
    first, parts = head.finish(), [body.finish() for body in bodies]
    second = b"".join([*(len(x).to_bytes(3, "little") for x in parts[:-1]), *parts])
    tag = (1 << 4) | (len(first) << 5)
    out = tag.to_bytes(3, "little") + START + (w & 0x3FFF).to_bytes(2, "little") + (h & 0x3FFF).to_bytes(2, "little") + first + second
    return out + bytes(len(out) % 2)


def _walk_header(coder, index, t: Tables, fitted, prob_skip, partitions: int = 1) -> tuple[np.ndarray, dict]:
    """The frame header; returns the coefficient probabilities and what was read."""
    lit, code, writing = coder.literal, coder.code, isinstance(coder, boolcoder.Writer)
    got = {}
    lit(0, 1), lit(0, 1), lit(0, 1)  # colour space, clamping, segments
    got["simple"] = lit(1, 1)
    got["level"] = lit(quant.filter_level(index) if writing else None, 6)
    lit(0, 3), lit(0, 1)  # sharpness, filter deltas
    got["partitions"] = 1 << lit(partitions.bit_length() - 1, 2)
    got["index"] = lit(index, 7)
    for delta in (0, 0, 0, -2, 0):  # y1 dc, y2 dc, y2 ac, uv dc, uv ac
        if lit(int(delta != 0), 1):
            size = lit(abs(delta), 4)
            sign = lit(int(delta < 0), 1)
            got["uv_dc"] = -size if sign else size
    lit(0, 1)  # keep probabilities
    probs = t.coeff.copy()
    new, send = fitted if fitted is not None else (probs, np.zeros(probs.shape, bool))
    for i in np.ndindex(probs.shape):
        if code(int(send[i]), int(t.update[i])):
            probs[i] = lit(int(new[i]), 8)
    if lit(int(prob_skip is not None), 1):
        got["skip"] = lit(prob_skip, 8)
    return probs, got


def read_frame(data: bytes, t: Tables | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """The planes of a key frame after the loop filter, and its height and width."""
    t = t or _plain()
    if len(data) < 10 or data[3:6] != START or data[0] & 1:
        raise ValueError("not a key frame")
    size = int.from_bytes(data[:3], "little") >> 5
    w, h = (int.from_bytes(data[i : i + 2], "little") & 0x3FFF for i in (6, 8))
    if not h or not w or 10 + size > len(data):
        raise ValueError("a broken frame")
    mh, mw = -(-h // 16), -(-w // 16)
    head = boolcoder.Reader(data[10 : 10 + size])
    probs, got = _walk_header(head, None, t, None, None)
    modes, skip = _walk_modes(head, t, None, None, got.get("skip"), mh, mw)
    n, at = got["partitions"], 10 + size
    cuts = [at + 3 * (n - 1)]
    for k in range(n - 1):
        cuts.append(cuts[-1] + int.from_bytes(data[at + 3 * k : at + 3 * k + 3], "little"))
    if cuts[-1] > len(data):
        raise ValueError("a broken frame")
    codes = [boolcoder.Reader(data[a:z]).code for a, z in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    levels = _read_tokens(codes, probs.tolist(), modes.small, skip)
    planes = _restore(modes, levels, got["index"])
    if got["level"]:
        _filter(planes[0], modes, levels, got["level"])
    return (*planes, h, w)


def _restore(modes: Modes, levels: Levels, index: int) -> list[np.ndarray]:
    """The planes of one picture."""
    one = Modes(*(x[None] for x in (modes.small, modes.luma, modes.chroma, modes.fours)))
    return [p[0].copy() for p in _loop(one, index, Levels(levels.y2[None], levels.y[None], levels.uv[None]), None)]


def _filter(y: np.ndarray, modes: Modes, levels: Levels, level: int) -> None:
    """The simple loop filter, in place, wave by wave."""
    mh, mw = modes.small.shape
    inner = modes.small | ~levels.empty()
    clamp = lambda x: np.minimum(np.maximum(x, -128), 127)

    def smooth(rows, cols, limit):
        """Across an edge: four pixels in a row along the last axis; the two in the middle change."""
        p1, p0, q0, q1 = (y[rows[..., k], cols[..., k]] for k in range(4))
        on = 2 * np.abs(p0 - q0) + (np.abs(p1 - q1) >> 1) <= limit
        a = clamp(clamp(p1 - q1) + 3 * (q0 - p0))
        y[rows[..., 1], cols[..., 1]] = np.where(on, clamp(p0 - 128 + (clamp(a + 3) >> 3)) + 128, p0)
        y[rows[..., 2], cols[..., 2]] = np.where(on, clamp(q0 - 128 - (clamp(a + 4) >> 3)) + 128, q0)

    along, across = np.arange(16)[None, :, None], np.arange(-2, 2)[None, None, :]
    for _, r, c in waves(1, mh, mw, 2):
        for vertical in (True, False):
            for step in range(0, 16, 4):
                k = np.flatnonzero(inner[r, c]) if step else np.flatnonzero((c if vertical else r) > 0)
                if len(k):
                    a, b = 16 * r[k, None, None], 16 * c[k, None, None]
                    rows, cols = (a + along, b + step + across) if vertical else (a + step + across, b + along)
                    smooth(*np.broadcast_arrays(rows, cols), 3 * level + (0 if step else 4))


def _stacked(planes: list[np.ndarray]) -> np.ndarray:
    """Planes of any sizes as one array, zeros below and to the right."""
    out = np.zeros((len(planes), *(max(p.shape[k] for p in planes) for k in (0, 1))), np.int64)
    for o, p in zip(out, planes, strict=True):
        o[: p.shape[0], : p.shape[1]] = p
    return out


def encode_rgb(images: list[np.ndarray], quality: float = 90, t: Tables | None = None, adapt: bool = True, strength: float | np.ndarray = 0.0, partitions: int = 1) -> list[tuple[bytes, float]]:
    """Frames of images (h, w, 3), and the PSNR of each one's planes before the loop filter. strength: one, or one for each image."""
    t = t or _plain()
    index = quant.quality_index(quality)
    parts = [color.yuv420(i) for i in images]
    width = np.array([p[0].shape[1] for p in parts])
    y, u, v = (_stacked(list(p)) for p in zip(*parts, strict=True))
    modes = decide(y, u, v, index, t, width)
    levels, rebuilt = code_loop(y, u, v, modes, index, strength, width, t)
    out = []
    for i, image in enumerate(images):
        h, w = image.shape[:2]
        own = np.s_[i, : -(-h // 16), : -(-w // 16)]
        one = Modes(*(x[own] for x in (modes.small, modes.luma, modes.chroma, modes.fours)))
        lv = Levels(levels.y2[own], levels.y[own], levels.uv[own])
        sse = sum(int(((a[i] - b[i])[:hh, :ww] ** 2).sum()) for a, b, hh, ww in zip((y, u, v), rebuilt, (h, h // 2, h // 2), (w, w // 2, w // 2), strict=True))
        mse = sse / (h * w + 2 * (h // 2) * (w // 2))
        out.append((write_frame(h, w, one, lv, index, t, adapt, partitions), 99.0 if mse <= 0 else 10 * math.log10(65025 / mse)))
    return out


def decode_rgb(data: bytes, t: Tables | None = None) -> np.ndarray:
    y, u, v, h, w = read_frame(data, t)
    return color.rgb_from_yuv(y, u, v, h, w)
