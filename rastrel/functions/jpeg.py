"""JPEG files as RGBA: sequential and progressive Huffman coding, 8 bits, one to four components (ITU-T T.81)."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

# The order in which the coefficients of a block are sent, by diagonals.
_DIAGONALS = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
NATURAL = [8 * y + x for y, x in _DIAGONALS]
_BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
MOST = 1 << 28


class _Component:
    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table = h, v, table
        self.dc = self.ac = None

    def lay_out(self, w: int, h: int, most_h: int, most_v: int) -> None:
        """Blocks that the picture needs, and those of whole groups of blocks."""
        self.bw, self.bh = (-(-(-(-size * f // most)) // 8) for size, f, most in ((w, self.h, most_h), (h, self.v, most_v)))
        self.groups_w, self.groups_h = -(-w // (8 * most_h)), -(-h // (8 * most_v))
        self.stride = self.groups_w * self.h
        self.blocks = [[0] * 64 for _ in range(self.stride * self.groups_h * self.v)]


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For every 16 bits (length of the code they begin with, symbol); length 0 where no code fits."""
    out, code, at = [(0, 0)] * 65536, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            low = code << (16 - n)
            out[low : low + (1 << (16 - n))] = [(n, symbols[at])] * (1 << (16 - n))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _reader(data: bytes) -> tuple[Callable[[int], int], Callable[[list], int]]:
    """take(n): the next n bits; symbol(codes): the next symbol. Beyond the end there are zeros, up to a limit."""
    value, room, at, end = 0, 0, 0, len(data) + 64

    def fill() -> None:
        nonlocal value, room, at
        if at > end:
            raise ValueError("the scan ends early")
        value = (value & ((1 << room) - 1)) << 256 | int.from_bytes(data[at : at + 32].ljust(32, b"\0"), "big")
        room += 256
        at += 32

    def take(n: int) -> int:
        nonlocal room
        if room < n:
            fill()
        room -= n
        return value >> room & ((1 << n) - 1)

    def symbol(codes: list) -> int:
        nonlocal room
        if room < 16:
            fill()
        n, s = codes[value >> (room - 16) & 0xFFFF]
        if not n:
            raise ValueError("no such code")
        room -= n
        return s

    return take, symbol


def _signed(v: int, n: int) -> int:
    return v if n and v >> (n - 1) else v - (1 << n) + 1 if n else 0


class _Scan:
    """One scan: which coefficients of which components, and at which bit."""

    def __init__(self, first: int, last: int, high: int, low: int, progressive: bool):
        self.first, self.last, self.high, self.low = first, last, high, low
        self.block = self._whole if not progressive else self._dc if first == 0 else self._ac_refined if high else self._ac

    def begin(self, data: bytes) -> None:
        self.take, self.symbol = _reader(data)
        self.run, self.before = 0, {}

    def _difference(self, c: _Component) -> int:
        n = self.symbol(c.dc)
        self.before[c] = self.before.get(c, 0) + _signed(self.take(n), n)
        return self.before[c]

    def _whole(self, c: _Component, b: list) -> None:
        b[0] = self._difference(c)
        k = 1
        while k < 64:
            s = self.symbol(c.ac)
            n = s & 15
            if not n:
                if s != 0xF0:
                    return
                k += 16
                continue
            k += s >> 4
            if k > 63:
                raise ValueError("a run beyond the block")
            b[NATURAL[k]] = _signed(self.take(n), n)
            k += 1

    def _dc(self, c: _Component, b: list) -> None:
        if self.high:
            b[0] |= self.take(1) << self.low
        else:
            b[0] = self._difference(c) << self.low

    def _ac(self, c: _Component, b: list) -> None:
        if self.run:
            self.run -= 1
            return
        k = self.first
        while k <= self.last:
            s = self.symbol(c.ac)
            zeros, n = s >> 4, s & 15
            if not n:
                if zeros < 15:
                    self.run = (1 << zeros) - 1 + self.take(zeros)
                    return
                k += 16
                continue
            k += zeros
            if k > 63:
                raise ValueError("a run beyond the block")
            b[NATURAL[k]] = _signed(self.take(n), n) * (1 << self.low)
            k += 1

    def _ac_refined(self, c: _Component, b: list) -> None:
        bit, k = 1 << self.low, self.first

        def correct(i: int) -> None:
            if self.take(1) and not abs(b[i]) & bit:
                b[i] += bit if b[i] > 0 else -bit

        while k <= self.last and not self.run:
            s = self.symbol(c.ac)
            zeros, new = s >> 4, 0
            if s & 15:
                new = bit if self.take(1) else -bit
            elif zeros < 15:
                self.run = (1 << zeros) + self.take(zeros)
                break
            while k <= self.last:
                i = NATURAL[k]
                k += 1
                if b[i]:
                    correct(i)
                elif zeros:
                    zeros -= 1
                else:
                    if new:
                        b[i] = new
                    break
        if self.run:
            for j in range(k, self.last + 1):
                if b[NATURAL[j]]:
                    correct(NATURAL[j])
            self.run -= 1


def _pieces(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The coded data of a scan, cut at restart marks, and where the next segment begins."""
    out, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[begin:])
            return [x.replace(b"\xff\0", b"\xff") for x in out], len(data)
        mark = data[at + 1]
        if 0xD0 <= mark <= 0xD7:
            out.append(data[begin:at])
            begin = at + 2
        elif mark not in (0, 0xFF):
            out.append(data[begin:at])
            return [x.replace(b"\xff\0", b"\xff") for x in out], at
        at += 1 if mark == 0xFF else 2


def _run(scan: _Scan, parts: list[_Component], pieces: list[bytes], every: int) -> None:
    if len(parts) == 1:  # one component: its own blocks, without those that fill groups
        c = parts[0]
        units = [[(c, y * c.stride + x)] for y in range(c.bh) for x in range(c.bw)]
    else:
        g = parts[0]
        units = [[(c, (y * c.v + j) * c.stride + x * c.h + i) for c in parts for j in range(c.v) for i in range(c.h)] for y in range(g.groups_h) for x in range(g.groups_w)]
    step = every or len(units)
    for n, k in enumerate(range(0, len(units), step)):
        if n >= len(pieces):
            raise ValueError("the scan ends early")
        scan.begin(pieces[n])
        for unit in units[k : k + step]:
            for c, i in unit:
                scan.block(c, c.blocks[i])


def _plane(c: _Component, table: np.ndarray, w: int, h: int, most_h: int, most_v: int) -> np.ndarray:
    x = (np.array(c.blocks, np.int64) * table).reshape(-1, 8, 8).astype(float)
    x = np.clip(np.rint(_BASIS @ x @ _BASIS.T) + 128, 0, 255)
    x = x.reshape(-1, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * c.stride)
    up, along = most_v // c.v, most_h // c.h
    if most_v % c.v or most_h % c.h:
        rows, cols = np.arange(h) * c.v // most_v, np.arange(w) * c.h // most_h
        return x[rows][:, cols]
    return np.repeat(np.repeat(x, up, 0), along, 1)[:h, :w]


def decode(data: bytes) -> np.ndarray:
    """(h, w, 4)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    quant, codes, parts, at, every, adobe, frame = {}, {}, {}, 2, 0, None, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a broken segment")
        mark = data[at + 1]
        if mark == 0xFF or mark == 1 or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        seg = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            while seg:
                wide, own = seg[0] >> 4, seg[0] & 15
                size = 128 if wide else 64
                t = np.zeros(64, np.int64)
                t[NATURAL] = np.frombuffer(seg[1 : 1 + size], ">u2" if wide else np.uint8)
                quant[own], seg = t, seg[1 + size :]
        elif mark == 0xC4:
            while seg:
                total = sum(seg[1:17])
                codes[seg[0]] = _codes(seg[1:17], seg[17 : 17 + total])
                seg = seg[17 + total :]
        elif mark in (0xC0, 0xC1, 0xC2):
            depth, h, w, count = struct.unpack_from(">BHHB", seg)
            if depth != 8 or not w or not h or w * h > MOST:
                raise ValueError("this kind of JPEG isn't read")
            parts = {seg[6 + 3 * i]: _Component(seg[7 + 3 * i] >> 4, seg[7 + 3 * i] & 15, seg[8 + 3 * i]) for i in range(count)}
            if not all(c.h and c.v for c in parts.values()):
                raise ValueError("a broken header")
            most_h, most_v = max(c.h for c in parts.values()), max(c.v for c in parts.values())
            for c in parts.values():
                c.lay_out(w, h, most_h, most_v)
            frame = w, h, mark == 0xC2
        elif 0xC3 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("this kind of JPEG isn't read")
        elif mark == 0xDD:
            every = int.from_bytes(seg[:2], "big")
        elif mark == 0xEE and seg[:5] == b"Adobe":
            adobe = seg[11]
        elif mark == 0xDA:
            if frame is None:
                raise ValueError("a scan without a frame")
            chosen = []
            for i in range(seg[0]):
                c = parts[seg[1 + 2 * i]]
                c.dc, c.ac = codes.get(seg[2 + 2 * i] >> 4), codes.get(16 | seg[2 + 2 * i] & 15)
                chosen.append(c)
            first, last, bits = seg[1 + 2 * seg[0] : 4 + 2 * seg[0]]
            pieces, at = _pieces(data, at)
            scan = _Scan(first, last, bits >> 4, bits & 15, frame[2])
            _run(scan, chosen, pieces, every)
    if frame is None:
        raise ValueError("no picture")
    w, h, _ = frame
    x = np.stack([_plane(c, quant[c.table], w, h, most_h, most_v) for c in parts.values()], -1)
    out = np.full((h, w, 4), 255, np.uint8)
    if x.shape[-1] >= 3 and adobe != 0:
        y, cb, cr = x[..., 0], x[..., 1] - 128, x[..., 2] - 128
        x[..., :3] = np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)), 0, 255) if x.shape[-1] == 3 or adobe == 2 else x[..., :3]
    if x.shape[-1] == 4:  # inks, which such files keep inverted
        x = x[..., :3] * x[..., 3:] / 255
    out[..., :3] = x[..., :3] if x.shape[-1] >= 3 else x[..., :1]
    return out
