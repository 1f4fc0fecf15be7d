"""PNG: chunks, strict scan, decoding of all variants, and a writer for tests and outputs."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
LEGAL = {1: (0, 3), 2: (0, 3), 4: (0, 3), 8: (0, 2, 3, 4, 6), 16: (0, 2, 4, 6)}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# First row, first column, row step and column step of the seven interlace passes.
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
#: Beyond this a header is taken for a trap.
MAX_PIXELS = 1 << 28


def chunks(data: bytes) -> list[tuple[str, bytes]]:
    """(type, payload) as far as the file goes; checksums are not looked at."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    out, at = [], 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        out.append((kind.decode("latin1"), data[at + 8 : at + 8 + n]))
        at += 12 + n
        if kind == b"IEND":
            break
    return out


@dataclass
class Header:
    w: int
    h: int
    depth: int
    color: int
    interlace: int
    palette: bytes = b""
    transparent: bytes | None = None
    idat: bytes = field(default=b"", repr=False)


def scan(data: bytes) -> Header:
    """The strict scan: checksums, lengths and legal values are checked; image data are joined."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, head, body = 8, None, []
    while True:
        if at + 12 > len(data):
            raise ValueError("truncated")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + n > len(data):
            raise ValueError("truncated")
        payload = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + payload) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"checksum of {kind.decode('latin1')}")
        at += 12 + n
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("header length")
            w, h, depth, kind_, comp, filt, inter = struct.unpack(">IIBBBBB", payload)
            if not w or not h or comp or filt or inter > 1 or kind_ not in LEGAL.get(depth, ()):
                raise ValueError("illegal header")
            head = Header(w, h, depth, kind_, inter)
        elif head is None:
            raise ValueError("no header first")
        elif kind == b"PLTE":
            head.palette = payload
        elif kind == b"tRNS":
            head.transparent = payload
        elif kind == b"IDAT":
            body.append(payload)
        elif kind == b"IEND":
            break
    head.idat = b"".join(body)
    return head


def passes(w: int, h: int, interlace: int) -> list[tuple[int, int, int, int, int, int]]:
    """(first row, first column, row step, column step, rows, columns) of the passes that aren't empty."""
    if not interlace:
        return [(0, 0, 1, 1, h, w)]
    out = [(r, c, dr, dc, -(-(h - r) // dr) if h > r else 0, -(-(w - c) // dc) if w > c else 0) for r, c, dr, dc in PASSES]
    return [p for p in out if p[4] and p[5]]


def raw_size(w: int, h: int, depth: int, color: int, interlace: int) -> int:
    """Bytes of the filtered rows."""
    return sum(rows * (1 + -(-cols * CHANNELS[color] * depth // 8)) for *_, rows, cols in passes(w, h, interlace))


def defilter(raw: np.ndarray, rows: int, stride: int, bpp: int) -> np.ndarray:
    """Undoes the row filters of (rows, 1 + stride) bytes. Sub and Up run over whole rows; Average and Paeth pixel by pixel."""
    x = raw.reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride + bpp), np.uint8)  # a row above and a pixel before, of zeros
    for r in range(rows):
        kind, line, up, row = int(x[r, 0]), x[r, 1:], out[r], out[r + 1]
        if kind == 0:
            row[bpp:] = line
        elif kind == 1:
            for c in range(bpp):
                row[bpp + c :: bpp] = np.cumsum(line[c::bpp], dtype=np.uint8)
        elif kind == 2:
            row[bpp:] = line + up[bpp:]
        elif kind == 3:
            above, own = up[bpp:].tolist(), [0] * bpp
            for i, v in enumerate(line.tolist()):
                own.append((v + (own[i] + above[i] >> 1)) & 255)
            row[:] = own
        elif kind == 4:
            above, own = up.tolist(), [0] * bpp
            for i, v in enumerate(line.tolist()):
                a, b, c = own[i], above[i + bpp], above[i]
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                own.append((v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255)
            row[:] = own
        else:
            raise ValueError("no such filter")
    return out[1:, bpp:]


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> np.ndarray:
    """Any legal PNG as RGBA (h, w, 4), 8 bits. Transparent keys of 16 bits are compared in full."""
    head = scan(data)
    if head.w * head.h > max_pixels:
        raise ValueError("too many pixels")
    want = raw_size(head.w, head.h, head.depth, head.color, head.interlace)
    z = zlib.decompressobj()
    raw = z.decompress(head.idat, want)
    if len(raw) < want:
        raise ValueError("too little image data")
    if not z.eof and (z.decompress(z.unconsumed_tail, 1) or not z.eof):
        raise ValueError("too much image data, or none of its end")
    flat, at = np.frombuffer(raw, np.uint8), 0
    n, depth = CHANNELS[head.color], head.depth
    samples = np.zeros((head.h, head.w, n), np.uint16)
    for r, c, dr, dc, rows, cols in passes(head.w, head.h, head.interlace):
        stride = -(-cols * n * depth // 8)
        part = defilter(flat[at : at + rows * (stride + 1)], rows, stride, max(1, n * depth // 8))
        at += rows * (stride + 1)
        if depth == 16:
            v = part.reshape(rows, -1, 2).astype(np.uint16)
            v = (v[..., 0] << 8) | v[..., 1]
        elif depth == 8:
            v = part.astype(np.uint16)
        else:
            bits = np.unpackbits(part, axis=1).reshape(rows, -1, depth)
            v = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(-1).astype(np.uint16)[:, : cols * n]
        samples[r::dr, c::dc] = v.reshape(rows, cols, n)
    return _expand(head, samples)


def _expand(head: Header, s: np.ndarray) -> np.ndarray:
    out = np.full((head.h, head.w, 4), 255, np.uint8)
    if head.color == 3:
        colors = np.frombuffer(head.palette[: len(head.palette) // 3 * 3], np.uint8).reshape(-1, 3)
        if s.max(initial=0) >= len(colors):
            raise ValueError("a colour beyond the palette")
        alpha = np.full(len(colors), 255, np.uint8)
        given = np.frombuffer((head.transparent or b"")[: len(colors)], np.uint8)
        alpha[: len(given)] = given
        out[..., :3], out[..., 3] = colors[s[..., 0]], alpha[s[..., 0]]
        return out
    small = (s >> 8 if head.depth == 16 else s.astype(np.uint32) * 255 // ((1 << head.depth) - 1)).astype(np.uint8)
    out[..., :3] = small[..., :1] if head.color in (0, 4) else small[..., :3]
    if head.color in (4, 6):
        out[..., 3] = small[..., -1]
    elif head.transparent and len(head.transparent) >= 2 * s.shape[2]:
        key = np.array(struct.unpack(f">{s.shape[2]}H", head.transparent[: 2 * s.shape[2]]))
        out[(s == key).all(-1), 3] = 0
    return out


def chunk(kind: str, payload: bytes) -> bytes:
    k = kind.encode("latin1")
    return struct.pack(">I", len(payload)) + k + payload + struct.pack(">I", zlib.crc32(k + payload))


def encode(samples: np.ndarray, depth: int = 8, color: int = 6, interlace: int = 0, filters: int | list[int] = 0, extra: list[tuple[str, bytes]] = (), level: int = 6, pieces: int = 1) -> bytes:
    """Samples (h, w, channels) as a PNG; filters: a kind for all rows, or kinds in turn; extra chunks go before the image data."""
    h, w, n = samples.shape
    kinds = [filters] if isinstance(filters, int) else filters
    body, bpp = bytearray(), max(1, n * depth // 8)
    for r, c, dr, dc, rows, cols in passes(w, h, interlace):
        part = samples[r::dr, c::dc].reshape(rows, cols * n)
        if depth == 16:
            lines = part.astype(">u2").view(np.uint8).reshape(rows, -1)
        elif depth == 8:
            lines = part.astype(np.uint8)
        else:
            bits = (part[..., None].astype(np.uint8) >> np.arange(depth - 1, -1, -1, dtype=np.uint8)) & 1
            lines = np.packbits(bits.reshape(rows, -1), axis=1)
        before = np.zeros(lines.shape[1] + bpp, np.int64)
        for i, line in enumerate(lines):
            kind = kinds[i % len(kinds)]
            own = np.concatenate([np.zeros(bpp, np.int64), line])
            a, b, cc = own[:-bpp], before[bpp:], before[:-bpp]
            pa, pb, pc = np.abs(b - cc), np.abs(a - cc), np.abs(a + b - 2 * cc)
            guess = [0, a, b, (a + b) >> 1, np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, cc))][kind]
            body.append(kind)
            body += ((line - guess) & 255).astype(np.uint8).tobytes()
            before = own
    z = zlib.compress(bytes(body), level)
    step = -(-len(z) // pieces)
    parts = [chunk("IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, interlace)), *(chunk(k, p) for k, p in extra), *(chunk("IDAT", z[i : i + step]) for i in range(0, len(z), step)), chunk("IEND", b"")]
    return MAGIC + b"".join(parts)
