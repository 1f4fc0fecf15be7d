"""Simple raster formats as RGBA: BMP, PNM, QOI, GIF (its first picture) and uncompressed TGA; and the metadata of JPEG files."""

from __future__ import annotations

import re
import struct

import numpy as np

#: Beyond this a header is taken for a trap.
MAX_PIXELS = 1 << 28


def _room(w: int, h: int) -> None:
    if w <= 0 or h <= 0 or w * h > MAX_PIXELS:
        raise ValueError("no such size")


def _rgba(a: np.ndarray) -> np.ndarray:
    """(h, w, 1..4) with missing channels filled."""
    out = np.full((*a.shape[:2], 4), 255, np.uint8)
    n = a.shape[2]
    out[..., :3] = a[..., :3] if n >= 3 else a[..., :1]
    if n in (2, 4):
        out[..., 3] = a[..., -1]
    return out


def bmp(d: bytes) -> np.ndarray:
    """Uncompressed, 8 bits by palette, 24 or 32."""
    (start,), (size, w, h, _, depth, packed) = struct.unpack_from("<I", d, 10), struct.unpack_from("<IiiHHI", d, 14)
    flip, h = h > 0, abs(h)
    _room(w, h)
    if packed not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("this kind of BMP isn't read")
    stride = (w * depth // 8 + 3) // 4 * 4
    if start + stride * h > len(d):
        raise ValueError("truncated")
    a = np.frombuffer(d, np.uint8, stride * h, start).reshape(h, stride)[:, : w * depth // 8].reshape(h, w, depth // 8)
    a = a[::-1] if flip else a
    if depth == 8:
        colors = np.frombuffer(d, np.uint8, start - 14 - size, 14 + size)
        colors = colors[: len(colors) // 4 * 4].reshape(-1, 4)
        if a.max() >= len(colors):
            raise ValueError("a colour beyond the palette")
        return _rgba(colors[a[..., 0]][..., 2::-1])
    return _rgba(a[..., 2::-1])


def pnm(d: bytes) -> np.ndarray:
    """P1 to P6, up to 8 bits a sample."""
    kind = d[1:2]
    n = 2 if kind in b"14" else 3
    m = re.match(rb"P[1-6]" + rb"(?:\s*(?:#[^\n]*\n)?\s*(\d+))" * n + rb"\s", d)
    if not m:
        raise ValueError("a broken header")
    w, h, most = (*(int(x) for x in m.groups()), 1)[:3]
    _room(w, h)
    channels = 3 if kind in b"36" else 1
    if most > 255:
        raise ValueError("more than 8 bits a sample")
    body = d[m.end() :]
    if kind == b"4":
        v = np.unpackbits(np.frombuffer(body, np.uint8, (w + 7) // 8 * h).reshape(h, -1), axis=1)[:, :w]
    elif kind == b"1":
        v = np.array([int(x) for x in re.findall(rb"[01]", body)][: w * h])
    elif kind in b"23":
        v = np.array(body.split()[: w * h * channels], int)
    else:
        v = np.frombuffer(body, np.uint8, w * h * channels)
    if v.size < w * h * channels:
        raise ValueError("truncated")
    v = 1 - v.astype(int) if kind in b"14" else v.astype(int)
    return _rgba((v.reshape(h, w, channels) * 255 // most).astype(np.uint8))


def tga(d: bytes) -> np.ndarray:
    """Uncompressed true colour or gray."""
    ids, _, kind = d[:3]
    w, h, depth, flags = struct.unpack_from("<HHBB", d, 12)
    _room(w, h)
    if (kind, depth) not in ((2, 24), (2, 32), (3, 8)):
        raise ValueError("this kind of TGA isn't read")
    a = np.frombuffer(d, np.uint8, w * h * depth // 8, 18 + ids).reshape(h, w, -1)
    a = a if flags & 0x20 else a[::-1]
    return _rgba(a if depth == 8 else np.concatenate([a[..., 2::-1], a[..., 3:]], 2))


def qoi(d: bytes) -> np.ndarray:
    """The Quite OK Image format."""
    w, h = struct.unpack_from(">II", d, 4)
    _room(w, h)
    out, seen, at = bytearray(), [(0, 0, 0, 0)] * 64, 14
    r, g, b, a = 0, 0, 0, 255
    while len(out) < 4 * w * h:
        if at >= len(d):
            raise ValueError("truncated")
        op, low, at = d[at] >> 6, d[at] & 63, at + 1
        n = 1
        if op == 3 and low == 62:
            r, g, b = d[at : at + 3]
            at += 3
        elif op == 3 and low == 63:
            r, g, b, a = d[at : at + 4]
            at += 4
        elif op == 3:
            n = low + 1
        elif op == 0:
            r, g, b, a = seen[low]
        elif op == 1:
            r, g, b = (r + (low >> 4) - 2) & 255, (g + (low >> 2 & 3) - 2) & 255, (b + (low & 3) - 2) & 255
        else:
            step, more = low - 32, d[at]
            at += 1
            r, g, b = (r + step + (more >> 4) - 8) & 255, (g + step) & 255, (b + step + (more & 15) - 8) & 255
        seen[(3 * r + 5 * g + 7 * b + 11 * a) % 64] = (r, g, b, a)
        out += bytes((r, g, b, a)) * n
    return np.frombuffer(bytes(out[: 4 * w * h]), np.uint8).reshape(h, w, 4)


def _unpack_lzw(data: bytes, least: int, room: int) -> bytes:
    """GIF's variable-width codes, lowest bit first, up to room values."""
    clear, stop = 1 << least, (1 << least) + 1
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    words, width, last, out = list(start), least + 1, None, bytearray()
    held = n = at = 0
    while len(out) < room:
        while n < width:
            if at >= len(data):
                return bytes(out)
            held |= data[at] << n
            n, at = n + 8, at + 1
        code = held & ((1 << width) - 1)
        held, n = held >> width, n - width
        if code == clear:
            words, width, last = list(start), least + 1, None
            continue
        if code == stop:
            break
        if code > len(words) or (last is None and code >= clear):
            raise ValueError("a broken code")
        word = words[code] if code < len(words) else last + last[:1]
        out += word
        if last is not None and len(words) < 4096:
            words.append(last + word[:1])
            if len(words) == 1 << width and width < 12:
                width += 1
        last = word
    return bytes(out[:room])


def gif(d: bytes) -> np.ndarray:
    """The first picture on its canvas; what it doesn't cover, and its transparent colour, have alpha 0."""
    w, h, flags = struct.unpack_from("<HHB", d, 6)
    _room(w, h)
    at, shared, clear = 13, None, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared, at = d[at : at + size], at + size
    while d[at : at + 1] == b"!":
        if d[at + 1] == 0xF9 and d[at + 3] & 1:
            clear = d[at + 6]
        at += 2
        while d[at]:
            at += 1 + d[at]
        at += 1
    if d[at : at + 1] != b",":
        raise ValueError("no picture")
    x, y, pw, ph, flags = struct.unpack_from("<HHHHB", d, at + 1)
    at += 10
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared, at = d[at : at + size], at + size
    if shared is None or not pw or not ph or x + pw > w or y + ph > h:
        raise ValueError("a broken header")
    least, at, body = d[at], at + 1, []
    while at < len(d) and d[at]:
        body.append(d[at + 1 : at + 1 + d[at]])
        at += 1 + d[at]
    raw = np.frombuffer(_unpack_lzw(b"".join(body), least, pw * ph), np.uint8)
    colors = np.frombuffer(shared, np.uint8).reshape(-1, 3)
    if len(raw) < pw * ph or raw.max() >= len(colors):
        raise ValueError("truncated")
    rows = raw.reshape(ph, pw)
    if flags & 0x40:  # rows come in four passes
        order = np.concatenate([np.arange(a, ph, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
        rows = rows[np.argsort(order)]
    out = np.zeros((h, w, 4), np.uint8)
    part = out[y : y + ph, x : x + pw]
    part[..., :3], part[..., 3] = colors[rows], np.where(rows == (-1 if clear is None else clear), 0, 255)
    return out


def jpeg_meta(d: bytes) -> dict:
    """EXIF, XMP and the joined ICC profile of a JPEG's application segments."""
    out = {"texts": [], "phys_raw": None, "exif_raw": None, "icc_raw": None, "xmp_raw": None}
    at, parts = 2, {}
    while at + 4 <= len(d) and d[at] == 0xFF and d[at + 1] != 0xDA:
        kind, n = d[at + 1], struct.unpack_from(">H", d, at + 2)[0]
        body = d[at + 4 : at + 2 + n]
        if kind == 0xE1 and body.startswith(b"Exif\0\0"):
            out["exif_raw"] = body[6:]
        elif kind == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            out["xmp_raw"] = body[29:]
        elif kind == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            parts[body[12]] = body[14:]
        at += 2 + n
    if parts:
        out["icc_raw"] = b"".join(parts[k] for k in sorted(parts))
    return out


READERS = {"bmp": bmp, "gif": gif, "pnm": pnm, "qoi": qoi, "tga": tga}
