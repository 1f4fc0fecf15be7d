"""Kernels against values worked out by hand or by plain loops, and round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rastrel.functions import boolcoder, color, containers, lossless, png, predict, quant, transform, vp8
from rastrel.operators import convert


def image(kind, h=64, w=96):
    rng = np.random.default_rng(42)
    y, x = np.mgrid[0:h, 0:w]
    a = np.stack([x * 255 / w, y * 255 / h, (x + y) * 255 / (w + h)], -1)
    if kind == "disc":
        a[(y - h / 2) ** 2 + (x - w / 2) ** 2 < h * w / 40] = (220, 40, 60)
        a += rng.normal(0, 3, a.shape)
    elif kind == "flat":
        a[:] = 128
    elif kind == "halves":
        a[:], a[:, w // 2 :] = 128, (200, 50, 50)
    return np.clip(a, 0, 255).astype(np.uint8)


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 255)), max_size=400))
@settings(max_examples=60, deadline=None)
def test_range_coder(ops):
    w = boolcoder.Writer()
    for b, p in ops:
        w.code(b, p)
    r = boolcoder.Reader(w.finish())
    assert [r.code(None, p) for _, p in ops] == [b for b, _ in ops]


def test_range_coder_carries():
    w = boolcoder.Writer()
    for _ in range(300):
        w.code(1, 1)
        w.code(0, 255)
    r = boolcoder.Reader(w.finish())
    assert all(r.code(None, p) == b for _ in range(300) for b, p in ((1, 1), (0, 255)))


def test_transforms_by_hand():
    flat = np.full((4, 4), 10)
    assert transform.fdct(flat).ravel().tolist() == [80, 1, *[0] * 14]  # the rounding of the first pass leaves a 1
    c = np.zeros((4, 4), int)
    c[0, 0] = 84
    assert (transform.idct(c) == (84 + 4) >> 3).all()
    assert transform.fwht(np.full((4, 4), 8))[0, 0] == 64
    w = np.zeros((4, 4), int)
    w[0, 0] = 80
    assert (transform.iwht(w) == (80 + 3) >> 3).all()


@given(st.lists(st.integers(-255, 255), min_size=16, max_size=16))
@settings(max_examples=100, deadline=None)
def test_transform_round_trip(v):
    a = np.array(v).reshape(4, 4)
    assert np.abs(transform.idct(transform.fdct(a)) - a).max() <= 2
    assert np.abs(transform.iwht(transform.fwht(a)) - a).max() <= 2


def test_quantiser():
    assert [quant.quality_index(q) for q in (1, 50, 75, 90, 100)] == [103, 38, 26, 9, 0]
    m = quant.matrices(26)
    assert m["y1"].q[0] == quant.DC[26] and m["y2"].q[0] == 2 * quant.DC[26] and m["uv"].q[0] == quant.DC[24]
    for s in m.values():
        for c in (0, 1, -1, 7, -40, 500, -3000, 40000):
            got = int(quant.quantize(np.full(16, c), s)[5])
            size = abs(c) + int(s.sharpen[5])
            want = min((size * int(s.iq[5]) + int(s.bias[5])) >> 17, 2047) if size > s.zero[5] else 0
            assert got == (want if c > 0 else -want)


def test_small_predictors_pixel_by_pixel():
    e = np.array([11, 23, 35, 47, 59, 71, 83, 95, 107, 119, 131, 143, 155]) ** 2 % 251
    p = predict.fours(e)
    three = lambda a, b, c: (a + 2 * b + c + 2) >> 2
    two = lambda a, b: (a + b + 1) >> 1
    left, top = e[3::-1], e[5:]
    assert (p[0] == (top[:4].sum() + left.sum() + 4) >> 3).all()
    assert p[1][2, 3] == np.clip(left[2] + top[3] - e[4], 0, 255)
    assert p[2][3].tolist() == [three(e[4 + k], e[5 + k], e[6 + k]) for k in range(4)]
    assert p[3][:, 0].tolist() == [three(e[4], left[0], left[1]), three(left[0], left[1], left[2]), three(left[1], left[2], left[3]), three(left[2], left[3], left[3])]
    assert p[4][3, 0] == three(e[0], e[1], e[2]) and p[4][0, 3] == three(e[6], e[7], e[8])
    assert p[5][0, 0] == two(e[4], e[5]) and p[5][3, 0] == three(e[1], e[2], e[3]) and p[5][1, 3] == three(e[6], e[7], e[8])
    assert p[6][0, 0] == three(top[0], top[1], top[2]) and p[6][3, 3] == three(top[6], top[7], top[7])
    assert p[7][2, 3] == three(top[4], top[5], top[6]) and p[7][3, 3] == three(top[5], top[6], top[7]) and p[7][0, 1] == two(top[1], top[2])
    assert p[8][3, 0] == two(e[0], e[1]) and p[8][0, 3] == three(e[5], e[6], e[7]) and p[8][2, 2] == two(e[2], e[3])
    assert p[9][0, 0] == two(left[0], left[1]) and p[9][3, 3] == left[3] and p[9][2, 1] == three(left[2], left[3], left[3])


def test_colours():
    assert color.luma(np.array([[[255, 255, 255], [0, 0, 0]]]))[0].tolist() == [235, 16]
    y, u, v = color.yuv420(image("disc", 17, 33))
    assert y.shape == (32, 48) and u.shape == v.shape == (16, 24)
    assert color.psnr(np.zeros((2, 2)), np.zeros((2, 3))) == -1 and color.psnr(np.zeros((2, 2)), np.zeros((2, 2))) == 99


@pytest.mark.parametrize("quality", [75, 90, 95])
@pytest.mark.parametrize("kind", ["disc", "flat", "halves", "ramp"])
def test_lossy_round_trip(kind, quality):
    a = image(kind)
    (data, p), = vp8.encode_rgb([a], quality)
    y, u, v, h, w = vp8.read_frame(data)
    assert (h, w) == a.shape[:2]
    assert color.psnr(a, vp8.decode_rgb(data)) > 30 and p > 36


def test_batches_do_not_change_results():
    kinds = ["disc", "flat", "halves", "ramp"]
    together = vp8.encode_rgb([image(k) for k in kinds], 90)
    assert together == [vp8.encode_rgb([image(k)], 90)[0] for k in kinds]


@pytest.mark.parametrize("size", [(1, 1), (16, 16), (15, 33), (61, 47)])
def test_odd_sizes(size):
    a = image("disc", *size)
    (data, _), = vp8.encode_rgb([a], 90)
    assert vp8.decode_rgb(data).shape == a.shape


def test_decoder_sees_the_encoders_pixels():
    a = image("disc")
    index = quant.quality_index(90)
    planes = [p[None] for p in color.yuv420(a)]
    modes = vp8.decide(*planes, index, vp8.Tables.plain())
    levels, rebuilt = vp8.code_loop(*planes, modes, index)
    one = vp8.Modes(*(x[0] for x in (modes.small, modes.luma, modes.chroma, modes.fours)))
    lv = vp8.Levels(levels.y2[0], levels.y[0], levels.uv[0])
    back = vp8._restore(one, lv, index)
    assert all((x[0] == y).all() for x, y in zip(rebuilt, back, strict=True))


def test_adaptation_and_levels_by_rate_save_bytes():
    a = image("disc")
    plain, fitted = (len(vp8.encode_rgb([a], 90, adapt=x)[0][0]) for x in (False, True))
    coarse, p = vp8.encode_rgb([a], 90, strength=0.5)[0]
    assert fitted <= plain and len(coarse) < fitted and p > 36


@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 3), st.randoms(use_true_random=False))
@settings(max_examples=80, deadline=None)
def test_alpha_round_trip(h, w, kind, rng):
    values = [[255], [0, 255], [0, 1, 2, 200], list(range(256))][kind]
    a = np.array([[rng.choice(values) for _ in range(w)] for _ in range(h)], np.uint8)
    assert (lossless.decode_alpha(lossless.encode_alpha(a), h, w) == a).all()


def test_long_runs_and_rows():
    a = np.zeros((200, 300), np.uint8)
    a[50:, ::7] = 9
    data = lossless.encode_alpha(a)
    assert len(data) < 200 and (lossless.decode_alpha(data, 200, 300) == a).all()


@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=300))
@settings(max_examples=80, deadline=None)
def test_code_lengths_make_a_code(counts):
    n = lossless.code_lengths(counts)
    used = [x for x in n if x]
    assert max(n) <= 15 and [bool(x) for x in n] == [bool(c) for c in counts]
    if len(used) > 1:
        assert sum(2.0**-x for x in used) <= 1
        if max(used) < 15:
            assert sum(c * x for c, x in zip(counts, n, strict=True)) < lossless.entropy_bits(counts) + sum(counts) + 1


def test_prefix_codes_cover_all_values():
    for v, s, n, extra in zip(range(1, 5000), *(x.tolist() for x in lossless.prefix_codes(np.arange(1, 5000))), strict=True):
        base = s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1
        assert base + extra == v and extra < 1 << n


# --- PNG


def pictures():
    rng = np.random.default_rng(7)
    for h, w in ((1, 1), (3, 5), (8, 8), (17, 9)):
        for c, n in png.CHANNELS.items():
            for depth, kinds in png.LEGAL.items():
                if c in kinds:
                    yield rng.integers(0, 1 << depth, (h, w, n)).astype(np.uint16), depth, c


@pytest.mark.parametrize("interlace", [0, 1])
@pytest.mark.parametrize("filters", [0, 4, [1, 2, 3, 4, 0]])
def test_png_variants(interlace, filters):
    for s, depth, c in pictures():
        palette = np.random.default_rng(1).integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
        extra = [("PLTE", palette.tobytes())] if c == 3 else []
        data = png.encode(s, depth, c, interlace, filters, extra, pieces=3)
        a = png.decode(data)
        if c == 3:
            assert (a[..., :3] == palette[s[..., 0]]).all()
        else:
            v = s >> 8 if depth == 16 else s.astype(int) * 255 // ((1 << depth) - 1)
            assert (a[..., 0] == v[..., 0]).all() and (a[..., 3] == (v[..., -1] if c in (4, 6) else 255)).all()
        raw = zlib.decompress(png.scan(data).idat)
        assert len(raw) == png.raw_size(s.shape[1], s.shape[0], depth, c, interlace)


def test_transparent_keys():
    s = np.array([[[0x1234], [0x12FF], [0x1234]]], np.uint16)
    a = png.decode(png.encode(s, 16, 0, extra=[("tRNS", b"\x12\x34")]))
    assert a[0, :, 3].tolist() == [0, 255, 0]
    p = png.encode(np.array([[[0], [1], [2]]], np.uint8), 8, 3, extra=[("PLTE", bytes(9)), ("tRNS", b"\x00\x80")])
    assert png.decode(p)[0, :, 3].tolist() == [0, 128, 255]


def test_broken_files():
    good = png.encode(np.zeros((8, 8, 4), np.uint8))
    z = good.index(b"IDAT")
    bad = {
        "truncated": good[:-20],
        "checksum": good[: z + 6] + bytes([good[z + 6] ^ 1]) + good[z + 7 :],
        "adler": png.MAGIC + png.chunk("IHDR", good[16:29]) + png.chunk("IDAT", zlib.compress(bytes(8 * 33))[:-1] + b"x") + png.chunk("IEND", b""),
        "short": png.MAGIC + png.chunk("IHDR", good[16:29]) + png.chunk("IDAT", zlib.compress(bytes(100))) + png.chunk("IEND", b""),
        "bomb": png.MAGIC + png.chunk("IHDR", b"\0\0\x4e\x20\0\0\x4e\x20\x08\x06\0\0\0") + png.chunk("IDAT", zlib.compress(b"")) + png.chunk("IEND", b""),
        "header": png.MAGIC + png.chunk("IHDR", b"\0\0\0\x08\0\0\0\x08\x03\x06\0\0\0") + png.chunk("IEND", b""),
        "palette": png.encode(np.full((1, 1, 1), 9), 8, 3, extra=[("PLTE", bytes(9))]),
        "nothing": b"",
    }
    for name, data in bad.items():
        with pytest.raises((ValueError, zlib.error)):
            png.decode(data)
            pytest.fail(name)


# --- containers and metadata


def test_containers_and_metadata():
    text = [("tEXt", b"Title\0caf\xe9 <&>"), ("zTXt", b"Note\0\0" + zlib.compress(b"long " * 99)), ("iTXt", b"Key\0\1\0en\0k\0" + zlib.compress("čaj".encode())), ("pHYs", b"\0\0\x0b\x13\0\0\x0b\x13\1"), ("eXIf", b"II*\0"), ("iCCP", b"p\0\0" + zlib.compress(b"profile"))]
    a = image("disc", 20, 30)
    rgba = np.dstack([a, np.arange(600).reshape(20, 30) % 256]).astype(np.uint8)
    data = png.encode(rgba, extra=text)
    meta = containers.png_meta(data)
    assert [t["value"] for t in meta["texts"]] == ["café <&>", "long " * 99, "čaj"]
    frame = vp8.encode_rgb([a], 95)[0][0]
    out = convert.wrap(frame, rgba, meta)
    assert [k for k, _ in containers.riff(out)] == ["VP8X", "ICCP", "ALPH", "VP8 ", "EXIF", "XMP "]
    assert containers.differences(meta, containers.webp_meta(out)) == []
    assert containers.restore_chunks(containers.webp_meta(out)) == [(k, p) for k, p in text[:3]]
    note, p = convert.verify(rgba, meta, out, 30)
    assert note is None and p > 30
    assert convert.verify(rgba, {**meta, "exif_raw": b"x"}, out, 30)[0] == "metadata: exif_raw"
    other = rgba.copy()
    other[0, 0, 3] ^= 1
    assert convert.verify(other, meta, out, 30)[0] == "alpha"
    assert convert.verify(rgba[1:], meta, out, 30)[0] == "size"
    assert convert.verify(rgba, meta, out, 90)[0].startswith("PSNR")
    assert convert.verify(rgba, meta, out[:60], 30)[0].startswith("unreadable")
    plain = convert.wrap(frame, np.dstack([a, np.full((20, 30), 255)]), {"texts": []})
    assert [k for k, _ in containers.riff(plain)] == ["VP8 "]


def test_images_of_any_sizes_share_a_batch():
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for h, w in ((16, 16), (40, 24), (33, 70), (1, 1), (64, 64))]
    for strength in (0.0, 1.0):
        assert vp8.encode_rgb(images, 85, strength=strength) == [vp8.encode_rgb([x], 85, strength=strength)[0] for x in images]


def test_tables_from_the_text_of_the_format(tmp_path):
    """Arrays as the RFC prints them, with comments and page breaks; modes in its order."""
    own = vp8.Tables.plain()
    mode = np.arange(900).reshape(10, 10, 9) % 255 + 1
    at = np.array(vp8.RFC_MODES)
    rfc = np.empty_like(mode)
    rfc[np.ix_(at, at)] = mode
    braces = lambda x: "{" + ",\n ".join(braces(y) if isinstance(y, list) else str(y) for y in x) + "}"
    page = "\nBankoski, et al.              Informational                    [Page 69]\n\x0c\nRFC 6386       VP8 Data Format and Decoding Guide      November 2011\n"
    text = "const Prob default_coeff_probs [4] [8] [3] [11] =\n{ /* block type 0 */" + braces(own.coeff.tolist())[1:].replace("\n", page, 1) + ";\n"
    text += "const Prob coeff_update_probs [4]\n [8] [3] [11] = " + braces(own.update.tolist()) + ";\nconst Prob kf_bmode_probs [num_intra_bmodes] [10] [9] = " + braces(rfc.tolist()) + ";\n"
    (tmp_path / "rfc6386.txt").write_text("13.5. Default Token Probability Table\n" + page + text)
    got = vp8.Tables.load(str(tmp_path / "rfc6386.txt"))
    assert (got.coeff == own.coeff).all() and (got.update == own.update).all() and (got.mode == mode).all()
    (tmp_path / "short.txt").write_text(text[:900])
    with pytest.raises(ValueError):
        vp8.Tables.load(str(tmp_path / "short.txt"))


def test_tokens_of_all_sizes_are_read_back():
    """Levels of every category, empty blocks and skipped macroblocks, through the writer and the reader."""
    rng = np.random.default_rng(5)
    mh, mw = 3, 4
    draw = lambda *s: (rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 10, 11, 18, 19, 34, 35, 66, 67, 2047], s) * rng.choice([-1, 1], s)) * (rng.random(s[:-1] + (1,)) < 0.7)
    lv = vp8.Levels(draw(mh, mw, 16), draw(mh, mw, 16, 16), draw(mh, mw, 8, 16))
    small = rng.random((mh, mw)) < 0.5
    lv.y2[small] = 0
    lv.y[~small, :, 0] = 0
    for x in (lv.y2, lv.y, lv.uv):
        x[1, 2] = 0
    modes = vp8.Modes(small, rng.integers(0, 4, (mh, mw)), rng.integers(0, 4, (mh, mw)), rng.integers(0, 10, (mh, mw, 16)))
    for adapt in (False, True):
        frame = vp8.write_frame(16 * mh, 16 * mw, modes, lv, 10, adapt=adapt)
        t = vp8.Tables.plain()
        size = int.from_bytes(frame[:3], "little") >> 5
        head = boolcoder.Reader(frame[10 : 10 + size])
        probs, got = vp8._walk_header(head, None, t, None, None)
        back, skip = vp8._walk_modes(head, t, None, None, got.get("skip"), mh, mw)
        read = vp8._read_tokens([boolcoder.Reader(frame[10 + size :]).code], probs.tolist(), back.small, skip)
        assert all((a == b).all() for a, b in ((read.y2, lv.y2), (read.y, lv.y), (read.uv, lv.uv), (back.small, small)))


def test_trellis_finds_the_cheapest_levels():
    """Against all choices of rounding down or one up for a few coefficients, priced token by token as they are written."""
    t, s = vp8.Tables.plain(), quant.matrices(60)["y1"]
    rng = np.random.default_rng(2)
    bits = lambda p, bit: -256 * np.log2((256 - p if bit else p) / 256)

    def rate(lv, kind, first):
        total, ctx, free = 0.0, 1, False
        last = max((i for i in range(16) if lv[i]), default=-1)
        for i in range(first, 16):
            p = t.coeff[kind, vp8.BANDS[i], ctx]
            if not free:
                total += bits(p[0], i <= last)
            if i > last:
                break
            nodes, extra = vp8._token(int(lv[i]))
            total += sum(bits(p[k], b) for k, b in nodes) + sum(bits(x, b) for x, b in extra) + 256 * (lv[i] > 0)
            ctx, free = min(int(lv[i]), 2), lv[i] == 0
        return total

    for first, kind in ((0, 3), (1, 0)):
        for weight in (1.0, 40.0, 900.0):
            c = np.zeros((6, 16), np.int64)
            places = [quant.ZIGZAG[i] for i in (1, 2, 3, 5)]
            c[:, places] = rng.integers(-160, 161, (6, 4))
            got = np.abs(vp8.trellis(c, s, first, weight, t))[:, quant.ZIGZAG]
            for row, mine in zip(c, got, strict=True):
                size = (np.abs(row) + s.sharpen)[quant.ZIGZAG]
                step = s.q[quant.ZIGZAG]
                low = (size * s.iq[quant.ZIGZAG]) >> quant.FIX
                price = lambda lv: weight * rate(lv, kind, first) + 256 * float(((size - lv * step)[first:] ** 2).sum())  # noqa: B023, E731
                best = min(price(np.where(np.arange(16) <= last, low + np.array([choice >> i & 1 if i < 7 else 0 for i in range(16)]), 0) * (np.arange(16) >= first)) for last in range(-1, 16) for choice in range(128))
                assert price(mine) <= best + 1e-6


def test_partitions_hold_the_same_picture():
    rng = np.random.default_rng(4)
    a = np.clip(np.add.outer(np.arange(150), np.arange(90) * 2)[..., None] / 2 + rng.normal(0, 9, (150, 90, 3)), 0, 255).astype(np.uint8)
    frames = {n: vp8.encode_rgb([a], 80, partitions=n)[0][0] for n in (1, 2, 4, 8)}
    assert len(set(frames.values())) == 4
    want = vp8.decode_rgb(frames[1])
    assert all((vp8.decode_rgb(f) == want).all() for f in frames.values())
    with pytest.raises(ValueError):
        vp8.encode_rgb([a], 80, partitions=3)
    with pytest.raises(ValueError):
        vp8.decode_rgb(frames[8][: len(frames[8]) // 2])
