"""Simple formats, written here by hand."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.functions import formats
from rastrel.operators import convert
from rastrel.sources import jvm

A = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)


def bmp(a):
    h, w, n = a.shape
    rows = b"".join(r[:, ::-1].tobytes() + bytes(-(w * n) % 4) for r in a[::-1])
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(rows), 0, 54, 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def qoi(a):
    h, w, _ = a.shape
    return b"qoif" + struct.pack(">IIBB", w, h, 4, 0) + b"".join(b"\xff" + bytes(p) for p in a.reshape(-1, 4)) + bytes(7) + b"\1"


def test_pixels():
    assert (convert.read_any(bmp(A))[0][..., :3] == A).all()
    assert (convert.read_any(b"P6\n# note\n7 5 255\n" + A.tobytes())[0][..., :3] == A).all()
    assert (convert.read_any(b"P5 7 5 255\n" + A[..., 0].tobytes())[0][..., 1] == A[..., 0]).all()
    assert formats.pnm(b"P1\n3 1\n1 0 1\n")[0, :, 0].tolist() == [0, 255, 0]
    rgba = np.dstack([A, A[..., :1]])
    assert (formats.qoi(qoi(rgba)) == rgba).all()
    t = bytes([0, 0, 2]) + bytes(9) + struct.pack("<HHBB", 7, 5, 24, 0x20) + A[..., ::-1].tobytes()
    assert (convert.read_any(t)[0][..., :3] == A).all()


def test_qoi_operations():
    ops = bytes([0xFE, 10, 20, 30, 0xC1, 0x40 | 3 << 4 | 2 << 2 | 1, 0x80 | 40, 0x97, (3 * 10 + 5 * 20 + 7 * 30 + 11 * 255) % 64])
    got = formats.qoi(b"qoif" + struct.pack(">IIBB", 6, 1, 3, 0) + ops)[0, :, :3].tolist()
    assert got == [[10, 20, 30]] * 3 + [[11, 20, 29], [20, 28, 36], [10, 20, 30]]


@pytest.mark.parametrize("data", [bmp(A)[:80], b"P6 7 5 255\n" + bytes(9), qoi(np.dstack([A, A[..., :1]]))[:50], b"P6 x", b"qoif" + bytes(10)])
def test_broken(data):
    with pytest.raises((ValueError, IndexError, struct.error)):
        convert.read_any(data)


def test_jpeg_metadata():
    seg = lambda k, b: bytes([0xFF, k]) + struct.pack(">H", len(b) + 2) + b
    d = b"\xff\xd8" + seg(0xE1, b"Exif\0\0II") + seg(0xE2, b"ICC_PROFILE\0\2\2two") + seg(0xE2, b"ICC_PROFILE\0\1\2one") + b"\xff\xda"
    m = formats.jpeg_meta(d)
    assert m["exif_raw"] == b"II" and m["icc_raw"] == b"onetwo"


def test_pictures_by_the_jvm(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(bmp(A))
    (tmp_path / "b.bmp").write_bytes(b"BM no picture")
    r = jvm.images(spark, f"file:{tmp_path}").where(F.col("h") == 5).collect()
    assert len(r) == 1
    assert (np.frombuffer(bytes(r[0].rgba), np.uint8).reshape(5, 7, 4)[..., :3] == A).all()


def by_the_jvm(spark, a, kind, progressive=False, quality=0.9):
    """A picture written by the JVM, and the JVM's reading of it."""
    jvm_ = spark.sparkContext._jvm
    io, image = jvm_.javax.imageio, jvm_.java.awt.image.BufferedImage(a.shape[1], a.shape[0], 1)
    ints = spark.sparkContext._gateway.new_array(jvm_.int, a.shape[0] * a.shape[1])
    for i, v in enumerate((a.astype(np.int64) @ [65536, 256, 1]).ravel().tolist()):
        ints[i] = v
    image.setRGB(0, 0, a.shape[1], a.shape[0], ints, 0, a.shape[1])
    out = jvm_.java.io.ByteArrayOutputStream()
    if kind == "jpeg":
        writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
        p = writer.getDefaultWriteParam()
        p.setCompressionMode(2)
        p.setCompressionQuality(quality)
        p.setProgressiveMode(1 if progressive else 0)
        writer.setOutput(io.stream.MemoryCacheImageOutputStream(out))
        s = io.ImageIO.createImageOutputStream(out)
        writer.setOutput(s)
        writer.write(None, io.IIOImage(image, None, None), p)
        s.close()
    else:
        io.ImageIO.write(image, kind, out)
    data = bytes(out.toByteArray())
    back = io.ImageIO.read(jvm_.java.io.ByteArrayInputStream(data))
    got = np.array(list(back.getRGB(0, 0, a.shape[1], a.shape[0], None, 0, a.shape[1])), np.int64).reshape(a.shape[:2])
    return data, np.stack([got >> 16 & 255, got >> 8 & 255, got & 255], -1)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize(("h", "w"), [(16, 16), (33, 50), (1, 7)])
def test_jpeg_is_read_as_the_jvm_reads_it(spark, h, w, progressive):
    y, x = np.mgrid[0:h, 0:w]
    a = np.clip(np.stack([x * 5, y * 7 + 20, 200 - x * 2], -1) + np.random.default_rng(1).normal(0, 4, (h, w, 3)), 0, 255).astype(np.uint8)
    data, want = by_the_jvm(spark, a, "jpeg", progressive)
    assert (b"\xff\xc2" in data) == progressive
    got = convert.read_any(data)[0]
    assert got.shape == (h, w, 4) and (got[..., 3] == 255).all()
    # chroma is repeated here and smoothed there
    assert np.abs(got[..., :3].astype(int) - want).mean() < 3 and np.abs(got[..., :3].astype(int) @ [299, 587, 114] // 1000 - want @ [299, 587, 114] // 1000).mean() < 1.5


def test_gif_is_read_as_the_jvm_reads_it(spark):
    a = np.random.default_rng(2).integers(0, 4, (40, 61, 1)).repeat(3, 2).astype(np.uint8) * 60
    data, want = by_the_jvm(spark, a, "gif")
    assert (convert.read_any(data)[0][..., :3] == want).all() and (want == a).all()
    with pytest.raises((ValueError, IndexError)):
        convert.read_any(data[:60])


def test_broken_jpeg(spark):
    data, _ = by_the_jvm(spark, np.zeros((9, 9, 3), np.uint8), "jpeg")
    for cut in (2, 4, 30, len(data) // 2):
        with pytest.raises((ValueError, IndexError, KeyError, struct.error)):
            convert.read_any(data[:cut])


def test_jpeg_files_are_converted(spark):
    y, x = np.mgrid[0:24, 0:40]
    a = np.stack([x * 4, y * 6, x + y], -1).astype(np.uint8)
    rows = [("a.jpg", bytearray(by_the_jvm(spark, a, "jpeg")[0])), ("b.gif", bytearray(by_the_jvm(spark, a // 64 * 64, "gif")[0])), ("c.jpg", bytearray(b"\xff\xd8\xff\xe0"))]
    got = {r.rel: r for r in convert.convert(spark.createDataFrame(rows, "rel string, content binary"), min_psnr=25.0).collect()}
    assert {k: r.status for k, r in got.items()} == {"a.jpg": "ok", "b.gif": "ok", "c.jpg": "fail"}
    assert convert.decode_webp(bytes(got["a.jpg"].bytes)).shape == (24, 40, 4)
