"""Image headers, whole and damaged."""

import hashlib
import struct
import zlib

import pytest

from quoin.sources import images as I


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return I.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"x" * 40) + chunk(b"IEND", b"")


def jpeg(w, h, frame=0xC0):
    seg = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + b"\xff\xc0" * 300) + b"\xff" + seg(0xC4, b"\0" * 20) + seg(frame, struct.pack(">BHHB", 8, h, w, 3) + b"\0" * 9) + seg(0xDA, b"\0" * 6) + b"scan" * 9 + b"\xff\xd9"


def bmp(w, h):
    return b"BM" + struct.pack("<IHHI", 54 + 12, 0, 0, 54) + struct.pack("<Iii", 40, w, h) + b"\0" * 28 + b"\0" * 12


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def tiff(w, h, order="<", kind=3):
    value = lambda v: struct.pack(order + ("HH" if kind == 3 else "I"), *((v, 0) if kind == 3 else (v,)))
    rows = [struct.pack(order + "HHI", tag, kind, 1) + value(v) for tag, v in ((254, 0), (256, w), (257, h))]
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 12) + b"pad!" + struct.pack(order + "H", 3) + b"".join(rows) + b"\0" * 4


WHOLE = {
    "a.png": (png(2940, 833), ("png", 2940, 833)), "b.jpg": (jpeg(700, 600), ("jpeg", 700, 600)), "c.jpeg": (jpeg(65000, 3, 0xC2), ("jpeg", 65000, 3)), "d.bmp": (bmp(1700, -1500), ("bmp", 1700, 1500)),
    "e.webp": (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300 | 0x4000, 200) + b"\0" * 9), ("webp", 300, 200)), "f.webp": (webp(b"VP8L", b"\x2f" + struct.pack("<I", 299 | 199 << 14)), ("webp", 300, 200)),
    "g.WEBP": (webp(b"VP8X", b"\0" * 4 + (4999).to_bytes(3, "little") + (1).to_bytes(3, "little")), ("webp", 5000, 2)), "h.tif": (tiff(1200, 1000), ("tiff", 1200, 1000)), "i.tiff": (tiff(1201, 1001, ">", 4), ("tiff", 1201, 1001)),
}
BROKEN = {"k.png": (b"not an image", "not an image of a known format"), "l.png": (png(0, 5), "image has no extent"), "m.png": (I.PNG + b"\0\0\0\x0dIHDR" + b"\0" * 17, "header is damaged"), "n.jpg": (b"\xff\xd8\xff\xda\0\4", "header has no frame")}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_headers_and_every_way_to_cut_them(name):
    data, want = WHOLE[name]
    assert I.image_size(data) == want
    for n in range(len(data)):
        with pytest.raises(ValueError):
            I.image_size(data[:n])


def test_preflight_of_a_folder(spark, tmp_path):
    for name, (data, _) in {**WHOLE, **BROKEN, "notes.txt": (b"x", None), "j.png": (b"", None)}.items():  # Spark's reader passes empty files over
        (tmp_path / name).write_bytes(data)
    got = {r.path.split("/")[-1]: r for r in I.preflight(spark, str(tmp_path)).collect()}
    assert set(got) == {*WHOLE, *BROKEN}
    for name, (data, want) in WHOLE.items():
        r = got[name]
        assert (r.format, r.width, r.height) == want and r.error is None and r.sha256 == hashlib.sha256(data).hexdigest() and r.size_bytes == len(data)
    assert {n: got[n].error for n in BROKEN} == {n: e for n, (_, e) in BROKEN.items()} and all(got[n].planned_tiles is None for n in BROKEN)
    assert [got[n].planned_tiles for n in ("a.png", "b.jpg", "d.bmp", "h.tif", "i.tiff")] == [3, 1, 4, 1, 4]


def test_empty_files():
    with pytest.raises(ValueError, match="empty"):
        I.image_size(b"")


def test_images_must_have_the_size_of_their_raster(spark):
    images = spark.createDataFrame([("a", 10, 12, None), ("b", 10, 12, None), ("c", 10, 12, None), ("d", None, None, "file is empty")], "k string, width long, height long, error string")
    rasters = spark.createDataFrame([("a", 10, 12, 2, 1, 10, 9), ("b", 12, 10, 0, 0, 5, 5), ("d", 1, 1, 0, 0, 1, 1)], "k string, w long, h long, x0 long, y0 long, x1 long, y1 long")
    got = {r.k: r for r in I.framed(images, rasters, "k").collect()}
    assert [(got["a"][c]) for c in ("x0", "y0", "x1", "y1", "error")] == [2, 1, 10, 9, None]
    assert got["b"].error == "image and depth differ in size" and got["b"].x0 is None
    assert [(got["c"][c]) for c in ("x0", "y0", "x1", "y1", "error")] == [0, 0, 10, 12, None] and got["d"].error == "file is empty"
