"""Image pre-flight: format and size of every image from its header, before any work on it is planned.

Headers of PNG, JPEG, BMP, WebP and TIFF are read in Arrow batches, bounded by bytes; pixels are not decoded. A file that is
no image, whose header is damaged, or that ends before its own header says becomes a row with an error, never a failed job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators.detection import OVERLAP, TILE, starts

from .files import IMAGES

# Signatures, and the JPEG markers of frames and of segments without a length.
PNG, WEBP_KINDS = b"\x89PNG\r\n\x1a\n", (b"VP8 ", b"VP8L", b"VP8X")
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset({0x01, *range(0xD0, 0xD9)})


def _png(d: bytes) -> tuple[int, int]:
    length, kind = struct.unpack_from(">I4s", d, 8)
    if kind != b"IHDR" or length != 13 or zlib.crc32(d[12:29]) != struct.unpack_from(">I", d, 29)[0]:
        raise ValueError("header is damaged")
    if not 0 <= d.rfind(b"IEND") <= len(d) - 8:  # with its checksum
        raise ValueError("file is cut short")
    return struct.unpack_from(">II", d, 16)


def _jpeg(d: bytes) -> tuple[int, int]:
    at = 2
    while at + 4 <= len(d):
        if d[at] != 0xFF:
            raise ValueError("header is damaged")
        marker = d[at + 1]
        if marker == 0xFF:  # fill
            at += 1
        elif marker in BARE:
            at += 2
        elif marker in FRAMES:
            high, wide = struct.unpack_from(">HH", d, at + 5)
            if d.rfind(b"\xff\xd9") < at:
                raise ValueError("file is cut short")
            return wide, high
        elif marker in (0xD9, 0xDA):
            raise ValueError("header has no frame")
        else:
            at += 2 + struct.unpack_from(">H", d, at + 2)[0]
    raise ValueError("file is cut short")


def _bmp(d: bytes) -> tuple[int, int]:
    total, start, header = struct.unpack_from("<I4xII", d, 2)
    wide, high = struct.unpack_from("<HH" if header == 12 else "<ii", d, 18)
    if header != 12 and header < 40 or start < 14 + header:
        raise ValueError("header is damaged")
    if len(d) < max(total, start):
        raise ValueError("file is cut short")
    return wide, abs(high)


def _webp(d: bytes) -> tuple[int, int]:
    total, kind = struct.unpack_from("<I4x4s", d, 4)
    if kind not in WEBP_KINDS:
        raise ValueError("header is damaged")
    if len(d) < total + 8:
        raise ValueError("file is cut short")
    if kind == b"VP8X":
        return 1 + int.from_bytes(d[24:27], "little"), 1 + int.from_bytes(d[27:30], "little")
    if kind == b"VP8L":
        (bits,) = struct.unpack_from("<I", d, 21)
        if d[20] != 0x2F:
            raise ValueError("header is damaged")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if d[23:26] != b"\x9d\x01\x2a":
        raise ValueError("header is damaged")
    wide, high = struct.unpack_from("<HH", d, 26)
    return wide & 0x3FFF, high & 0x3FFF


def _tiff(d: bytes) -> tuple[int, int]:
    order = "<" if d[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", d, 4)
    (n,) = struct.unpack_from(order + "H", d, at)
    if len(d) < at + 2 + 12 * n + 4:
        raise ValueError("file is cut short")
    found = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", d, at + 2 + 12 * i)
        if tag in (256, 257) and count == 1 and kind in (3, 4):
            (found[tag],) = struct.unpack_from(order + ("H" if kind == 3 else "I"), d, at + 10 + 12 * i)
    if len(found) < 2:
        raise ValueError("header is damaged")
    return found[256], found[257]


def image_size(d: bytes) -> tuple[str, int, int]:
    """Format, width and height of an image file; ValueError says what is wrong with it."""
    known = (
        ("png", d.startswith(PNG), _png), ("jpeg", d.startswith(b"\xff\xd8\xff"), _jpeg), ("bmp", d.startswith(b"BM"), _bmp),
        ("webp", d.startswith(b"RIFF") and d[8:12] == b"WEBP", _webp), ("tiff", d[:4] in (b"II*\0", b"MM\0*"), _tiff),
    )
    for name, yes, read in known:
        if yes:
            try:
                wide, high = read(d)
            except (struct.error, IndexError) as e:
                raise ValueError("file is cut short") from e
            if wide <= 0 or high <= 0:
                raise ValueError("image has no extent")
            return name, wide, high
    raise ValueError("file is empty" if not d else "not an image of a known format")


def sized(files: DataFrame, content: str = "content") -> DataFrame:
    """files with format, width, height, error in the place of their content."""
    keep = [c for c in files.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d in b.column(content).to_pylist():
                try:
                    rows.append((*image_size(d or b""), None))
                except ValueError as e:
                    rows.append((None, None, None, str(e)))
            kind, wide, high, error = zip(*rows, strict=True) if rows else ((),) * 4
            new = [pa.array(kind, pa.string()), pa.array(wide, pa.int64()), pa.array(high, pa.int64()), pa.array(error, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], [*keep, "format", "width", "height", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != content)
    return files.mapInArrow(run, f"{schema}{', ' * bool(keep)}format string, width long, height long, error string")


def preflight(spark: SparkSession, path: str, recursive: bool = False, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, size_bytes, sha256, format, width, height, error, planned_tiles) of each image file; Spark's reader of binary
    files passes empty ones over."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    f = f.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    out = sized(f.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content"))
    side = lambda c, n: F.size(starts(F.col(c).cast("int"), n, OVERLAP))
    return out.withColumn("planned_tiles", F.when(F.col("error").isNull(), side("width", TILE[0]) * side("height", TILE[1])))


def framed(images: DataFrame, rasters: DataFrame, key: str) -> DataFrame:
    """images (key, width, height, error) with the part that is read (x0..y1): the foreground of the view's raster (key, w,
    h, x0..y1), or the whole image where there is none. An image of another size than its raster has an error."""
    r = rasters.select(key, "w", "h", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    out = images.join(r, key, "left")
    differ = F.col("w").isNotNull() & ((F.col("w") != F.col("width")) | (F.col("h") != F.col("height")))
    out = out.withColumn("error", F.coalesce("error", F.when(differ, "image and depth differ in size")))
    whole = {"x0": F.lit(0), "y0": F.lit(0), "x1": F.col("width"), "y1": F.col("height")}
    return out.withColumns({c: F.when(F.col("error").isNull(), F.coalesce(F.col(f"_{c}"), v).cast("long")) for c, v in whole.items()}).drop("w", "h", *[f"_{c}" for c in whole])
