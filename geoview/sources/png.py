"""PNG images as pixel arrays and back, without an image library.

Reads grey, grey with alpha, RGB, RGBA and palette images of every depth, interlaced
or not; of 16 bits the upper eight are kept.  Others give null and a reason.  Files come through Spark's
``binaryFile`` reader, one image a row, so any path that Spark can open works.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpg

#: Fixed values of the format: its signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Fixed values of the format: bits a sample by colour type; first column and row
#: and steps of the passes of an interlaced image.
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def _averaged(now: list[int], above: list[int], step: int) -> bytearray:
    out = bytearray(step + len(now))
    for i, v in enumerate(now, step):
        out[i] = (v + (out[i - step] + above[i]) // 2) & 255
    return out


def _paeth(now: list[int], above: list[int], step: int) -> bytearray:
    out = bytearray(step + len(now))
    for i, v in enumerate(now, step):
        left, up, corner = out[i - step], above[i], above[i - step]
        dl, du, dc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        out[i] = (v + (left if dl <= du and dl <= dc else up if du <= dc else corner)) & 255
    return out


def _unfiltered(raw: bytes, line: int, height: int, step: int) -> np.ndarray:
    """Scan lines of ``line`` bytes without their filters; ``step`` is the bytes of a
    pixel, at least one."""
    rows = np.frombuffer(raw, np.uint8, height * (line + 1)).reshape(height, line + 1)
    out = np.zeros((height + 1, line + step), np.uint8)  # a border of zeros above and to the left
    for y in range(height):
        kind, now, above = rows[y, 0], rows[y, 1:], out[y]
        mine = out[y + 1]
        if kind == 0:
            mine[step:] = now
        elif kind == 1:  # the pixel to the left: a running sum
            mine[step:] = np.cumsum(now.reshape(-1, step), axis=0, dtype=np.uint32).astype(np.uint8).reshape(-1)
        elif kind == 2:
            mine[step:] = now + above[step:]
        elif kind in (3, 4):  # each byte needs the one before: plain numbers are fastest
            mine[:] = np.frombuffer((_averaged if kind == 3 else _paeth)(now.tolist(), above.tolist(), step), np.uint8)
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, step:]


def _samples(raw: bytes, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """Height x width x channels, and the bytes that they took."""
    bits = depth * channels
    line = (width * bits + 7) // 8
    if len(raw) < height * (line + 1):
        raise ValueError("too little data")
    rows = np.ascontiguousarray(_unfiltered(raw, line, height, max(1, bits // 8)))
    if depth == 16:
        rows = rows.view(">u2")
    elif depth < 8:
        places = 1 << np.arange(depth - 1, -1, -1)
        rows = np.unpackbits(rows, axis=1).reshape(height, -1, depth) @ places
        rows = rows[:, : width * channels]
    return rows.reshape(height, width, channels), height * (line + 1)


def _interlaced(raw: bytes, width: int, height: int, depth: int, channels: int) -> np.ndarray:
    out = np.zeros((height, width, channels), np.uint16)
    for x, y, dx, dy in PASSES:
        place = out[y::dy, x::dx]
        if place.size:
            part, took = _samples(raw, place.shape[1], place.shape[0], depth, channels)
            place[:] = part
            raw = raw[took:]
    return out


def decode(data: bytes) -> np.ndarray:
    """Height x width x 4, as red, green, blue and alpha."""
    if data[: len(SIGNATURE)] != SIGNATURE:
        raise ValueError("not a PNG file")
    head, body, palette, clear = None, [], None, None
    for kind, content in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(content, np.uint8)
    if head is None:
        raise ValueError("no header")
    width, height, depth, color, _, _, interlace = head
    if depth not in DEPTHS.get(color, ()) or interlace > 1:
        raise ValueError(f"depth {depth}, colour type {color}, interlace {interlace}")
    raw = zlib.decompress(b"".join(body))
    px = _interlaced(raw, width, height, depth, CHANNELS[color]) if interlace else _samples(raw, width, height, depth, CHANNELS[color])[0]
    out = np.full((height, width, 4), 255, np.uint8)
    if color == 3:
        index = px[:, :, 0]
        out[:, :, :3] = palette[index]
        if clear is not None:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = clear
            out[:, :, 3] = alpha[index]
        return out
    if clear is not None and color in (0, 2):  # one colour that is clear
        out[:, :, 3] = np.where((px == clear.view(">u2")).all(axis=2), 0, 255)
    px = (px >> 8 if depth == 16 else px * (255 // ((1 << depth) - 1))).astype(np.uint8)
    out[:, :, :3] = px[:, :, :1] if color in (0, 4) else px[:, :, :3]
    if color in (4, 6):
        out[:, :, 3] = px[:, :, -1]
    return out


def encode(pixels: np.ndarray) -> bytes:
    """An RGBA image as a PNG file."""
    height, width, _ = pixels.shape
    lines = np.zeros((height, width * 4 + 1), np.uint8)
    lines[:, 1:] = pixels.astype(np.uint8).reshape(height, -1)
    part = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def decode_images(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, width, height, rgba, error) of PNG or JPEG files, which their first bytes
    tell apart: pixels in row order, four values each."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(1)):
                px, error = None, None
                try:
                    raw = data.as_py() or b""
                    px = jpg.decode(raw) if raw[:2] == b"\xff\xd8" else decode(raw)
                except (ValueError, struct.error, zlib.error, TypeError, IndexError, KeyError) as e:
                    error = str(e)
                size = (None, None) if px is None else (px.shape[1], px.shape[0])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), pa.array([size[0]], pa.int32()), pa.array([size[1]], pa.int32()), pa.array([None if px is None else px.reshape(-1)], pa.list_(pa.int32())), pa.array([error], pa.string())],
                    names=[key, "width", "height", "rgba", "error"],
                )

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, width int, height int, rgba array<int>, error string")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return decode_images(spark.read.format("binaryFile").load(path))


def data_uri_bytes(uri: Column) -> Column:
    """The bytes of a base64 data URI, as embedded textures have."""
    return F.unbase64(F.regexp_extract(uri, r"^data:[^,]*;base64,(.*)$", 1))


def encode_images(images: DataFrame, key: str) -> DataFrame:
    """(key, content) from (key, width, height, rgba)."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (w, h, rgba) in enumerate(zip(*(b.column(j).to_pylist() for j in (1, 2, 3)))):
                data = encode(np.array(rgba, np.uint8).reshape(h, w, 4))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([data], pa.binary())], names=[key, "content"])

    return images.select(key, "width", "height", "rgba").mapInArrow(run, f"`{key}` {kind}, content binary")


def images_from_pixels(pixels: DataFrame, key: str, width: int, height: int, channels: tuple[str, str, str, str] = ("r", "g", "b", "a")) -> DataFrame:
    """(key, width, height, rgba) from pixel rows; absent pixels are clear, those
    outside the image are left out, and of several at one place the least holds.  Pixels are sorted, and each brings the
    clear ones before it along, so work grows with the image and no faster."""
    cell = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("at"), F.array(*[F.col(c).cast("int") for c in channels]).alias("v"))
    inside = pixels.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    rows = inside.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    rows = rows.withColumn("before", F.concat(F.array(F.lit(-1)), F.transform("cells", lambda c: c["at"])))
    clear = lambda n: F.array_repeat(F.lit(0), (n * 4).cast("int"))
    own = F.zip_with(
        "cells", F.slice("before", F.lit(1), F.size("cells")), lambda c, b: F.when(c["at"] > b, F.concat(clear(c["at"] - b - 1), c["v"])).otherwise(F.array().cast("array<int>"))
    )
    tail = clear(F.lit(width * height - 1) - F.element_at("before", -1))
    return rows.select(key, F.lit(width).alias("width"), F.lit(height).alias("height"), F.flatten(F.concat(own, F.array(tail))).alias("rgba"))
