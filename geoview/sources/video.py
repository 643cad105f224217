"""Videos as segments: uncompressed AVI files of a bounded number of frames.

Frames in order are cut into segments of equal length.  A task makes one segment, a
whole file with header, frames and index, whose sizes follow from the number of its
frames alone; nothing passes through the driver, and no file outgrows the format's
32-bit sizes.  Segments in the order of their names are the video.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as fr
from .sink import write_files

#: Bytes of a segment's frames, at most, if a frame is no larger.
SEGMENT_BYTES = 64 << 20


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def line_bytes(width: int) -> int:
    """A line of three bytes a pixel, filled up to four."""
    return -(-width * 3 // 4) * 4


def encode_segment(frames: list[np.ndarray], fps: float) -> bytes:
    """RGBA images of one size as an AVI file; alpha is left out."""
    height, width, _ = frames[0].shape
    if any(f.shape != frames[0].shape for f in frames):
        raise ValueError("frames of a video have one size")
    size, n = line_bytes(width) * height, len(frames)
    rate = round(fps * 1000)
    main = struct.pack("<14I", round(1e6 / fps), round(size * fps), 0, 0x10, n, 0, 1, size, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"DIB ", 0, 0, 0, 0, 1000, rate, 0, n, size, 0xFFFFFFFF, 0, 0, 0, width, height)
    pixel = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", pixel)))
    body, index = bytearray(), bytearray()
    for f in frames:
        lines = np.zeros((height, line_bytes(width)), np.uint8)
        lines[:, : width * 3] = f[::-1, :, 2::-1].reshape(height, -1)  # lines from below, blue first
        index += struct.pack("<4sIII", b"00db", 0x10, 4 + len(body), size)
        body += _chunk(b"00db", lines.tobytes())
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", bytes(body)) + _chunk(b"idx1", bytes(index)))


def decode_segment(data: bytes) -> Iterator[np.ndarray]:
    """The RGBA images of a file that ``encode_segment`` made, in the index's order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, entries, size = 12, None, b"", None
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            pixel = data.index(b"strf", at) + 8
            size = struct.unpack("<ii", data[pixel + 4 : pixel + 12])
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            entries = data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    if movi is None or size is None:
        raise ValueError("no frames or no header")
    width, height = size
    for i in range(0, len(entries), 16):
        start = movi + struct.unpack("<I", entries[i + 8 : i + 12])[0] + 8
        lines = np.frombuffer(data, np.uint8, line_bytes(width) * height, start).reshape(height, -1)
        out = np.full((height, width, 4), 255, np.uint8)
        out[:, :, :3] = lines[::-1, : width * 3].reshape(height, width, 3)[:, :, ::-1]
        yield out


def map_images(images: DataFrame, key: str, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Images (key, width, height, rgba) through a function of one image's array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (w, h, rgba) in enumerate(zip(*(b.column(j).to_pylist() for j in (1, 2, 3)))):
                px = np.asarray(change(np.array(rgba, np.uint8).reshape(h, w, 4)), np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([px.shape[1]], pa.int32()), pa.array([px.shape[0]], pa.int32()), pa.array([px.reshape(-1)], pa.list_(pa.int32()))], names=[key, "width", "height", "rgba"])

    return images.select(key, "width", "height", "rgba").mapInArrow(run, f"`{key}` {images.schema[key].dataType.simpleString()}, width int, height int, rgba array<int>")


def video_segments(frames: DataFrame, fps: float = 30.0, per_segment: int | None = None) -> DataFrame:
    """(segment, frames, content) from frames (out_id, width, height, rgba), out_id being
    gapless from 0; one job finds the size of a frame."""
    if per_segment is None:
        size = frames.agg(F.max(F.col("width") * 3 + 3), F.max("height")).first()
        per_segment = max(1, SEGMENT_BYTES // max(1, (size[0] or 1) * (size[1] or 1)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("out_id")
        images = [np.array(px, np.uint8).reshape(h, w, 4) for w, h, px in zip(*(t.column(c).to_pylist() for c in ("width", "height", "rgba")))]
        return pa.table({"segment": t.column("segment").slice(0, 1), "frames": pa.array([len(images)]), "content": pa.array([encode_segment(images, fps)], pa.binary())})

    cut = frames.select(F.floor(F.col("out_id") / per_segment).cast("long").alias("segment"), "out_id", "width", "height", "rgba")
    return cut.groupBy("segment").applyInArrow(run, "segment long, frames long, content binary")


def segment_frames(segments: DataFrame, key: str = "segment") -> DataFrame:
    """(key, at, width, height, rgba): frames of segments (key, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(1)):
                for at, px in enumerate(decode_segment(data.as_py())):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([at], pa.int32()), pa.array([px.shape[1]], pa.int32()), pa.array([px.shape[0]], pa.int32()), pa.array([px.reshape(-1)], pa.list_(pa.int32()))], names=[key, "at", "width", "height", "rgba"])

    return segments.select(key, "content").mapInArrow(run, f"`{key}` {segments.schema[key].dataType.simpleString()}, at int, width int, height int, rgba array<int>")


def write_video(images: DataFrame, order: str, path: str, fps: float = 30.0, first_repeats: int = 0, last_repeats: int = 0, change: Callable[[np.ndarray], np.ndarray] | None = None, per_segment: int | None = None) -> None:
    """Images (order, width, height, rgba) as ``{segment}.avi`` files under ``path``.

    The first and last are shown that many more times; ``change`` is applied to every
    image once.  Without images it is an error.
    """
    if images.isEmpty():
        raise ValueError("a video has an image at least")
    if change is not None:
        images = map_images(images, order, change)
    shown = fr.video_sequence(images.select(order, "width", "height", "rgba"), order, first_repeats, last_repeats)
    name: Column = F.lpad(F.col("segment").cast("string"), 8, "0")
    write_files(video_segments(shown, fps, per_segment), name, F.col("content"), path, ".avi", resume=False)


def delete_files(spark: SparkSession, paths: DataFrame, column: str = "path") -> int:
    """Deletes files, such as the frames of a finished video; how many went.  One that
    can't be deleted stays and is no error."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for row in paths.select(column).toLocalIterator():
        try:
            at = jvm.org.apache.hadoop.fs.Path(row[0])
            gone += bool(at.getFileSystem(conf).delete(at, False))
        except Exception:
            continue
    return gone
