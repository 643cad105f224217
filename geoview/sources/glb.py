"""Meshes and textures of glTF files, binary (.glb) or JSON with embedded buffers
(.gltf), as a Python data source.

``spark.read.format("glb").option("part", "triangles").load(path)`` reads the
first primitive of the first mesh: part ``vertices`` gives vid, x, y, z and u, v
(null without texture coordinates), ``triangles`` gives tid, a, b, c; a file without
a mesh has no rows.  Bytes come through Spark's own file reader in ``read_glb`` and
``read_textures``, which open any path that Spark can; the registered source reads
local paths.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from . import png

#: Fixed values of the format: component types and numbers of components.
COMPONENTS = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}
JSON_CHUNK, BINARY_CHUNK = 0x4E4F534A, 0x004E4942

SCHEMAS = {"vertices": "vid bigint, x double, y double, z double, u double, v double", "triangles": "tid bigint, a bigint, b bigint, c bigint"}


#: Tiles a side, pixels a tile and colours of the texture of meshes without one.
DEFAULT_TEXTURE = (8, 8, (255, 0, 255, 255), (0, 0, 0, 255))


def embedded(uri: str) -> bytes:
    """The bytes of a base64 data URI; other addresses are not followed."""
    head, _, body = uri.partition(",")
    if not (head.startswith("data:") and head.endswith(";base64")):
        raise ValueError("data that is not embedded")
    return base64.b64decode(body)


def chunks(data: bytes) -> tuple[dict, list[bytes]]:
    """The document and the buffers of a file."""
    if data[:4] != b"glTF":
        doc = json.loads(data)
        return doc, [embedded(b.get("uri", "")) for b in doc.get("buffers", [])]
    at, doc, binary = 12, {}, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == JSON_CHUNK:
            doc = json.loads(body)
        elif kind == BINARY_CHUNK:
            binary = body
        at += 8 + size
    return doc, [embedded(b["uri"]) if "uri" in b else binary for b in doc.get("buffers", [{}])]


def view_rows(doc: dict, buffers: list[bytes], at: dict, count: int, kind: np.dtype, width: int) -> np.ndarray:
    """``count`` rows of a buffer view, which may lie apart."""
    view = doc["bufferViews"][at["bufferView"]]
    start = view.get("byteOffset", 0) + at.get("byteOffset", 0)
    stride = view.get("byteStride") or kind.itemsize * width
    return np.ndarray((count, width), kind, buffers[view.get("buffer", 0)], start, (stride, kind.itemsize)).copy()


def accessor(doc: dict, buffers: list[bytes], index: int) -> np.ndarray:
    """The rows of an accessor: zeros without a view, then what is stored sparsely."""
    a = doc["accessors"][index]
    kind, width, count = np.dtype(COMPONENTS[a["componentType"]]), WIDTHS[a["type"]], a["count"]
    rows = view_rows(doc, buffers, a, count, kind, width) if "bufferView" in a else np.zeros((count, width), kind)
    if sparse := a.get("sparse"):
        n, where = sparse["count"], sparse["indices"]
        places = view_rows(doc, buffers, where, n, np.dtype(COMPONENTS[where["componentType"]]), 1)[:, 0]
        rows[places] = view_rows(doc, buffers, sparse["values"], n, kind, width)
    return rows


def first_primitive(doc: dict) -> dict | None:
    meshes = doc.get("meshes") or [{}]
    return next(iter(meshes[0].get("primitives", [])), None)


def mesh_rows(data: bytes, part: str) -> list[tuple]:
    doc, buffers = chunks(data)
    primitive = first_primitive(doc)
    if primitive is None:
        return []
    if part == "triangles":
        if "indices" in primitive:
            faces = accessor(doc, buffers, primitive["indices"]).reshape(-1, 3)
        else:
            faces = np.arange(doc["accessors"][primitive["attributes"]["POSITION"]]["count"]).reshape(-1, 3)
        return [(i, *map(int, f)) for i, f in enumerate(faces)]
    points = accessor(doc, buffers, primitive["attributes"]["POSITION"]).astype(float)
    uv = primitive["attributes"].get("TEXCOORD_0")
    at = accessor(doc, buffers, uv).astype(float) if uv is not None else [(None, None)] * len(points)
    return [(i, *map(float, p), *(None if c is None else float(c) for c in t)) for i, (p, t) in enumerate(zip(points, at))]


def texture_file(data: bytes) -> bytes | None:
    """The image file of the first primitive's base colour, if it has one."""
    doc, buffers = chunks(data)
    primitive = first_primitive(doc)
    if primitive is None:
        raise ValueError("no mesh")
    if "material" not in primitive:
        return None
    found = doc["materials"][primitive["material"]].get("pbrMetallicRoughness", {}).get("baseColorTexture")
    if found is None:
        return None
    textures = doc.get("textures")
    image = doc["images"][textures[found["index"]]["source"] if textures else found["index"]]
    if "uri" in image:
        return embedded(image["uri"])
    view = doc["bufferViews"][image["bufferView"]]
    start = view.get("byteOffset", 0)
    return buffers[view.get("buffer", 0)][start : start + view["byteLength"]]


def default_texture() -> np.ndarray:
    tiles, size, color, other = DEFAULT_TEXTURE
    tile = np.arange(tiles * size) // size
    even = (tile[:, None] + tile) % 2 == 0
    return np.where(even[:, :, None], color, other).astype(np.uint8)


def texture(data: bytes) -> np.ndarray:
    """The mesh's texture with its last row first, as texture coordinates count
    upwards; a checkerboard for a mesh without one."""
    file = texture_file(data)
    return default_texture() if file is None else png.decode(file)[::-1]


class GlbReader(DataSourceReader):
    def __init__(self, path: str, part: str) -> None:
        self.path, self.part = path, part

    def read(self, partition) -> Iterator[tuple]:
        with open(self.path.removeprefix("file://"), "rb") as f:
            yield from mesh_rows(f.read(), self.part)


class GlbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "glb"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "vertices")]

    def reader(self, schema) -> GlbReader:
        return GlbReader(self.options["path"], self.options.get("part", "vertices"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GlbSource)


def read_glb(spark: SparkSession, path: str, part: str = "vertices") -> DataFrame:
    """(path, vid or tid, ...) of all meshes under ``path``, one file a task."""
    names = [c.strip().split()[0] for c in SCHEMAS[part].split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = mesh_rows(content, part)
                for lo in range(0, len(rows), 1 << 16):
                    some = rows[lo : lo + (1 << 16)]
                    kinds = [pa.int64() if t == "bigint" else pa.float64() for t in (c.strip().split()[1] for c in SCHEMAS[part].split(","))]
                    columns = [pa.array(v, k) for v, k in zip(zip(*some), kinds)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), *columns], names=["path", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"path string, {SCHEMAS[part]}")


def read_textures(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgba, error) of all meshes under ``path``, one file a
    task; files without a mesh, and images that are no PNG, give nulls and a reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                width = height = rgba = error = None
                try:
                    image = texture(content.as_py())
                    height, width = image.shape[:2]
                    rgba = image.reshape(-1)
                except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
                columns = [pa.array([name]), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([rgba], pa.list_(pa.int32())), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "width", "height", "rgba", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, width int, height int, rgba array<int>, error string")
