"""Which shots may see which points: frustum footprints by cell.

A shot's footprint is what its frustum covers between the least and the greatest
height of the surface.  It takes the cells of an XY grid that no side plane of the
frustum leaves wholly outside; cells are a power of two wide, between a fourth and
half of the footprint's box, so a shot takes a dozen or two of them whatever its height, and
a point stands in one cell of each width in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import camera as cam

#: Cells along the longer side of a footprint's box, at most.
CELLS = 4
EPSILON = 1e-9
#: Shots whose cells are computed at once.
BATCH_SHOTS = 2_000
BOUNDS = ("x0", "x1", "y0", "y1", "z0", "z1")


def bounds_of(points: DataFrame, x: str, y: str, z: str) -> dict[str, float] | None:
    """The extent of a surface, or of a mesh that it lies on, by one aggregate; None
    if it is empty."""
    row = points.agg(*[f(c).alias(f"{n}{i}") for n, c in zip("xyz", (x, y, z)) for i, f in ((0, F.min), (1, F.max))]).first()
    return None if row["x0"] is None else {b: float(row[b]) for b in BOUNDS}


def mesh_bounds(triangles: DataFrame) -> dict[str, float] | None:
    """The extent of a mesh, by one aggregate."""
    row = triangles.agg(*[f(g(*[F.col(f"{k}{n}") for k in "abc"])).alias(f"{n}{i}") for n in "xyz" for i, f, g in ((0, F.min, F.least), (1, F.max, F.greatest))]).first()
    return None if row["x0"] is None else {b: float(row[b]) for b in BOUNDS}


def _cells_of(axes: np.ndarray, wide: np.ndarray, high: np.ndarray, ortho: bool, b: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shot, level, gx, gy) of all cells of some shots; ``axes`` (shots, 4, 3) has
    their right, up and forward directions and their position.

    Where a corner ray does not cross both heights the box is that of the bounds,
    and only the planes tell cells apart.
    """
    right, up, forward, at = (axes[:, i] for i in range(4))
    aside = np.stack([x * wide[:, None] * right + y * high[:, None] * up for x in (-1, 1) for y in (-1, 1)], 1)
    start = at[:, None] + aside if ortho else np.repeat(at[:, None], 4, 1)
    ray = np.repeat(forward[:, None], 4, 1) if ortho else forward[:, None] + aside
    # Half-spaces n . p + k >= 0 whose common part is what the camera sees: beside
    # it, and in front of a perspective one.
    if ortho:
        normal = np.stack([right, -right, up, -up], 1)
        k = np.stack([wide, wide, high, high], 1) - (normal * at[:, None]).sum(2)
    else:
        normal = np.stack([s * a + w[:, None] * forward for a, w in ((right, wide), (up, high)) for s in (1, -1)] + [forward], 1)
        k = -(normal * at[:, None]).sum(2)
    crosses = (ray[..., 2] < -EPSILON).all(1) | (ray[..., 2] > EPSILON).all(1)
    slope = np.where(crosses[:, None], ray[..., 2], 1.0)
    t = np.stack([(b[z] - start[..., 2]) / slope for z in ("z0", "z1")], 2)
    near, far = t.min(2), t.max(2)
    seen = np.ones(len(at), bool) if ortho else ~(crosses & (far.min(1) < 0))
    near = near if ortho else np.maximum(near, 0.0)  # what is behind is not seen
    low, high_ = np.empty((len(at), 2)), np.empty((len(at), 2))
    for i, c in enumerate("xy"):
        ends = np.concatenate([start[..., i] + e * ray[..., i] for e in (near, far)], 1)
        pad = (b[f"{c}1"] - b[f"{c}0"]) * 1e-9 + 1e-9
        low[:, i], high_[:, i] = np.where(crosses, ends.min(1), b[f"{c}0"]) - pad, np.where(crosses, ends.max(1), b[f"{c}1"]) + pad
    level = np.ceil(np.log2(np.maximum((high_ - low).max(1), 1e-6) / CELLS)).astype(np.int32)
    size = np.exp2(level.astype(float))
    low, high_ = np.maximum(low, [b["x0"], b["y0"]]), np.minimum(high_, [b["x1"], b["y1"]])
    seen &= (low <= high_).all(1) & np.isfinite(low).all(1)
    first = np.floor(np.where(seen[:, None], low, 0) / size[:, None]).astype(np.int64)
    counts = np.where(seen[:, None], np.floor(np.where(seen[:, None], high_, 0) / size[:, None]).astype(np.int64) - first + 1, 0)
    total = counts.prod(1)
    shot = np.repeat(np.arange(len(at)), total)
    step = np.arange(len(shot)) - np.repeat(np.cumsum(total) - total, total)
    gx, gy = first[shot, 0] + step // counts[shot, 1], first[shot, 1] + step % counts[shot, 1]
    # The corner of a cell's box that is farthest inside a plane is not outside it.
    place = np.stack([(gx + 0.5) * size[shot], (gy + 0.5) * size[shot], np.full(len(shot), (b["z0"] + b["z1"]) / 2)], 1)
    tall = (b["z1"] - b["z0"]) / 2
    kept = np.ones(len(shot), bool)
    for i in range(normal.shape[1]):
        n, own = normal[shot, i], k[shot, i]
        most = (np.abs(n[:, 0]) + np.abs(n[:, 1])) * size[shot] / 2 + np.abs(n[:, 2]) * tall
        kept &= (n * place).sum(1) + own + most >= -1e-9 * (1 + np.abs(own))
    return shot[kept], level[shot[kept]], gx[kept], gy[kept]


def with_cells(shots: DataFrame, camera: cam.Camera, bounds: dict[str, float]) -> DataFrame:
    """``shots`` with a row ``level__``, ``gx__``, ``gy__`` for each cell of their footprint.

    The geometry is a numpy function of Arrow batches: generated code for the same
    arithmetic is beyond what the JVM compiles, and took four times as long.
    """
    t = camera.transform
    if camera.ortho:
        wide, high = camera.width / 2, camera.height / 2
    else:
        high = F.tan(F.radians(camera.fovy_deg) / 2)
        wide = camera.aspect * high
    axes = [c for axis in (t.direction("right"), t.direction("up"), t.direction("forward"), t.position) for c in axis]
    own, ortho = len(shots.columns), camera.ortho
    rows = shots.select("*", F.array(*[c.cast("double") for c in (*axes, wide, high)]).alias("pose__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH_SHOTS):
                some = b.slice(at, BATCH_SHOTS)
                pose = np.asarray(some.column(own).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, 14)
                with np.errstate(all="ignore"):  # poses with nulls see nothing
                    shot, *cells = _cells_of(pose[:, :12].reshape(-1, 4, 3), pose[:, 12], pose[:, 13], ortho, bounds)
                taken = some.select(range(own)).take(pa.array(shot))
                yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, cells)], schema=pa.schema([*taken.schema, ("level__", pa.int32()), ("gx__", pa.int64()), ("gy__", pa.int64())]))

    more = [T.StructField("level__", T.IntegerType()), T.StructField("gx__", T.LongType()), T.StructField("gy__", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*shots.schema.fields, *more]))


def met_by_cell(surface: DataFrame, shots: DataFrame, on: list[str], camera: cam.Camera, point: tuple[str, str, str], bounds: dict[str, float] | None) -> DataFrame:
    """Points and shots of equal keys that a cell brings together.

    Two small jobs run at once: the extent of the surface, unless ``bounds`` has it,
    and the cell widths that shots use.
    """
    bounds = bounds or bounds_of(surface, *point)
    if bounds is None:
        return surface.limit(0).join(shots, on) if on else surface.limit(0).crossJoin(shots)
    seen = with_cells(shots, camera, bounds)
    levels = sorted(r[0] for r in seen.select("level__").distinct().collect())  # powers of two
    placed = surface.withColumn("level__", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
    size = F.pow(F.lit(2.0), F.col("level__"))
    placed = placed.withColumns({"gx__": F.floor(F.col(point[0]) / size).cast("long"), "gy__": F.floor(F.col(point[1]) / size).cast("long")})
    return placed.join(seen, [*on, "level__", "gx__", "gy__"]).drop("level__", "gx__", "gy__")
