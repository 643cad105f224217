"""Stencils over images of any size: tiles with a border of one pixel.

Pixels, as rows, go to the tile that they lie in and to those whose border they are;
behind the edges of the image the border is its reflection without the edge itself.
A tile is what a task holds, so no window or array spans an image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 256


def _homes(at: str, n: int, size: int) -> Column:
    """Tiles that need a coordinate, and where it stands in each, from -1."""
    v = F.col(at).cast("int")
    tile = F.floor(v / size).cast("int")
    place = lambda t, p: F.struct(t.cast("int").alias("tile"), p.cast("int").alias("at"))
    end = (n - 1) // size
    own = [
        place(tile, v - tile * size),
        F.when((v % size == 0) & (v > 0), place(tile - 1, F.lit(size))),
        F.when((v % size == size - 1) & (v < n - 1), place(tile + 1, F.lit(-1))),
        F.when(v == min(1, n - 1), place(F.lit(0), F.lit(-1))),
        F.when(v == max(n - 2, 0), place(F.lit(end), F.lit(n - end * size))),
    ]
    return F.array_compact(F.array(*own))


def tiles(pixels: DataFrame, image: str, value: str, width: int, height: int, size: int = SIZE) -> DataFrame:
    """(image, tx, ty, x, y, v): rows of tiles, x and y from -1 to the tile's size."""
    inside = pixels.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    rows = inside.select(image, F.explode(_homes("x", width, size)).alias("h__"), "y", F.col(value).cast("double").alias("v"))
    rows = rows.select(image, F.col("h__.tile").alias("tx"), F.col("h__.at").alias("x"), F.explode(_homes("y", height, size)).alias("h__"), "v")
    return rows.select(image, "tx", F.col("h__.tile").alias("ty"), "x", F.col("h__.at").alias("y"), "v")


def _array(t: pa.Table, width: int, height: int, size: int) -> tuple[np.ndarray, int, int]:
    """A tile with its border; pixels that are absent are not a number."""
    tx, ty = t.column("tx")[0].as_py(), t.column("ty")[0].as_py()
    w, h = min(size, width - tx * size), min(size, height - ty * size)
    out = np.full((h + 2, w + 2), np.nan)
    out[t.column("y").to_numpy() + 1, t.column("x").to_numpy() + 1] = t.column("v").to_numpy()
    return out, tx, ty


def _laplacian(a: np.ndarray) -> np.ndarray:
    return a[1:-1, :-2] + a[1:-1, 2:] + a[:-2, 1:-1] + a[2:, 1:-1] - 4 * a[1:-1, 1:-1]


def tiled_laplacian(pixels: DataFrame, image: str, value: str, width: int, height: int, size: int = SIZE) -> DataFrame:
    """(image, x, y, laplacian) of every pixel whose neighbours, reflected behind the
    edges, are all there."""

    def run(t: pa.Table) -> pa.Table:
        a, tx, ty = _array(t, width, height, size)
        out = _laplacian(a)
        y, x = np.nonzero(~np.isnan(out))
        return pa.table({image: t.column(image).take(pa.array(np.zeros(len(x), np.int64))), "x": pa.array((x + tx * size).astype(np.int32)), "y": pa.array((y + ty * size).astype(np.int32)), "laplacian": pa.array(out[y, x])})

    rows = tiles(pixels, image, value, width, height, size)
    return rows.groupBy(image, "tx", "ty").applyInArrow(run, f"`{image}` {pixels.schema[image].dataType.simpleString()}, x int, y int, laplacian double")


def tiled_laplacian_variance(pixels: DataFrame, image: str, value: str, width: int, height: int, size: int = SIZE) -> DataFrame:
    """(image, laplacian_variance): population variance over the whole image, from the
    count, mean and squares of each tile."""

    def run(t: pa.Table) -> pa.Table:
        out = _laplacian(_array(t, width, height, size)[0]).ravel()
        out = out[~np.isnan(out)]
        mean = out.mean() if len(out) else 0.0
        return pa.table({image: t.column(image).slice(0, 1), "n": pa.array([len(out)]), "mean": pa.array([mean]), "squares": pa.array([float(((out - mean) ** 2).sum())])})

    rows = tiles(pixels, image, value, width, height, size)
    parts = rows.groupBy(image, "tx", "ty").applyInArrow(run, f"`{image}` {pixels.schema[image].dataType.simpleString()}, n long, mean double, squares double")
    whole = parts.groupBy(image).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("squares") + F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    mean = F.col("s") / F.col("n")
    return whole.filter("n > 0").select(image, (F.col("q") / F.col("n") - mean * mean).alias("laplacian_variance"))
