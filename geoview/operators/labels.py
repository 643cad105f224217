"""Object labels: boxes, formats, tracks and suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LABEL_COLORS
from ..functions.geometry import truncated


def yolo_corners(xc: Column, yc: Column, w: Column, h: Column, width: int, height: int) -> dict[str, Column]:
    """Pixel corners of a normalised box, towards zero."""
    half_w, half_h = w / 2, h / 2
    return {
        "x1": truncated((xc - half_w) * width),
        "y1": truncated((yc - half_h) * height),
        "x2": truncated((xc + half_w) * width),
        "y2": truncated((yc + half_h) * height),
    }


def quad_of(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Eight values, clockwise from the top left."""
    return F.array(x1, y1, x2, y1, x2, y2, x1, y2)


def without_closing_vertex(coords: Column) -> Column:
    """An interleaved ring without its last (x, y) pair."""
    return F.slice(coords, F.lit(1), F.greatest(F.size(coords) - 2, F.lit(0)))


def deinterleaved(coords: Column) -> tuple[Column, Column]:
    """Integer xs and ys of an interleaved list of numbers or texts."""
    whole = lambda v: v.cast("double").cast("int")
    return F.transform(F.filter(coords, lambda _, i: i % 2 == 0), whole), F.transform(F.filter(coords, lambda _, i: i % 2 == 1), whole)


def polyline_box(coords: Column) -> dict[str, Column]:
    """Enclosing box of an interleaved polyline."""
    xs, ys = deinterleaved(coords)
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def box_yolo(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """Normalised (xc, yc, w, h), or null if the box lies fully outside.

    A box that touches or crosses the image is kept as it is, not clipped.
    """
    left, right, top, bottom = x1 / width, x2 / width, y1 / height, y2 / height
    outside = (left > 1) | (right < 0) | (top > 1) | (bottom < 0)
    box = F.struct(((left + right) / 2).alias("xc"), ((top + bottom) / 2).alias("yc"), (right - left).alias("w"), (bottom - top).alias("h"))
    return F.when(~outside, box)


def track_boxes(boxes: DataFrame, by: list[str], order: list[str], class_col: str = "class_id") -> DataFrame:
    """Enclosing box of each group, with the class of its first row by ``order``.

    All of it is a partial aggregate: one small row per group and task is
    shuffled, and a group of any size stays one row.
    """
    return boxes.groupBy(*by).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.min_by(class_col, F.struct(*order)).alias(class_col), F.count(F.lit(1)).alias("boxes"),
    )


def merged_tracks(window: DataFrame, boxes: DataFrame, frame_col: str = "frame_id", track_col: str = "track_id", ties: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Enclosing boxes of tracks over each frame and its neighbours.

    ``window`` has (by, frame, neighbour_id, phase), with phase 0 for the frame itself;
    frames of equal ``by`` columns (a flight) meet.  The class is that of the first
    state by phase, neighbour and ties.  Boxes of a frame and track merge first, so
    that the window multiplies one row for each of these.
    """
    by, order = by or [], F.struct(*(ties or ["class_id"]))
    first = boxes.groupBy(*by, F.col(frame_col).alias("neighbour_id"), track_col).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.min(order).alias("tie__"), F.min_by("class_id", order).alias("class_id"), F.count(F.lit(1)).alias("n__"),
    )
    met = window.join(first, [*by, "neighbour_id"])
    return met.groupBy(*by, frame_col, track_col).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.min_by("class_id", F.struct("phase", "neighbour_id", "tie__")).alias("class_id"), F.sum("n__").alias("boxes"),
    )


def _area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 for empty boxes."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))
    union = _area(a) + _area(b) - w * h
    return F.when(union > 0, (w * h) / union).otherwise(F.lit(0.0))


#: Polylines are dealt to so many times the tasks of a shuffle, as each is many pixels.
DRAWING_TASKS = 4
#: Boxes of a group that are compared without a grid.
FEW_BOXES = 48


def _suppressed(shapes: np.ndarray, max_iou: float) -> np.ndarray:
    """Which boxes stay, of rows (x1, y1, x2, y2) in their order.

    Kept boxes stand in the cells of a grid about as wide as boxes are; a box is
    compared with those kept in its cells alone, as no other can overlap it.
    """
    n = len(shapes)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    x1, y1, x2, y2 = shapes.T
    area = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    cell = float(max(np.mean(np.maximum(x2 - x1, 0)), np.mean(np.maximum(y2 - y1, 0)), 1e-9)) * 2
    grid: dict[tuple[int, int], list[int]] = {}
    wide: list[int] = []  # kept boxes of very many cells, compared with all
    low = np.floor(shapes[:, :2] / cell).astype(np.int64).tolist()
    high = np.floor(shapes[:, 2:] / cell).astype(np.int64).tolist()
    for i in range(n):
        (a, b), (c, d) = low[i], high[i]
        if not area[i] > 0:
            keep[i] = max_iou >= 0  # an empty box overlaps nothing
            continue
        many = (c - a + 1) * (d - b + 1) > 64
        if many:
            near = np.flatnonzero(keep[:i])
        else:
            near = np.array(sorted({k for gx in range(a, c + 1) for gy in range(b, d + 1) for k in grid.get((gx, gy), ())} | set(wide)), np.int64)
        if len(near):
            w = np.minimum(x2[near], x2[i]) - np.maximum(x1[near], x1[i])
            h = np.minimum(y2[near], y2[i]) - np.maximum(y1[near], y1[i])
            both = np.maximum(w, 0) * np.maximum(h, 0)
            if (both / (area[near] + area[i] - both) > max_iou).any():
                continue
        keep[i] = True
        if many:
            wide.append(i)
        else:
            for gx in range(a, c + 1):
                for gy in range(b, d + 1):
                    grid.setdefault((gx, gy), []).append(i)
    return keep


def _few(shapes: np.ndarray, max_iou: float) -> list[bool]:
    """The same for a few boxes, each compared with all that were kept."""
    kept: list[tuple] = []
    out = []
    for x1, y1, x2, y2 in shapes.tolist():
        own = max(x2 - x1, 0.0) * max(y2 - y1, 0.0)
        stays = True
        for a1, b1, a2, b2, area in kept:
            w, h = min(x2, a2) - max(x1, a1), min(y2, b2) - max(y1, b1)
            both = w * h if w > 0 and h > 0 else 0.0
            union = own + area - both
            if (both / union if union > 0 else 0.0) > max_iou:
                stays = False
                break
        out.append(stays)
        if stays:
            kept.append((x1, y1, x2, y2, own))
    return out


def nms(boxes: DataFrame, by: list[str], order: list[str], max_iou: float, literal: bool = False) -> DataFrame:
    """Greedy suppression within each group, in the given order: a box stays if
    its overlap with every box that stayed is at most ``max_iou``.

    ``literal`` reads (x1, y1, x2, y2) as (x, y, width, height) when overlap is
    measured.  Groups are streams of rows sorted by group and order; a task holds a
    group's shapes, 32 bytes a box, and the grid of those kept, not its other columns.
    """
    far = (F.col("x1") + F.col("x2"), F.col("y1") + F.col("y2")) if literal else (F.col("x2"), F.col("y2"))
    rest = [c for c in boxes.columns if c not in by and c not in order]
    names = [*by, *order, *rest]
    # Equal rows in one order, so that ties have one result.
    rows = boxes.select(*names, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"{n}__") for n, c in zip(("x1", "y1", "x2", "y2"), (F.col("x1"), F.col("y1"), *far))])
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order, *rest)
    first = len(by)

    def shapes_of(b: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([b.column(len(names) + i).to_numpy(zero_copy_only=False) for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the one group that may go on

        def done() -> Iterator[pa.RecordBatch]:
            keep, at = _suppressed(np.concatenate([shapes_of(h) for h in held]), max_iou), 0
            for h in held:
                yield h.select(range(len(names))).filter(pa.array(keep[at : at + h.num_rows]))
                at += h.num_rows
            held.clear()

        now = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*[b.column(i).to_pylist() for i in range(first)])) if first else [()] * b.num_rows
            starts = [i for i in range(b.num_rows) if i == 0 or keys[i] != keys[i - 1]]
            if held and keys[0] == now:
                own = starts[1] if len(starts) > 1 else b.num_rows
                held.append(b.slice(0, own))
                starts = starts[1:]
            if held and starts:
                yield from done()
            if not starts:
                continue
            # Groups that begin and end in this batch.
            lo, hi = starts[0], starts[-1]
            if hi > lo:
                some = b.slice(lo, hi - lo)
                shapes = shapes_of(some)
                keep = np.ones(len(shapes), bool)
                for s, e in zip(starts, starts[1:]):
                    if e - s > 1 or max_iou < 0:
                        keep[s - lo : e - lo] = (_few if e - s <= FEW_BOXES else _suppressed)(shapes[s - lo : e - lo], max_iou)
                yield some.select(range(len(names))).filter(pa.array(keep))
            held.append(b.slice(hi))
            now = keys[hi]
        if held:
            yield from done()

    return dealt.mapInArrow(run, T.StructType([boxes.schema[c] for c in names])).select(*boxes.columns)


def _steps(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)).cast("int")


def _between(a: Column, b: Column, k: Column, steps: Column) -> Column:
    """Pixel k of a line of one pixel's width, from its first end: one for each step
    along its longer side, nearest to the line."""
    return (a + F.when(steps == 0, 0).otherwise(F.floor((b - a) * k / steps + 0.5))).cast("int")


def drawn(polylines: DataFrame, by: list[str], order: list[str], width: int, height: int, coords: str = "coords", class_col: str = "class_id") -> DataFrame:
    """(by, x, y, class): pixels of closed polylines of interleaved integers, cut to the
    image; where several meet, the last by ``order`` shows.

    Polylines, not pixels, are shuffled: once, by image, where they get their place in
    the order.  Pixels are rows of plain numbers, drawn and taken together in that task,
    which holds its images' pixels or spills them.
    """
    p, i, k = F.col(coords), F.col("i__"), F.col("k__")
    tasks = DRAWING_TASKS * int(polylines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = polylines.filter(F.size(p) >= 2).select(*by, *order, class_col, coords).repartition(tasks, *by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order, class_col))
    rows = rows.select(*by, class_col, coords, place.alias("place__"))
    edges = rows.select("*", F.explode(F.sequence(F.lit(0), F.size(p) - 2, F.lit(2))).alias("i__"))
    corner = lambda at: F.get(p, F.pmod(at, F.size(p))).cast("int")
    edges = edges.select(*by, class_col, "place__", *[corner(i + n).alias(c) for n, c in enumerate(("x1__", "y1__", "x2__", "y2__"))])
    ends = [F.col(c) for c in ("x1__", "y1__", "x2__", "y2__")]
    dots = edges.withColumn("steps__", _steps(*ends)).withColumn("k__", F.explode(F.sequence(F.lit(0), F.col("steps__"))))
    cells = dots.select(*by, class_col, "place__", _between(ends[0], ends[2], k, F.col("steps__")).alias("x"), _between(ends[1], ends[3], k, F.col("steps__")).alias("y"))
    cells = cells.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return cells.groupBy(*by, "x", "y").agg(F.max_by(class_col, "place__").alias(class_col))


def drawn_on(pixels: DataFrame, lines: DataFrame, on: list[str], colors: tuple = LABEL_COLORS, class_col: str = "class_id") -> DataFrame:
    """``pixels`` (on, x, y, r, g, b) with the colours of the classes drawn on them."""
    top = lines.select(*on, "x", "y", F.col(class_col).alias("class__"))
    out = pixels.join(top, [*on, "x", "y"], "left")
    color = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in colors]), (F.pmod(F.col("class__"), F.lit(len(colors))) + 1).cast("int"))
    return out.withColumns({c: F.when(F.col("class__").isNull(), F.col(c)).otherwise(color(i)) for c, i in (("b", 0), ("g", 1), ("r", 2))}).drop("class__")
