"""Frames and animation: strides, positions, growth, focus and sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Aabb
from ..functions.vec import Vec3
from ..shared import written


#: Frames whose growth one task adds up.
RANGE = 1 << 16


def strided(frames: DataFrame, pos: Column, initial_skip: int = 0, skip: int = 1, count: int | None = None) -> DataFrame:
    """Rows initial_skip, initial_skip + skip, ... of the first count + initial_skip."""
    keep = (pos >= initial_skip) & (F.pmod(pos - initial_skip, F.lit(skip)) == 0)
    return frames.filter(keep if count is None else keep & (pos < count + initial_skip))


def aabb_of(points: DataFrame, x: str = "x", y: str = "y", z: str = "z", by: list[str] | None = None) -> DataFrame:
    """Least and greatest coordinates and the centre."""
    ends = points.groupBy(*(by or [])).agg(*[f(c).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a, c in zip("xyz", (x, y, z))])
    box = Aabb(Vec3.of("min_x", "min_y", "min_z"), Vec3.of("max_x", "max_y", "max_z"))
    return ends.select("*", *box.center.columns("center_"))


def camera_positions(shots: DataFrame, order: str, distance: float, background: DataFrame) -> DataFrame:
    """(mode, x, y, z) for the six positioning modes, raised by ``distance``.

    Shots are numbered by one aggregate each, not by a window over all of them:
    the first and last are min_by and max_by, the centre one is found by its
    rank among ``order`` values, which are unique.
    """
    pose = F.struct("x", "y", "z")
    n = F.count(F.lit(1))
    ends = shots.agg(
        F.min_by(pose, order).alias("FirstShot"), F.max_by(pose, order).alias("LastShot"),
        F.struct(*[F.avg(c).alias(c) for c in "xyz"]).alias("AverageShot"),
        F.struct(*[((F.min(c) + F.max(c)) / 2).alias(c) for c in "xyz"]).alias("ShotCentered"),
        n.alias("n"),
    )
    depth = F.floor((F.col("max_z") - F.col("min_z")) / 2)
    ground = background.select(F.struct(F.col("center_x").alias("x"), F.col("center_y").alias("y"), (F.col("center_z") + depth).alias("z")).alias("BackgroundCentered"))
    middle = ranked(shots, order).join(F.broadcast(ends.select("n")), F.col("rank__") == F.floor(F.col("n") / 2)).select(pose.alias("CenterShot"))
    wide = ends.crossJoin(F.broadcast(ground)).crossJoin(F.broadcast(middle))  # one row each
    modes = ("BackgroundCentered", "FirstShot", "CenterShot", "LastShot", "AverageShot", "ShotCentered")
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), *[F.col(m)[c].cast("double").alias(c) for c in "xyz"]) for m in modes])).alias("p"))
    return rows.select("p.mode", "p.x", "p.y", (F.col("p.z") + distance).alias("z"))


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """``rank__`` from 0 in the order of a unique column.

    Rows are dealt out by ranges of the column and written once, with their range
    and place in it; a sum of one number for each range gives the ranks.  Written,
    as the ranges that are counted must be those that rows are in: planned twice, a
    range shuffle may cut them elsewhere.
    """
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("at__", at)
    part, inside = F.shiftrightunsigned("at__", 33), F.col("at__").bitwiseAND((1 << 33) - 1)
    placed = written(placed.withColumns({"part__": part, "inside__": inside}).drop("at__"), "ranked")
    ahead = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"))
    before = sizes.select("part__", F.coalesce(F.sum("n__").over(ahead), F.lit(0)).alias("before__"))  # a row for each range
    return placed.join(F.broadcast(before), "part__").withColumn("rank__", F.col("before__") + F.col("inside__")).drop("part__", "inside__", "before__")


def shutter_plan(spark, shots: int, reference: int, grow: Callable[[Column], Column], symmetrical: bool = False) -> DataFrame:
    """(frame, grown, first, last): frame i integrates shots first..last-1.

    Growth adds up grow(0..i); a frame exists while the growth before it is less
    than shots - reference.  If growth stays at 0 the plan ends after ``shots``
    frames, where a loop would not end.
    """
    # Sums within ranges of frames, and one row for each range before them.
    rows = spark.range(shots if reference < shots else 0).select(F.col("id").alias("frame")).withColumns({"grow__": grow(F.col("frame").cast("int")).cast("long"), "range__": F.expr(f"frame div {RANGE}")})
    within = F.sum("grow__").over(Window.partitionBy("range__").orderBy("frame"))
    ahead = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("range__").agg(F.sum("grow__").alias("n__")).select("range__", F.coalesce(F.sum("n__").over(ahead), F.lit(0)).alias("start__"))
    plan = rows.withColumn("within__", within).join(starts, "range__").withColumn("grown", F.col("start__") + F.col("within__"))
    before = F.col("grown") - F.col("grow__")
    first = F.greatest(F.lit(reference) - F.col("grown"), F.lit(0)) if symmetrical else F.lit(reference).cast("long")
    last = F.least(F.lit(reference) + F.col("grown") + 1, F.lit(shots))
    return plan.filter(before < shots - reference).select("frame", "grown", first.cast("long").alias("first"), last.cast("long").alias("last"))


def focus_plan(spark, start: float, end: float, frames: int) -> DataFrame:
    """(frame, z): from start towards end, which is not reached."""
    return spark.range(frames).select(F.col("id").alias("frame"), (F.lit(start) + F.col("id") * ((end - start) / frames)).alias("z"))


def video_sequence(frames: DataFrame, order: str, first_repeats: int = 0, last_repeats: int = 0) -> DataFrame:
    """Frames in ``order`` with ``n`` rows for each shown frame (out_id gapless).

    The first is shown first_repeats more times and the last last_repeats.
    """
    first_repeats, last_repeats = max(first_repeats, 0), max(last_repeats, 0)
    placed = ranked(frames, order)
    total = placed.agg(F.max("rank__").alias("last__"))
    at = placed.join(F.broadcast(total), F.lit(True))  # one row
    first, last = F.col("rank__") == 0, F.col("rank__") == F.col("last__")
    times = F.lit(1) + F.when(first, first_repeats).otherwise(0) + F.when(last, last_repeats).otherwise(0)
    start = F.col("rank__") + F.when(first, 0).otherwise(first_repeats)
    return at.withColumn("k__", F.explode(F.sequence(F.lit(0), (times - 1).cast("int")))).withColumn("out_id", start + F.col("k__")).drop("rank__", "last__", "k__")


def random_rotations(frames: DataFrame, limit: float, count: int, seed: int) -> DataFrame:
    """Every frame with rotation 0 and ``count`` random ones in [-limit, limit)."""
    drawn = F.array(F.lit(0.0), *[(F.rand(seed + i) if seed >= 0 else F.rand()) * (2 * limit) - limit for i in range(count)])
    return frames.select("*", F.posexplode(drawn).alias("rotation_nr", "rotation"))
