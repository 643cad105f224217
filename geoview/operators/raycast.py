"""Nearest hits of rays on a triangle mesh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec3

EPSILON = 1e-9
#: Cells of a grid that a ray's ground track may cross before it goes to a coarser one.
MAX_CELLS = 64
#: Bytes of a mesh that is broadcast, with all copies of its triangles in grids.
MESH_BYTES = 8 << 20
#: Bytes of a triangle in one grid: nine cells at most where it is of mean size.
PLACED_BYTES = 9 * 128
#: Origin and direction of a ray.
RAY = ("ox", "oy", "oz", "dx", "dy", "dz")


def hit_distance(o: Vec3, d: Vec3, a: Vec3, b: Vec3, c: Vec3) -> Column:
    """Distance along the ray to the triangle, or null."""
    return plane_distance(o, d, a, b - a, c - a, (b - a).cross(c - a))


def plane_distance(o: Vec3, d: Vec3, a: Vec3, e1: Vec3, e2: Vec3, n: Vec3) -> Column:
    """As ``hit_distance``, from two edges and their cross product, which belong to
    the triangle alone: barycentric weights follow from s x d with s = o - a."""
    det = -d.dot(n)
    s = o - a
    m = s.cross(d)
    u, v, t = e2.dot(m) / det, -e1.dot(m) / det, s.dot(n) / det
    hit = (F.abs(det) > EPSILON) & (u >= -EPSILON) & (v >= -EPSILON) & (u + v <= 1 + EPSILON) & (t > EPSILON)
    return F.when(hit, t)


def triangles_of(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(tid, ax..cz) from vertices (vid, x, y, z) and faces (tid, a, b, c)."""
    out = faces
    for corner in "abc":
        side = vertices.select(F.col("vid").alias(corner), *[F.col(c).alias(f"{corner}{c}") for c in "xyz"])
        out = out.join(side, corner)
    return out.select("tid", *[f"{k}{c}" for k in "abc" for c in "xyz"])


def _corner(k: str) -> Vec3:
    return Vec3.of(f"{k}x", f"{k}y", f"{k}z")


def raycast(rays: DataFrame, triangles: DataFrame, include_misses: bool = False, keep: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Nearest hit of every ray (ray_id, ox..oz, dx..dz): tid, t, x, y, z.

    The mesh's height range bounds the part of a ray that can hit, and so its
    ground track, a segment.  Rays and triangles meet by the cells of an XY grid, in
    an equi-join: a ray walks its track column by column and takes in each column
    the cells between the heights at which it enters and leaves, so level and oblique
    rays touch as many cells as they cross.  Cell size follows from the mean extent
    of triangles; a track that crosses more than ``MAX_CELLS`` takes a grid twice,
    four times ... as coarse, and triangles stand in every grid.  With ``by``, rays
    meet only triangles of equal ``by`` columns, a mesh for each.

    A mesh that takes at most ``MESH_BYTES`` in all grids is broadcast; then rays are
    shuffled once, by their id.  What is kept of a ray goes along with its hits, of
    which each task keeps the nearest.  Ties at equal distance go to the least
    tid.  One aggregate over the mesh runs at once.
    """
    keep, by = keep or [], by or []
    rays = rays.select("ray_id", *[c for c in by if c not in keep], *keep, *RAY)
    hits = hits_of(rays, triangles, by, deal=["ray_id"])
    own = [c for c in rays.columns if c != "ray_id"]
    hits = hits.select(*rays.columns, F.struct("t", "tid").alias("hit"))
    if include_misses:
        hits = hits.unionByName(rays.withColumn("hit", F.lit(None).cast(hits.schema["hit"].dataType)))
    found = hits.groupBy("ray_id").agg(F.min("hit").alias("hit"), *[F.first(c).alias(c) for c in own])
    return _with_points(found.withColumns({"tid": F.col("hit.tid"), "t": F.col("hit.t")}), keep)


def hits_of(rays: DataFrame, triangles: DataFrame, by: list[str] | None = None, deal: list[str] | None = None) -> DataFrame:
    """Every hit of every ray: the columns of ``rays``, among them RAY and ``by``, with
    tid and t.

    Where the mesh is broadcast, rays are dealt by the ``deal`` columns, or stay in
    their tasks if there are none.
    """
    span = triangles.agg(
        F.min(F.least("az", "bz", "cz")).alias("z0"), F.max(F.greatest("az", "bz", "cz")).alias("z1"),
        F.min(F.least("ax", "bx", "cx")).alias("x0"), F.max(F.greatest("ax", "bx", "cx")).alias("x1"),
        F.min(F.least("ay", "by", "cy")).alias("y0"), F.max(F.greatest("ay", "by", "cy")).alias("y1"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.greatest("ax", "bx", "cx") - F.least("ax", "bx", "cx") + F.greatest("ay", "by", "cy") - F.least("ay", "by", "cy")).alias("extent"),
    ).first()
    by = by or []
    if span["z0"] is None:
        return rays.withColumns({"tid": F.lit(None).cast("long"), "t": F.lit(None).cast("double")}).limit(0)
    cell, levels = grid_of(span)
    boxed = _with_level(_tracks(rays, span, cell), cell, levels)
    spread = {f"{c}{e}": f(f"a{c}", f"b{c}", f"c{c}") for c in "xy" for e, f in (("lo", F.least), ("hi", F.greatest))}
    every = F.explode(F.array(*[F.lit(i) for i in range(levels)]))
    # What belongs to a triangle alone is computed before it meets rays.
    a, e1, e2 = _corner("a"), _corner("b") - _corner("a"), _corner("c") - _corner("a")
    planes = triangles.select(*by, "tid", *[f"{k}{c}" for k in "abc" for c in "xyz"], *e1.columns("e1"), *e2.columns("e2"), *e1.cross(e2).columns("n"))
    size = _size(cell)
    grid = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long")))
    placed = planes.withColumns(spread).withColumn("level", every).withColumn("gx", grid("xlo", "xhi")).withColumn("gy", grid("ylo", "yhi"))
    placed = placed.select(*by, "level", "gx", "gy", "tid", "ax", "ay", "az", *[f"{k}{c}" for k in ("e1", "e2", "n") for c in "xyz"])
    if span["n"] * levels * PLACED_BYTES <= MESH_BYTES:
        placed = F.broadcast(placed)
        if deal:
            # The one shuffle: by ray, as the nearest hits are taken.
            boxed = boxed.repartition(*deal)
    met = walked(boxed, cell).join(placed, [*by, "level", "gx", "gy"])
    t = plane_distance(Vec3.of("ox", "oy", "oz"), Vec3.of("dx", "dy", "dz"), a, _corner("e1"), _corner("e2"), _corner("n"))
    return met.select(*rays.columns, "tid", t.alias("t")).filter(F.col("t").isNotNull())


def grid_of(span) -> tuple[float, int]:
    """Cell size of the finest grid, and how many grids there are: a track across
    the whole mesh crosses ``MAX_CELLS`` of the coarsest at most."""
    cell = max((span["extent"] or 1.0) / 2, 1e-6)
    levels = 1
    while (span["x1"] - span["x0"] + span["y1"] - span["y0"]) / (cell * 2 ** (levels - 1)) > MAX_CELLS - 4 and levels < 40:
        levels += 1
    return cell, levels


def _tracks(rays: DataFrame, span, cell: float) -> DataFrame:
    """``rays`` with their ground track from (tx, ty) to (sx, sy), its box where it
    is over the mesh, and whether it is."""
    # Distances at which the ray crosses the height range; a level ray
    # crosses all of it or none.
    down = F.abs(F.col("dz")) > EPSILON
    t0, t1 = (span["z0"] - F.col("oz")) / F.col("dz"), (span["z1"] - F.col("oz")) / F.col("dz")
    reach = abs(span["x1"] - span["x0"]) + abs(span["y1"] - span["y0"])
    flat = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    # Only the part of a track over the mesh matters.
    away = F.greatest(F.abs(F.col("ox") - span["x0"]), F.abs(F.col("ox") - span["x1"])) + F.greatest(F.abs(F.col("oy") - span["y0"]), F.abs(F.col("oy") - span["y1"])) + reach
    over_all = F.when(flat > 0, away / flat).otherwise(F.lit(0.0))
    near = F.when(down, F.greatest(F.least(t0, t1), F.lit(0.0))).otherwise(F.lit(0.0))
    far = F.when(down, F.greatest(t0, t1)).otherwise(over_all)
    # Distances become columns before boxes use them, which keeps the
    # generated code small.
    out = rays.withColumns({"near__": near, "far__": far})
    out = out.withColumns({f"{p}{c}__": F.col(f"o{c}") + F.col(t) * F.col(f"d{c}") for p, t in (("t", "near__"), ("s", "far__")) for c in "xy"})
    pad = cell * 1e-6
    box = {}
    for c in "xy":
        a, b = F.col(f"t{c}__"), F.col(f"s{c}__")
        box[f"{c}lo__"] = F.greatest(F.least(a, b) - pad, F.lit(span[f"{c}0"] - pad))
        box[f"{c}hi__"] = F.least(F.greatest(a, b) + pad, F.lit(span[f"{c}1"] + pad))
    # A track beside the mesh covers no cells; a filter would be moved below and
    # repeat all that rays are computed from.
    out = out.withColumns(box)
    return out.withColumn("over__", (F.col("xlo__") <= F.col("xhi__")) & (F.col("ylo__") <= F.col("yhi__")) & (F.col("far__") >= 0)).drop("near__", "far__")


def _size(cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))


def _with_level(tracks: DataFrame, cell: float, levels: int) -> DataFrame:
    """The finest grid of which a track crosses ``MAX_CELLS`` cells at most."""
    columns = lambda lo, hi, size: F.floor(F.col(hi) / size) - F.floor(F.col(lo) / size)
    level = F.lit(levels - 1)
    for i in reversed(range(levels)):
        size = cell * 2**i
        level = F.when(columns("xlo__", "xhi__", size) + columns("ylo__", "yhi__", size) + 1 <= MAX_CELLS, F.lit(i)).otherwise(level)
    return tracks.withColumn("level", level)


def walked(tracks: DataFrame, cell: float) -> DataFrame:
    """A row (gx, gy) for each cell that a track crosses, column by column."""
    size, pad = _size(cell), cell * 1e-6
    columns = F.sequence(F.floor(F.col("xlo__") / size).cast("long"), F.floor(F.col("xhi__") / size).cast("long"))
    out = tracks.withColumn("gx", F.explode(F.when(F.col("over__"), columns)))
    run = F.col("sx__") - F.col("tx__")
    steep = F.abs(run) <= pad  # within a column, or on the line between two
    slope = (F.col("sy__") - F.col("ty__")) / run
    at = lambda x: F.col("ty__") + F.col("slope__") * (x - F.col("tx__"))
    out = out.withColumn("slope__", F.when(~steep, slope))
    left, right = F.greatest(F.col("gx") * size, F.col("xlo__")), F.least((F.col("gx") + 1) * size, F.col("xhi__"))
    out = out.withColumns({"enter__": at(left), "leave__": at(right)})
    slack = pad * (1 + F.abs("slope__"))
    low = F.when(F.col("slope__").isNull(), F.col("ylo__")).otherwise(F.greatest(F.col("ylo__"), F.least("enter__", "leave__") - slack))
    high = F.when(F.col("slope__").isNull(), F.col("yhi__")).otherwise(F.least(F.col("yhi__"), F.greatest("enter__", "leave__") + slack))
    out = out.withColumns({"low__": F.floor(low / size).cast("long"), "high__": F.floor(high / size).cast("long")})
    cells = F.when(F.col("low__") <= F.col("high__"), F.sequence("low__", "high__"))
    return out.withColumn("gy", F.explode(cells)).drop("xlo__", "xhi__", "ylo__", "yhi__", "over__", "tx__", "ty__", "sx__", "sy__", "slope__", "enter__", "leave__", "low__", "high__")


def _with_points(rays: DataFrame, keep: list[str]) -> DataFrame:
    return rays.select("ray_id", *keep, "tid", "t", *[(F.col(f"o{c}") + F.col("t") * F.col(f"d{c}")).alias(c) for c in "xyz"])


def interpolate(hits: DataFrame, triangles: DataFrame, values: list[str], keys: tuple[str, ...] = ("ray_id",)) -> DataFrame:
    """Hits (tid, x, y, z) with attributes of the vertices, by barycentric
    weights; attribute ``u`` of the corners is in columns au, bu and cu."""
    met = hits.join(triangles, "tid")
    a, b, c, p = (*[_corner(k) for k in "abc"], Vec3.of("x", "y", "z"))
    e1, e2, at = b - a, c - a, p - a
    met = met.withColumns({"d11__": e1.dot(e1), "d12__": e1.dot(e2), "d22__": e2.dot(e2), "p1__": at.dot(e1), "p2__": at.dot(e2)})
    d11, d12, d22, p1, p2 = (F.col(f"{n}__") for n in ("d11", "d12", "d22", "p1", "p2"))
    det = d11 * d22 - d12 * d12
    met = met.withColumns({"wb__": (d22 * p1 - d12 * p2) / det, "wc__": (d11 * p2 - d12 * p1) / det})
    wb, wc = F.col("wb__"), F.col("wc__")
    mixed = [((1 - wb - wc) * F.col(f"a{v}") + wb * F.col(f"b{v}") + wc * F.col(f"c{v}")).alias(v) for v in values]
    return met.select(*keys, "tid", "x", "y", "z", *mixed)
