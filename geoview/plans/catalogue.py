"""Queries over the supplied tables, each beside the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LABEL_COLORS
from ..functions import camera as cam
from ..functions.geometry import Aabb, Quad, Tetrahedron, Transform, Triangle, adjacent_angle, degrees_normalized, nearest_int, rounded_down
from ..functions.vec import Quat, Vec3
from ..operators import frames as fr
from ..operators import labels as lb
from ..operators import lookups as lk
from ..operators import pixels as px
from ..operators import raycast as rc
from ..sources import documents as doc
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, and the SQL that it equals."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c: Column, name: str, digits: int = 6) -> Column:
    """Rounded, and without negative zero."""
    return (F.round(c, digits) + 0.0).alias(name)


def rs(e: str, name: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0 AS {name}"


D = "CAST({} AS DOUBLE)".format
PI = "pi()"

# --- labels -----------------------------------------------------------------

CORNERS = f"""(SELECT *, CAST(trunc((xc - w / 2) * 1024) AS INTEGER) AS x1, CAST(trunc((yc - h / 2) * 1024) AS INTEGER) AS y1,
  CAST(trunc((xc + w / 2) * 1024) AS INTEGER) AS x2, CAST(trunc((yc + h / 2) * 1024) AS INTEGER) AS y2 FROM {A.LABELS})"""


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(n) for n in ("xc", "yc", "w", "h")]
    return A.labels(spark, sf_dir).withColumns(lb.yolo_corners(*c, 1024, 1024))


@query(
    f"""WITH p AS (SELECT *, CAST(floor(1024 + (x1 - 512) * 2.0 + 0.5) AS BIGINT) AS px1, CAST(floor(1024 - (y1 - 512) * 2.0 + 0.5) AS BIGINT) AS py1,
  CAST(floor(1024 + (x2 - 512) * 2.0 + 0.5) AS BIGINT) AS px2, CAST(floor(1024 - (y2 - 512) * 2.0 + 0.5) AS BIGINT) AS py2 FROM {CORNERS}),
b AS (SELECT track_id, min(px1) AS x1, min(py2) AS y1, max(px2) AS x2, max(py1) AS y2, arg_min(class_id, frame_id * 1000 + line) AS class_id, count(*) AS boxes FROM p GROUP BY track_id)
SELECT track_id, class_id, boxes, {rs('(x1 + x2) / 2.0 / 2048', 'xc')}, {rs('(y1 + y2) / 2.0 / 2048', 'yc')}, {rs('(x2 - x1) / CAST(2048 AS DOUBLE)', 'w')}, {rs('(y2 - y1) / CAST(2048 AS DOUBLE)', 'h')}
FROM b WHERE NOT (x1 > 2048 OR x2 < 0 OR y1 > 2048 OR y2 < 0)"""
)
def track_enclosing_bbox(spark, sf_dir):
    """Boxes seen from an orthographic camera, then one box for each track."""
    camera = cam.Camera.orthographic(Transform(Vec3.of(512, 512, 100)), 2048 / 2, 2048 / 2)
    at = lambda x, y: camera.world_to_pixel(Vec3(F.col(x).cast("double"), F.col(y).cast("double"), F.lit(0.0)), 2048, 2048, ensure_int=True)
    ax, ay = at("x1", "y1")
    bx, by = at("x2", "y2")
    boxes = _corners(spark, sf_dir).select("track_id", "class_id", "frame_id", "line", ax.alias("x1"), by.alias("y1"), bx.alias("x2"), ay.alias("y2"))
    tracks = lb.track_boxes(boxes, ["track_id"], ["frame_id", "line"])
    c = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    seen = tracks.withColumn("b", lb.box_yolo(*c, 2048, 2048)).filter(F.col("b").isNotNull())
    return seen.select("track_id", "class_id", "boxes", *[r(F.col(f"b.{n}"), n) for n in ("xc", "yc", "w", "h")])


@query(f"SELECT frame_id, line, track_id, x1, y1, x2, y2 FROM {CORNERS}")
def yolo_to_corners(spark, sf_dir):
    return _corners(spark, sf_dir).select("frame_id", "line", "track_id", "x1", "y1", "x2", "y2")


@query(
    f"""WITH s AS (SELECT frame_id, line, track_id, x1 + (frame_id % 5 - 2) * 700 AS x1, y1 + (line % 3 - 1) * 800 AS y1, x2 + (frame_id % 5 - 2) * 700 AS x2, y2 + (line % 3 - 1) * 800 AS y2 FROM {CORNERS})
SELECT frame_id, line, track_id, {rs('(x1 + x2) / 2.0 / 1024', 'xc')}, {rs('(y1 + y2) / 2.0 / 1024', 'yc')}, {rs('(x2 - x1) / CAST(1024 AS DOUBLE)', 'w')}, {rs('(y2 - y1) / CAST(1024 AS DOUBLE)', 'h')}
FROM s WHERE NOT (x1 > 1024 OR x2 < 0 OR y1 > 1024 OR y2 < 0)"""
)
def bbox_to_yolo_visible(spark, sf_dir):
    dx, dy = (F.col("frame_id") % 5 - 2) * 700, (F.col("line") % 3 - 1) * 800
    moved = _corners(spark, sf_dir).withColumns({"x1": F.col("x1") + dx, "y1": F.col("y1") + dy, "x2": F.col("x2") + dx, "y2": F.col("y2") + dy})
    box = lb.box_yolo(*[F.col(n) for n in ("x1", "y1", "x2", "y2")], 1024, 1024)
    seen = moved.withColumn("b", box).filter(F.col("b").isNotNull())
    return seen.select("frame_id", "line", "track_id", *[r(F.col(f"b.{n}"), n) for n in ("xc", "yc", "w", "h")])


ORIGINS = ", ".join(f"('{n}', {D(fx)}, {D(fy)}, {a}, {b})" for n, (fx, fy, a, b) in cam.PIXEL_ORIGINS.items())


@query(
    f"""SELECT frame_id, line, track_id, x1, y1, target, {rs('(x1 - 1023 * fx) * CASE WHEN r THEN 1.0 ELSE -1.0 END', 'x')}, {rs('(y1 - 1023 * fy) * CASE WHEN u THEN -1.0 ELSE 1.0 END', 'y')}
FROM {CORNERS} CROSS JOIN (VALUES {ORIGINS}) o(target, fx, fy, r, u)"""
)
def pixel_origin_all(spark, sf_dir):
    rows = _corners(spark, sf_dir)
    each = []
    for name in cam.PIXEL_ORIGINS:
        x, y = cam.change_pixel_origin(F.col("x1").cast("double"), F.col("y1").cast("double"), 1023.0, 1023.0, "TopLeft", name)
        each.append(F.struct(F.lit(name).alias("target"), r(x, "x"), r(y, "y")))
    return rows.select("frame_id", "line", "track_id", "x1", "y1", F.explode(F.array(*each)).alias("o")).select("frame_id", "line", "track_id", "x1", "y1", "o.*")


@query(
    f"""WITH p AS (SELECT frame_id, line, track_id, x1, y1, x2, y2 FROM {CORNERS})
SELECT frame_id, line, track_id, least(x1, x2) AS bx1, least(y1, y2) AS by1, greatest(x1, x2) AS bx2, greatest(y1, y2) AS by2, 8 AS n FROM p"""
)
def polyline_bbox(spark, sf_dir):
    """A closed ring, without its closing vertex, and its enclosing box."""
    rows = _corners(spark, sf_dir)
    ring = F.concat(lb.quad_of(*[F.col(n) for n in ("x1", "y1", "x2", "y2")]), F.array("x1", "y1"))
    rows = rows.withColumn("ring", lb.without_closing_vertex(ring))
    return rows.select("frame_id", "line", "track_id", *[c.alias(f"b{n}") for n, c in lb.polyline_box(F.col("ring")).items()], F.size("ring").alias("n"))


# --- lookups ----------------------------------------------------------------


def _corrected(frames: DataFrame, corrections: DataFrame, central: str | None = None) -> DataFrame:
    out = lk.interval_lookup(frames, corrections, {"pos": 0, "tz": 0.0}, central_col=central)
    return out.select("frame_id", "pos", r(F.col("tz"), "tz"))


@query(
    f"""SELECT frame_id, coalesce(pos, 0) AS pos, {rs('coalesce(tz, 0)', 'tz')} FROM (
  SELECT f.frame_id, c.pos, c.tz, row_number() OVER (PARTITION BY f.frame_id ORDER BY c.pos) AS n
  FROM {A.FRAMES} f LEFT JOIN {A.CORRECTIONS} c ON f.frame_id BETWEEN c.lo AND c.hi) WHERE n = 1"""
)
def frame_correction_lookup(spark, sf_dir):
    return _corrected(A.frames(spark, sf_dir).select("frame_id"), A.corrections(spark, sf_dir))


@query(
    f"""WITH f AS (SELECT frame_id, frame_id + 125 AS central FROM {A.FRAMES}),
own AS (SELECT f.frame_id, min(c.pos) AS pos FROM f JOIN {A.CORRECTIONS} c ON f.frame_id BETWEEN c.lo AND c.hi GROUP BY f.frame_id),
mid AS (SELECT f.frame_id, max(c.pos) AS pos FROM f JOIN {A.CORRECTIONS} c ON f.central BETWEEN c.lo AND c.hi GROUP BY f.frame_id)
SELECT f.frame_id, coalesce(own.pos, mid.pos, 0) AS pos, {rs('coalesce(c.tz, 0)', 'tz')}
FROM f LEFT JOIN own USING (frame_id) LEFT JOIN mid USING (frame_id) LEFT JOIN {A.CORRECTIONS} c ON c.pos = coalesce(own.pos, mid.pos)"""
)
def frame_correction_central_fallback(spark, sf_dir):
    frames = A.frames(spark, sf_dir).select("frame_id", (F.col("frame_id") + 125).alias("central"))
    return _corrected(frames, A.corrections(spark, sf_dir), "central")


WINDOW = f"""(SELECT f.flight_id, f.frame_id, n.frame_id AS neighbour_id, CASE WHEN n.frame_id < f.frame_id THEN 1 ELSE 2 END AS phase
  FROM {A.FRAMES} f JOIN {A.FRAMES} n ON f.flight_id = n.flight_id AND n.frame_id <> f.frame_id AND n.frame_id BETWEEN f.frame_id - 200 AND f.frame_id + 200
  AND abs(f.frame_id - n.frame_id) % 5 = 0)"""


@query(f"SELECT * FROM {WINDOW}")
def neighbour_window(spark, sf_dir):
    return lk.neighbours(A.frames(spark, sf_dir).select("flight_id", "frame_id"), 200, 200, 5)


@query(f"SELECT flight_id, frame_id, count(*) FILTER (phase = 1) AS before, count(*) FILTER (phase = 2) AS after FROM {WINDOW} GROUP BY flight_id, frame_id")
def neighbour_counts(spark, sf_dir):
    near = lk.neighbours(A.frames(spark, sf_dir).select("flight_id", "frame_id"), 200, 200, 5)
    return near.groupBy("flight_id", "frame_id").agg(F.count_if(F.col("phase") == 1).alias("before"), F.count_if(F.col("phase") == 2).alias("after"))


@query(
    f"""WITH w AS (SELECT frame_id, neighbour_id, phase FROM {WINDOW} UNION ALL SELECT frame_id, frame_id, 0 FROM {A.FRAMES})
SELECT w.frame_id, l.track_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, arg_min(class_id, (phase * 1000000000 + l.frame_id) * 1000 + line) AS class_id, count(*) AS boxes
FROM w JOIN {CORNERS} l ON l.frame_id = w.neighbour_id GROUP BY w.frame_id, l.track_id"""
)
def merged_track_bbox(spark, sf_dir):
    frames = A.frames(spark, sf_dir).select("flight_id", "frame_id")
    near = lk.neighbours(frames, 200, 200, 5).select("frame_id", "neighbour_id", "phase")
    own = frames.select("frame_id", F.col("frame_id").alias("neighbour_id"), F.lit(0).alias("phase"))
    return lb.merged_tracks(near.unionByName(own), _corners(spark, sf_dir), ties=["line"])


@query(f"SELECT e.event_id AS k, t.k AS floor_key, {rs('t.value', 'value')} FROM events e ASOF LEFT JOIN (SELECT event_id * 10 AS k, value FROM events) t ON e.event_id >= t.k")
def floor_lookup(spark, sf_dir):
    probes = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("k"))
    out = lk.floor_lookup(probes, A.keys(spark, sf_dir), "k", ["value"])
    return out.select("k", "floor_key", r(F.col("value"), "value"))


@query(
    f"""SELECT frame_id, line, track_id, CASE WHEN n_nationkey IS NOT NULL THEN n_name ELSE CAST(k AS VARCHAR) END AS name
FROM (SELECT *, CAST(track_id % 40 AS INTEGER) AS k FROM {A.LABELS}) LEFT JOIN nation ON k = n_nationkey"""
)
def echo_lookup(spark, sf_dir):
    rows = A.labels(spark, sf_dir).select("frame_id", "line", "track_id", (F.col("track_id") % 40).cast("int").alias("n_nationkey"))
    return lk.echo_lookup(rows, A.table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "name", small=True).drop("n_nationkey")


PALETTE = ["{}-{}-{}".format(*c) for c in LABEL_COLORS]


@query(f"SELECT frame_id, line, track_id, ({PALETTE!r})[CAST(((class_id - 4) % 6 + 6) % 6 + 1 AS INTEGER)] AS color FROM {A.LABELS}")
def cyclic_color(spark, sf_dir):
    return A.labels(spark, sf_dir).select("frame_id", "line", "track_id", lk.cyclic(PALETTE, F.col("class_id") - 4).alias("color"))


@query(f"SELECT frame_id FROM {A.FRAMES} f WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = f.frame_id AND o_orderkey % 2 = 0)")
def resume_anti(spark, sf_dir):
    done = A.table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == 0).select(F.col("o_orderkey").alias("frame_id"))
    return lk.pending(A.frames(spark, sf_dir).select("frame_id"), done, ["frame_id"])


@query(f"SELECT frame_id FROM {A.FRAMES} f WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = f.frame_id AND o_orderkey % 2 = 0)")
def exists_semi(spark, sf_dir):
    done = A.table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == 0).select(F.col("o_orderkey").alias("frame_id"))
    return lk.existing(A.frames(spark, sf_dir).select("frame_id"), done, ["frame_id"])


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'a' END, CASE WHEN event_id % 2 = 0 THEN 'b' END, 'none') AS by_value, CASE WHEN event_id % 3 = 0 THEN 'a' WHEN event_id % 2 = 0 THEN 'b' ELSE NULL END AS by_key FROM events")
def first_valid_key(spark, sf_dir):
    """Aliases by value, and by presence where the first key is always there."""
    i = F.col("event_id")
    by_value = F.create_map(F.lit("file"), F.when(i % 3 == 0, "a"), F.lit("image"), F.when(i % 2 == 0, "b"))
    by_key = F.when(i % 3 == 0, F.create_map(F.lit("file"), F.lit("a"))).otherwise(F.create_map(F.lit("image"), F.when(i % 2 == 0, "b")))
    keys = ["file", "image"]
    return A.table(spark, sf_dir, "events").select(i, lk.first_valid(by_value, keys, F.lit("none")).alias("by_value"), lk.first_valid(by_key, keys, F.lit("none"), present=True).alias("by_key"))


@query(
    f"""SELECT l.frame_id, l.line, l.track_id, c.class_id FROM {A.LABELS} l JOIN (SELECT n_regionkey AS k, max(n_nationkey) AS class_id FROM nation GROUP BY n_regionkey) c ON l.class_id = c.k"""
)
def label_class_mapping(spark, sf_dir):
    """id -> label inverted, where the last id of a label holds; labels without
    an id are rejected."""
    ids = A.table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("order"), F.col("n_nationkey").cast("string").alias("k"), F.col("n_regionkey").cast("string").alias("v")))).alias("all"))
    export = ids.select(F.struct(F.map_from_entries(F.transform("all", lambda e: F.struct(e["k"], e["v"]))).alias("labels")).alias("metadata"))
    last = doc.label_ids(export)
    rows = A.labels(spark, sf_dir).select("frame_id", "line", "track_id", F.col("class_id").cast("string").alias("label"))
    known, _ = lk.with_class_ids(rows, last)
    return known.select("frame_id", "line", "track_id", "class_id")


# --- frames -----------------------------------------------------------------


@query(f"SELECT {', '.join(rs(f'{f}({c})', f'{n}_{c}') for n, f in (('min', 'min'), ('max', 'max')) for c in 'xyz')}, {', '.join(rs(f'(min({c}) + max({c})) / 2', f'center_{c}') for c in 'xyz')} FROM {A.VERTICES}")
def mesh_aabb_center(spark, sf_dir):
    box = fr.aabb_of(A.vertices(spark, sf_dir))
    return box.select(*[r(F.col(c), c) for c in box.columns])


@query(
    f"""WITH f AS (SELECT *, row_number() OVER (ORDER BY frame_id) - 1 AS n, count(*) OVER () AS total FROM {A.FRAMES}),
g AS (SELECT (min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y, (min(z) + max(z)) / 2 + floor((max(z) - min(z)) / 2) AS z FROM {A.VERTICES}),
p AS (SELECT 'BackgroundCentered' AS mode, x, y, z FROM g
  UNION ALL SELECT 'FirstShot', cam_x, cam_y, cam_z FROM f WHERE n = 0
  UNION ALL SELECT 'CenterShot', cam_x, cam_y, cam_z FROM f WHERE n = total // 2
  UNION ALL SELECT 'LastShot', cam_x, cam_y, cam_z FROM f WHERE n = total - 1
  UNION ALL SELECT 'AverageShot', avg(cam_x), avg(cam_y), avg(cam_z) FROM f
  UNION ALL SELECT 'ShotCentered', (min(cam_x) + max(cam_x)) / 2, (min(cam_y) + max(cam_y)) / 2, (min(cam_z) + max(cam_z)) / 2 FROM f)
SELECT mode, {rs('x', 'x')}, {rs('y', 'y')}, {rs('z + 10', 'z')} FROM p"""
)
def camera_positions(spark, sf_dir):
    shots = A.frames(spark, sf_dir).select("frame_id", *[F.col(f"cam_{c}").alias(c) for c in "xyz"])
    out = fr.camera_positions(shots, "frame_id", 10.0, fr.aabb_of(A.vertices(spark, sf_dir)))
    return out.select("mode", *[r(F.col(c), c) for c in "xyz"])


@query(f"SELECT frame_id, flight_id FROM {A.FRAMES} WHERE frame_id >= 7 AND frame_id < 707 AND (frame_id - 7) % 3 = 0")
def shot_stride(spark, sf_dir):
    return fr.strided(A.frames(spark, sf_dir).select("frame_id", "flight_id"), F.col("frame_id"), 7, 3, 700)


@query(
    """WITH g AS (SELECT i, sum(i + 1) OVER (ORDER BY i) AS grown FROM range((SELECT count(*) FROM part) - 100) t(i)), n AS (SELECT count(*) AS n FROM part)
SELECT i AS frame, CAST(grown AS BIGINT) AS grown, CAST(100 AS BIGINT) AS first, CAST(least(100 + grown + 1, n) AS BIGINT) AS last, CAST(least(100 + grown + 1, n) - 100 AS BIGINT) AS shots
FROM g, n WHERE grown - (i + 1) < n - 100"""
)
def shutter_growth(spark, sf_dir):
    shots = A.sequence(spark, sf_dir).count()
    plan = fr.shutter_plan(spark, shots, 100, lambda i: i + 1)
    return plan.select("frame", "grown", "first", "last", (F.col("last") - F.col("first")).alias("shots"))


@query(
    f"""SELECT p_partkey AS shot, i AS frame, {rs('p_size - (1.5 + i * (9.0 - 1.5) / 12)', 'z')} FROM part, range(12) t(i)"""
)
def focus_ramp(spark, sf_dir):
    """Every shot at every frame's focus, against which the camera moves."""
    plan = fr.focus_plan(spark, 1.5, 9.0, 12).agg(F.array_sort(F.collect_list(F.struct("frame", "z"))).alias("plan"))
    rows = A.sequence(spark, sf_dir).crossJoin(F.broadcast(plan)).select("shot", "size", F.explode("plan").alias("f"))  # one row of plan
    return rows.select("shot", "f.frame", r(F.col("size") - F.col("f.z"), "z"))


@query(
    """WITH s AS (SELECT p_partkey AS shot, row_number() OVER (ORDER BY p_partkey) - 1 AS n, count(*) OVER () AS total FROM part)
SELECT shot, n + CASE WHEN n = 0 THEN 0 ELSE 4 END + k AS out_id FROM s, range(6) t(k) WHERE k <= CASE WHEN n = 0 THEN 4 ELSE 0 END + CASE WHEN n = total - 1 THEN 2 ELSE 0 END"""
)
def video_sequence(spark, sf_dir):
    return fr.video_sequence(A.sequence(spark, sf_dir).select("shot"), "shot", 4, 2).select("shot", "out_id")


@query()
def random_rotation(spark, sf_dir):
    return fr.random_rotations(A.frames(spark, sf_dir).select("frame_id"), 0.5, 3, seed=11)


# --- cameras ----------------------------------------------------------------


def _frame_camera(ortho: bool = False) -> cam.Camera:
    """A frame's camera, which looks down and is turned about z."""
    pose = Transform(Vec3.of("cam_x", "cam_y", "cam_z"), Quat.about("z", degrees_normalized(F.col("rot_z_deg"))))
    return cam.Camera.orthographic(pose, 70.0, 70.0) if ortho else cam.Camera.perspective(pose, "fovy", 1.0)


def _point(away: int = 1) -> Vec3:
    """A world point near the frame's footprint, ``away`` times as far off."""
    dx, dy = F.col("frame_id") % 31 - 15.0, F.col("frame_id") % 37 - 18.0
    return Vec3(F.col("cam_x") + dx * away, F.col("cam_y") + dy * away, F.col("frame_id") % 7 * 1.0)


#: That point in camera space.
IN_CAMERA = f"""(SELECT *, cos(a) * dx + sin(a) * dy AS ux, -sin(a) * dx + cos(a) * dy AS uy, dz AS uz FROM (SELECT *, radians(rot_z_deg) AS a,
  CAST(frame_id % 31 - 15 AS DOUBLE) AS dx, CAST(frame_id % 37 - 18 AS DOUBLE) AS dy, frame_id % 7 - cam_z AS dz FROM {A.FRAMES}))"""


@query(f"SELECT frame_id, {rs('1024 + ux * 2048 / 70', 'px')}, {rs('1024 - uy * 2048 / 70', 'py')} FROM {IN_CAMERA}")
def world_to_pixel_ortho(spark, sf_dir):
    x, y = _frame_camera(True).world_to_pixel(_point(), 2048, 2048)
    return A.frames(spark, sf_dir).select("frame_id", r(x, "px"), r(y, "py"))


PERSPECTIVE = f"(SELECT *, (ux / -uz / tan(radians(fovy) / 2) + 1) / 2 * 2048 AS px, (1 - uy / -uz / tan(radians(fovy) / 2)) / 2 * 2048 AS py FROM {IN_CAMERA})"


@query(f"SELECT frame_id, {rs('px', 'px')}, {rs('py', 'py')}, CAST(floor(round(px, 6) + 0.5) AS BIGINT) AS ix, CAST(floor(round(py, 6) + 0.5) AS BIGINT) AS iy FROM {PERSPECTIVE}")
def world_to_pixel_persp(spark, sf_dir):
    x, y = _frame_camera().world_to_pixel(_point(), 2048, 2048)
    return A.frames(spark, sf_dir).select("frame_id", r(x, "px"), r(y, "py"), rounded_down(F.round(x, 6)).alias("ix"), rounded_down(F.round(y, 6)).alias("iy"))


@query(
    f"""WITH q AS (SELECT frame_id, uz, (ux / -uz / tan(radians(fovy) / 2) * 8 + 1) / 2 * 2048 AS px, (1 - uy / -uz / tan(radians(fovy) / 2) * 8) / 2 * 2048 AS py FROM {IN_CAMERA})
SELECT frame_id, CASE WHEN ok THEN {rs('px', 'px').removesuffix(' AS px')} END AS px, CASE WHEN ok THEN {rs('py', 'py').removesuffix(' AS py')} END AS py FROM (SELECT *, uz < 0 AND px >= 0 AND px < 2048 AND py >= 0 AND py < 2048 AS ok FROM q)"""
)
def world_to_pixel_clip(spark, sf_dir):
    """Points eight times as far from the axis, of which many are outside."""
    x, y = _frame_camera().visible_pixel(_point(8), 2048, 2048)
    return A.frames(spark, sf_dir).select("frame_id", r(x, "px"), r(y, "py"))


@query(f"SELECT frame_id, abs(ux * 4 / tan(radians(fovy) / 2)) <= -uz AND abs(uy * 4 / tan(radians(fovy) / 2)) <= -uz AND abs((-uz * (10000 + 0.1) - 2 * 10000 * 0.1) / (10000 - 0.1)) <= -uz AS captured FROM {IN_CAMERA}")
def frustum_captures(spark, sf_dir):
    return A.frames(spark, sf_dir).select("frame_id", _frame_camera().captures(_point(4)).alias("captured"))


@query(f"SELECT frame_id, {rs('cos(a / 2)', 'qw', 9)}, {rs('CAST(0 AS DOUBLE)', 'qx', 9)}, {rs('CAST(0 AS DOUBLE)', 'qy', 9)}, {rs('sin(a / 2)', 'qz', 9)}, {rs('-sin(a)', 'ux', 9)}, {rs('cos(a)', 'uy', 9)} FROM {IN_CAMERA}")
def quaternion_eulers(spark, sf_dir):
    q = Quat.from_eulers(Vec3(F.lit(0.0), F.lit(0.0), degrees_normalized(F.col("rot_z_deg"))), "zyx")
    up = q.rotate(Vec3.of(0, 1, 0))
    return A.frames(spark, sf_dir).select("frame_id", r(q.w, "qw", 9), r(q.x, "qx", 9), r(q.y, "qy", 9), r(q.z, "qz", 9), r(up.x, "ux", 9), r(up.y, "uy", 9))


EULERS = f"(SELECT *, radians(rot_z_deg) AS c, radians(cam_x % 90) AS a, radians(cam_y % 90) AS b FROM {A.FRAMES})"


@query(
    f"""SELECT frame_id, {rs('cos(a) * sin(b) * cos(c) + sin(a) * sin(c)', 'bx', 9)}, {rs('cos(a) * sin(b) * sin(c) - sin(a) * cos(c)', 'by', 9)}, {rs('cos(a) * cos(b)', 'bz', 9)} FROM {EULERS}"""
)
def transform_directions(spark, sf_dir):
    """The back direction of a pose turned about x, then y, then z."""
    e = Vec3(F.radians(F.col("cam_x") % 90), F.radians(F.col("cam_y") % 90), degrees_normalized(F.col("rot_z_deg")))
    back = Transform(Vec3.of("cam_x", "cam_y", "cam_z"), Quat.from_eulers(e, "zyx")).direction("back")
    return A.frames(spark, sf_dir).select("frame_id", r(back.x, "bx", 9), r(back.y, "by", 9), r(back.z, "bz", 9))


@query(f"SELECT frame_id, {rs('asin(0.5 * sin(radians(rot_z_deg / 4)) / 2)', 'angle', 9)} FROM {A.FRAMES}")
def adjacent_angles(spark, sf_dir):
    return A.frames(spark, sf_dir).select("frame_id", r(adjacent_angle(F.radians(F.col("rot_z_deg") / 4), 0.5, 2.0), "angle", 9))


@query(f"SELECT frame_id, CAST(trunc((frame_id % 100 - 50) * 0.13 + 0.5) AS BIGINT) AS nearest, CAST(floor((frame_id % 100 - 50) * 0.13 + 0.5) AS BIGINT) AS floored FROM {A.FRAMES}")
def integer_rounding(spark, sf_dir):
    v = (F.col("frame_id") % 100 - 50) * 0.13
    return A.frames(spark, sf_dir).select("frame_id", nearest_int(v).alias("nearest"), rounded_down(v).alias("floored"))


def _undistort_sql(steps: int, x: str = "frame_id % 41 / 41.0 - 0.5", y: str = "frame_id % 43 / 43.0 - 0.5") -> str:
    at = f"(SELECT frame_id, {x} AS x0, {y} AS y0, {x} AS u, {y} AS v FROM {A.FRAMES})"
    for _ in range(steps):
        at = f"""(SELECT frame_id, x0, y0, (x0 - (2 * 0.001 * u * v + -0.002 * (r2 + 2 * u * u))) / (1 + r2 * (-0.1 + r2 * (0.01 + r2 * 0.001))) AS u,
  (y0 - (0.001 * (r2 + 2 * v * v) + 2 * -0.002 * u * v)) / (1 + r2 * (-0.1 + r2 * (0.01 + r2 * 0.001))) AS v FROM (SELECT *, CAST(u AS DOUBLE) * u + CAST(v AS DOUBLE) * v AS r2 FROM {at}))"""
    return at


@query(f"SELECT frame_id, {rs('u', 'u', 9)}, {rs('v', 'v', 9)} FROM {_undistort_sql(5)}")
def undistorted_coords(spark, sf_dir):
    x, y = F.col("frame_id") % 41 / 41.0 - 0.5, F.col("frame_id") % 43 / 43.0 - 0.5
    u, v = cam.undistorted(x, y, Vec3.of(-0.1, 0.01, 0.001), 0.001, -0.002)
    return A.frames(spark, sf_dir).select("frame_id", r(u, "u", 9), r(v, "v", 9))


@query(
    f"""WITH k AS (SELECT radians(fovy / 2) AS h, * FROM {A.FRAMES}), d AS (SELECT *, -sin(h) / sqrt(2 * sin(h) * sin(h) + cos(h) * cos(h)) * 20 AS lx, sin(h) / sqrt(2 * sin(h) * sin(h) + cos(h) * cos(h)) * 20 AS ty, -cos(h) / sqrt(2 * sin(h) * sin(h) + cos(h) * cos(h)) * 20 AS z FROM k)
SELECT frame_id, corner, {rs('cam_x + sx * lx', 'x')}, {rs('cam_y + sy * ty', 'y')}, {rs('cam_z + z', 'z')} FROM d, (VALUES ('bl', -1, -1), ('tl', -1, 1), ('br', 1, -1), ('tr', 1, 1)) c(corner, sx, sy)"""
)
def frustum_corners(spark, sf_dir):
    c = cam.Camera.perspective(Transform(Vec3.of("cam_x", "cam_y", "cam_z")), "fovy")
    each = [F.struct(F.lit(n).alias("corner"), *p.columns(digits=6)) for n, p in zip(("bl", "tl", "br", "tr"), c.corners_at(20.0))]
    rows = A.frames(spark, sf_dir).select("frame_id", F.explode(F.array(*each)).alias("c"))
    return rows.select("frame_id", "c.corner", *[r(F.col(f"c.{n}"), n) for n in "xyz"])


@query(f"SELECT frame_id, {rs('cam_x', 'x')}, {rs('rot_z_deg', 'turn')}, 'v = (' || printf('%.1f', cam_x) || ', ' || printf('%.1f', cam_y) || ', ' || printf('%.1f', cam_z) || ')' AS shown FROM {A.FRAMES}")
def camera_json_roundtrip(spark, sf_dir):
    """Cameras as JSON and back, and their position as text."""
    c = _frame_camera()
    rows = A.frames(spark, sf_dir).select("frame_id", cam.camera_to_json(c).alias("json"), c.transform.position.geogebra("v", 1).alias("shown"))
    back = rows.select("frame_id", cam.camera_from_json("json").alias("c"), "shown")
    turn = F.degrees(2 * F.atan2(F.get("c.frustum.transform.rotation", F.lit(2)), F.get("c.frustum.transform.rotation", F.lit(3))))
    return back.select("frame_id", r(F.get("c.frustum.transform.position", F.lit(0)), "x"), r(turn, "turn"), "shown")


@query(
    f"""WITH c AS (SELECT frame_id, fovy, 0.8 * ux - 0.6 * uy - 1 AS x, 0.6 * ux + 0.8 * uy - 2 AS y, uz - 3 AS z FROM {IN_CAMERA})
SELECT frame_id, {rs('x / -z / tan(radians(fovy) / 2) / 2 + 0.5', 'u')}, {rs('y / -z / tan(radians(fovy) / 2) / 2 + 0.5', 'v')} FROM c"""
)
def corrected_projection(spark, sf_dir):
    """Texture coordinates by P * C * V, with a correction in camera space."""
    m = cam.corrected_matrix(_frame_camera(), Vec3.of(1, 2, 3), Quat(0.0, 0.0, 0.1**0.5, 0.9**0.5))
    x, y, _, w = m.apply(_point())
    return A.frames(spark, sf_dir).select("frame_id", r(x / w / 2 + 0.5, "u"), r(y / w / 2 + 0.5, "v"))


# --- mesh -------------------------------------------------------------------


def _triangles(spark, sf_dir) -> DataFrame:
    return rc.triangles_of(A.vertices(spark, sf_dir), A.faces(spark, sf_dir))


def _abc() -> tuple[Vec3, Vec3, Vec3]:
    return tuple(Vec3.of(f"{k}x", f"{k}y", f"{k}z") for k in "abc")


NORMAL = f"""(SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM (
  SELECT *, bx - ax AS ux, by_ - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz FROM {A.TRIANGLES}))"""
_LEN = "sqrt(nx * nx + ny * ny + nz * nz)"


@query(f"SELECT tid, {rs(f'nx / {_LEN}', 'nx', 9)}, {rs(f'ny / {_LEN}', 'ny', 9)}, {rs(f'nz / {_LEN}', 'nz', 9)} FROM {NORMAL}")
def triangle_normals(spark, sf_dir):
    n = Triangle(*_abc()).normal
    return _triangles(spark, sf_dir).select("tid", r(n.x, "nx", 9), r(n.y, "ny", 9), r(n.z, "nz", 9))


@query(f"SELECT tid, {rs('((ax - bx) * (ey * fz - ez * fy) + (ay - by_) * (ez * fx - ex * fz) + (az - bz) * (ex * fy - ey * fx)) / 6', 'volume')} FROM (SELECT *, bx - 10 AS ex, by_ - 20 AS ey, bz - 30 AS ez, cx - 10 AS fx, cy - 20 AS fy, cz - 30 AS fz FROM {A.TRIANGLES})")
def tetra_volume(spark, sf_dir):
    return _triangles(spark, sf_dir).select("tid", r(Tetrahedron(*_abc(), Vec3.of(10, 20, 30)).volume, "volume"))


@query(f"SELECT tid, {', '.join(rs(f'(ax * bx + ay * by_ + az * bz) / (bx * bx + by_ * by_ + bz * bz) * {c}', f'p{n}', 9) for c, n in (('bx', 'x'), ('by_', 'y'), ('bz', 'z')))} FROM {A.TRIANGLES} WHERE bx * bx + by_ * by_ + bz * bz > 0")
def vector_project(spark, sf_dir):
    a, b, _ = _abc()
    p = a.project_onto(b)
    return _triangles(spark, sf_dir).filter(b.dot(b) > 0).select("tid", r(p.x, "px", 9), r(p.y, "py", 9), r(p.z, "pz", 9))


@query(f"SELECT tid, {rs('(ax + bx + cx + ax) / 4', 'cx')}, {rs('(ay + by_ + cy + ay) / 4', 'cy')}, true AS flat, {rs('greatest(ax, bx, cx) - least(ax, bx, cx)', 'width')} FROM {A.TRIANGLES}")
def quad_measures(spark, sf_dir):
    a, b, c = _abc()
    q = Quad(a, b, c, a)
    box = Aabb(Vec3(F.least(a.x, b.x, c.x), F.least(a.y, b.y, c.y), F.least(a.z, b.z, c.z)), Vec3(F.greatest(a.x, b.x, c.x), F.greatest(a.y, b.y, c.y), F.greatest(a.z, b.z, c.z)))
    return _triangles(spark, sf_dir).select("tid", r(q.center.x, "cx"), r(q.center.y, "cy"), q.flat().alias("flat"), r(box.size.x, "width"))


def _hits_sql(tilt: float, join: str, digits: int = 6, rays: str | None = None) -> str:
    return f"""WITH rays AS {rays or A.rays_sql(tilt)}, tri AS (SELECT *, bx - ax AS ux, by_ - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz FROM {A.TRIANGLES}),
m AS (SELECT ray_id, tid, ux, uy, uz, vx, vy, vz, ox, oy, oz, dx, dy, dz, dy * vz - dz * vy AS px, dz * vx - dx * vz AS py, dx * vy - dy * vx AS pz, ox - ax AS sx, oy - ay AS sy, oz - az AS sz FROM rays, tri),
k AS (SELECT *, ux * px + uy * py + uz * pz AS det, sy * uz - sz * uy AS qx, sz * ux - sx * uz AS qy, sx * uy - sy * ux AS qz FROM m),
h AS (SELECT ray_id, tid, (vx * qx + vy * qy + vz * qz) / det AS t, (sx * px + sy * py + sz * pz) / det AS u, (dx * qx + dy * qy + dz * qz) / det AS v FROM k WHERE abs(det) > 1e-9),
n AS (SELECT ray_id, tid, t FROM (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY round(t, 9), tid) AS i FROM h WHERE u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9 AND t > 1e-9) WHERE i = 1)
SELECT rays.ray_id, {rs('t', 't', digits)}, {rs('ox + t * dx', 'x', digits)}, {rs('oy + t * dy', 'y', digits)}, {rs('oz + t * dz', 'z', digits)} FROM rays {join} JOIN n USING (ray_id)"""


def _hits(spark, sf_dir, tilt: float, misses: bool) -> DataFrame:
    out = rc.raycast(A.rays(spark, sf_dir, tilt), _triangles(spark, sf_dir), misses)
    return out.select("ray_id", *[r(F.col(c), c) for c in ("t", "x", "y", "z")])


@query(_hits_sql(1.0, ""))
def raycast_nearest(spark, sf_dir):
    return _hits(spark, sf_dir, 1.0, False)


@query(_hits_sql(4.0, "LEFT"))
def raycast_with_misses(spark, sf_dir):
    return _hits(spark, sf_dir, 4.0, True)


@query(
    f"""SELECT ray_id, {rs('x / 400', 'u')}, {rs('y / 400', 'v')}, CAST(floor(round(x / 50, 6)) + floor(round(y / 50, 6)) AS BIGINT) % 2 = 0 AS lit FROM ({_hits_sql(1.0, '', 12)})"""
)
def surface_texture(spark, sf_dir):
    """The colour of a checkerboard on the mesh where rays hit it first."""
    mesh = _triangles(spark, sf_dir)
    mesh = mesh.withColumns({f"{k}{n}": F.col(f"{k}{c}") / 400 for k in "abc" for n, c in (("u", "x"), ("v", "y"))})
    hits = rc.raycast(A.rays(spark, sf_dir), mesh)
    seen = rc.interpolate(hits, mesh, ["u", "v"])
    tile = F.floor(F.round(F.col("u") * 8, 6)) + F.floor(F.round(F.col("v") * 8, 6))
    return seen.select("ray_id", r(F.col("u"), "u"), r(F.col("v"), "v"), (tile % 2 == 0).alias("lit"))


#: Rays through a pixel of every frame.
PIXEL_RAYS = f"""(SELECT frame_id AS ray_id, cam_x AS ox, cam_y AS oy, cam_z AS oz, cos(a) * ux - sin(a) * uy AS dx, sin(a) * ux + cos(a) * uy AS dy, CAST(-1 AS DOUBLE) AS dz FROM (
  SELECT *, radians(rot_z_deg) AS a, (frame_id % 1024 / 512.0 - 1) * tan(radians(fovy) / 2) AS ux, (1 - frame_id * 3 % 1024 / 512.0) * tan(radians(fovy) / 2) AS uy FROM {A.FRAMES}))"""


@query(f"SELECT ray_id AS frame_id, CAST(ray_id % 1024 AS DOUBLE) AS px, CAST(ray_id * 3 % 1024 AS DOUBLE) AS py FROM ({_hits_sql(1.0, '', rays=PIXEL_RAYS)})")
def pixel_world_roundtrip(spark, sf_dir):
    """Pixels cast on the mesh and projected back, which come out as they were, of
    every frame whose ray hits the mesh."""
    c = _frame_camera()
    o, d = c.ray((F.col("frame_id") % 1024).cast("double"), (F.col("frame_id") * 3 % 1024).cast("double"), 1024, 1024)
    pose = ["frame_id", "cam_x", "cam_y", "cam_z", "rot_z_deg", "fovy"]
    rays = A.frames(spark, sf_dir).select(F.col("frame_id").alias("ray_id"), *pose, *o.columns("o"), *d.columns("d"))
    hits = rc.raycast(rays, _triangles(spark, sf_dir), keep=pose)
    x, y = c.world_to_pixel(Vec3.of("x", "y", "z"), 1024, 1024)
    return hits.select("frame_id", r(x, "px", 3), r(y, "py", 3))


# --- pixels -----------------------------------------------------------------


@query(f"SELECT grp, x, y, {rs('sum(v) / greatest(sum(a), 1)', 'v')} FROM {A.PIXELS} GROUP BY grp, x, y")
def pixel_integral(spark, sf_dir):
    out = px.integral_or_zero(A.pixels(spark, sf_dir), ["grp", "x", "y"], ("v",))
    return out.select("grp", "x", "y", r(F.col("v"), "v"))


@query(f"SELECT grp, x, y, {rs('sum(v) / sum(a)', 'v')}, CAST(sum(a) AS BIGINT) AS overlap FROM {A.PIXELS} GROUP BY grp, x, y HAVING sum(a) > 26")
def pixel_integral_threshold(spark, sf_dir):
    out = px.integral(A.pixels(spark, sf_dir), ["grp", "x", "y"], ("v",), threshold=26.0)
    return out.select("grp", "x", "y", r(F.col("v"), "v"), F.col("overlap").cast("long").alias("overlap"))


@query(f"SELECT grp, x, y, {rs('avg(v)', 'v')} FROM {A.PIXELS} GROUP BY grp, x, y")
def blend_images(spark, sf_dir):
    return px.blended(A.pixels(spark, sf_dir), ["grp", "x", "y"], ("v",)).select("grp", "x", "y", r(F.col("v"), "v"))


@query(f"WITH p AS (SELECT img, x, y, v, min(v) OVER (PARTITION BY img) AS lo, max(v) OVER (PARTITION BY img) AS hi FROM {A.PIXELS}) SELECT img, x, y, {rs('(v - lo) / (hi - lo)', 'v')} FROM p")
def auto_contrast(spark, sf_dir):
    return px.auto_contrast(A.pixels(spark, sf_dir).select("img", "x", "y", "v"), ["img"], ("v",)).select("img", "x", "y", r(F.col("v"), "v"))


@query(
    f"""SELECT u.img, u.x, u.y, {rs('o.v * o.al / 255 + u.v * (1 - o.al / 255)', 'v')} FROM {A.PIXELS} u
JOIN (SELECT img - 1 AS img, x, y, v, CAST((x * 31 + y * 17) % 256 AS DOUBLE) AS al FROM {A.PIXELS}) o ON u.img = o.img AND u.x = o.x AND u.y = o.y"""
)
def overlay_composite(spark, sf_dir):
    """Every image under the next one."""
    p = A.pixels(spark, sf_dir)
    over = p.select((F.col("img") - 1).alias("img"), "x", "y", "v", ((F.col("x") * 31 + F.col("y") * 17) % 256).cast("double").alias("al"))
    return px.overlay_images(p, over, ["img", "x", "y"], ("v",), "al", whole=True).select("img", "x", "y", r(F.col("v"), "v"))


@query(f"SELECT img, x, y, CASE WHEN c = 1 AND d = 1 THEN 9 ELSE c END AS c, CASE WHEN c = 1 AND d = 1 THEN 8 ELSE d END AS d FROM (SELECT img, x, y, CAST(a AS INTEGER) AS c, x % 2 AS d FROM {A.PIXELS})")
def replace_color(spark, sf_dir):
    p = A.pixels(spark, sf_dir).select("img", "x", "y", F.col("a").cast("int").alias("c"), (F.col("x") % 2).alias("d"))
    return p.withColumns(px.replaced_color({"c": F.col("c"), "d": F.col("d")}, (1, 1), (9, 8)))


@query(f"SELECT img, x, y, {rs('v * CASE WHEN (x * 37 + y * 91) % 256 < 128 THEN 0 ELSE 1 END', 'v')}, {rs('a * CASE WHEN (x * 37 + y * 91) % 256 < 128 THEN 0 ELSE 1 END', 'a')} FROM {A.PIXELS}")
def mask_multiply(spark, sf_dir):
    p = A.pixels(spark, sf_dir)
    level = F.when((F.col("x") * 37 + F.col("y") * 91) % 256 < 128, 100).otherwise(255)
    mask = spark.range(64).select((F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y")).select("x", "y", px.binary_mask(level).alias("m"))
    return px.masked(p, F.broadcast(mask), ["x", "y"], ("v", "a")).select("img", "x", "y", r(F.col("v"), "v"), r(F.col("a"), "a"))


@query(
    f"""WITH p AS {A.PIXELS}, l AS (SELECT c.img, w.v + e.v + n.v + s.v - 4 * c.v AS lap FROM p c
  JOIN p w ON w.img = c.img AND w.y = c.y AND w.x = abs(c.x - 1) JOIN p e ON e.img = c.img AND e.y = c.y AND e.x = 7 - abs(7 - (c.x + 1))
  JOIN p n ON n.img = c.img AND n.x = c.x AND n.y = abs(c.y - 1) JOIN p s ON s.img = c.img AND s.x = c.x AND s.y = 7 - abs(7 - (c.y + 1)))
SELECT img, {rs('var_pop(lap)', 'laplacian_variance')} FROM l GROUP BY img"""
)
def laplacian_variance(spark, sf_dir):
    out = px.laplacian_variance(A.images(spark, sf_dir), "img", "embedding", 8, 8)
    return out.select("img", r(F.col("laplacian_variance"), "laplacian_variance"))


@query(
    f"""WITH p AS (SELECT img, x, y, CASE WHEN v > 0.2 THEN 1 ELSE 0 END AS q FROM {A.PIXELS}),
c AS (SELECT DISTINCT img, q AS color, min(rank) AS rank FROM (SELECT img, q, CASE WHEN x = 0 AND y = 0 THEN 0 WHEN x = 0 THEN 1 WHEN y = 7 THEN 2 ELSE 3 END AS rank FROM p WHERE x IN (0, 7) AND y IN (0, 7)) GROUP BY img, q),
b AS (SELECT c.img, c.rank, coalesce(min(x) FILTER (q <> color), 8) AS l, coalesce(max(x) FILTER (q <> color) + 1, 8) AS r, coalesce(min(y) FILTER (q <> color), 8) AS t, coalesce(max(y) FILTER (q <> color) + 1, 8) AS b
  FROM c JOIN p ON p.img = c.img GROUP BY c.img, c.rank)
SELECT img, CAST(t AS INTEGER) AS top, CAST(r AS INTEGER) AS "right", CAST(b AS INTEGER) AS bottom, CAST(l AS INTEGER) AS "left" FROM (
  SELECT *, row_number() OVER (PARTITION BY img ORDER BY (l + 8 - r) * 8 + (t + 8 - b) * (r - l) DESC, rank) AS n FROM b) WHERE n = 1"""
)
def crop_borders(spark, sf_dir):
    p = A.pixels(spark, sf_dir).select("img", "x", "y", F.when(F.col("v") > 0.2, 1).otherwise(0).alias("q"))
    return px.content_borders(p, "img", "q", 8, 8)


@query(
    f"""WITH m AS (SELECT max(vec_id) + 1 AS images FROM embeddings),
k AS (SELECT f.frame_id AS shot_id, g.vid, cos(a) * (g.x - cam_x) + sin(a) * (g.y - cam_y) AS ux, -sin(a) * (g.x - cam_x) + cos(a) * (g.y - cam_y) AS uy, g.z - cam_z AS uz, tan(radians(fovy) / 2) AS t
  FROM (SELECT *, radians(rot_z_deg) AS a FROM {A.FRAMES}) f, {A.VERTICES} g),
n AS (SELECT shot_id, vid, shot_id % images AS img, round(ux / -uz / t / 2 + 0.5, 9) AS u, round(uy / -uz / t / 2 + 0.5, 9) AS v FROM k, m WHERE uz < 0),
q AS (SELECT n.shot_id, n.vid, p.v FROM n JOIN {A.PIXELS} p ON p.img = n.img AND p.x = CAST(least(floor(n.u * 8), 7) AS INTEGER) AND p.y = CAST(least(floor((1 - n.v) * 8), 7) AS INTEGER)
  WHERE n.u BETWEEN 0 AND 1 AND n.v BETWEEN 0 AND 1)
SELECT f.frame_id, q.vid, {rs('sum(q.v) / count(*)', 'v')}, count(*) AS overlap
FROM (SELECT frame_id, frame_id + unnest(range(5)) AS shot_id FROM {A.FRAMES}) f JOIN q USING (shot_id) GROUP BY f.frame_id, q.vid"""
)
def shot_pixel_sampling(spark, sf_dir):
    """Ground points of every frame, as its window of five shots sees them; shot n
    shows image n modulo their number.  Many points lie on the edges of pixels, so
    coordinates are rounded before they choose one."""
    frames, images = A.frames(spark, sf_dir), A.images(spark, sf_dir)
    count = F.broadcast(images.agg((F.max("img") + 1).alias("images")))  # one row
    ground = A.vertices(spark, sf_dir).select("vid", *[F.col(c).alias(f"g{c}") for c in "xyz"])
    # What a shot sees is looked up once, then goes to the windows that hold the shot.
    shots = frames.withColumnRenamed("frame_id", "at").crossJoin(count).withColumn("shot_id", F.col("at") % F.col("images"))
    c = _frame_camera()

    def project():
        u, v, front = c.uv(Vec3.of("gx", "gy", "gz"))
        return F.round(u, 9), F.round(v, 9), front

    pixels = A.pixels(spark, sf_dir).select(F.col("img").alias("shot_id"), "x", "y", "v")
    seen = px.sample_shots(ground, shots, project, [], pixels, 8, 8, camera=c).select("at", "vid", "v", F.lit(1.0).alias("a"))
    window = frames.select("frame_id", F.explode(F.sequence(F.col("frame_id"), F.col("frame_id") + 4)).alias("at"))
    out = px.integral(seen.join(window, "at"), ["frame_id", "vid"], ("v",))
    return out.select("frame_id", "vid", r(F.col("v"), "v"), F.col("overlap").cast("long").alias("overlap"))


@query("SELECT i % 24 AS x, i // 24 AS y, CASE WHEN ((i % 24) // 4 + i // 24 // 4) % 2 = 0 THEN 255 ELSE 0 END AS c0 FROM range(576) t(i)")
def checkerboard(spark, sf_dir):
    out = doc.checkerboard(spark, 6, 4, (255,), (0,))
    return out.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "c0")


# --- suppression ------------------------------------------------------------

NMS_ROWS = f"(SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY line, track_id, class_id, x1, y1, x2, y2) AS n FROM {CORNERS})"


@query(
    f"""WITH RECURSIVE b AS (SELECT frame_id, line, track_id, class_id, x1, y1, x2, y2, n FROM {NMS_ROWS}),
go AS (SELECT frame_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(x1 INTEGER, y1 INTEGER, x2 INTEGER, y2 INTEGER)[]) AS kept, false AS keep FROM (SELECT DISTINCT frame_id FROM b)
  UNION ALL SELECT frame_id, n, CASE WHEN ok THEN list_append(kept, bx) ELSE kept END, ok FROM (
    SELECT b.frame_id, b.n, g.kept, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}} AS bx,
      len(list_filter(g.kept, lambda k: CAST(greatest(least(k.x2, b.x2) - greatest(k.x1, b.x1), 0) * greatest(least(k.y2, b.y2) - greatest(k.y1, b.y1), 0) AS DOUBLE)
        > 0.3 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(k.x2, b.x2) - greatest(k.x1, b.x1), 0) * greatest(least(k.y2, b.y2) - greatest(k.y1, b.y1), 0)))) = 0 AS ok
    FROM go g JOIN b ON b.frame_id = g.frame_id AND b.n = g.n + 1))
SELECT b.frame_id, b.line, b.track_id, b.class_id, b.x1, b.y1, b.x2, b.y2 FROM go JOIN b USING (frame_id, n) WHERE keep"""
)
def nms_greedy(spark, sf_dir):
    boxes = _corners(spark, sf_dir).select("frame_id", "line", "track_id", "class_id", "x1", "y1", "x2", "y2")
    return lb.nms(boxes, ["frame_id"], ["line", "track_id", "class_id"], 0.3).select("frame_id", "line", "track_id", "class_id", "x1", "y1", "x2", "y2")


# --- documents --------------------------------------------------------------


@query(f"SELECT frame_id, line, track_id, CAST(class_id AS INTEGER) AS class_id, {', '.join(rs(c, c) for c in ('xc', 'yc', 'w', 'h'))} FROM {A.LABELS}")
def yolo_text_roundtrip(spark, sf_dir):
    """Boxes written as lines and read again, among lines that are none."""
    rows = A.labels(spark, sf_dir)
    text = F.explode(F.array(doc.yolo_lines(rows), F.lit("no box"), F.lit("1 2 3")))
    lines = rows.select("frame_id", "line", "track_id", text.alias("value"))
    return doc.yolo_rows(lines).select("frame_id", "line", "track_id", "class_id", *[r(F.col(c), c) for c in ("xc", "yc", "w", "h")])


@query("SELECT n_regionkey % 2 AS flight_id, n_nationkey AS frame_id, 'label' || n_regionkey AS label_key, n_name AS label, CAST(n_nationkey % 7 AS VARCHAR) AS track, 6 AS values FROM nation")
def label_json_reshape(spark, sf_dir):
    """Label states nested as documents are, as JSON, and flat again."""
    n = A.table(spark, sf_dir, "nation")
    state = F.struct(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: i.cast("double")).alias("coordinates"), F.col("n_name").alias("label"), (F.col("n_nationkey") % 7).cast("string").alias("track"))
    frames = n.groupBy((F.col("n_regionkey") % 2).alias("flight"), F.concat(F.lit("label"), F.col("n_regionkey").cast("string")).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), state))).alias("frames"))
    flights = frames.groupBy("flight").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "frames")))).alias("json"))
    kind = "map<string,map<string,struct<coordinates:array<double>,label:string,track:string>>>"
    back = flights.select(F.col("flight").alias("flight_id"), F.from_json("json", kind).alias("labels"))
    out = doc.frame_states(back)
    return out.select("flight_id", F.col("frame_id").cast("int").alias("frame_id"), "label_key", "label", "track", F.size("coordinates").alias("values"))


@query(f"SELECT frame_id, CAST(flight_id AS VARCHAR) AS flight, frame_id AS frame, frame_id % 4 < 2 AS is_image FROM {A.FRAMES}")
def filename_parse(spark, sf_dir):
    f = A.frames(spark, sf_dir)
    ending = F.element_at(F.array(*[F.lit(e) for e in ("png", "jpg", "PNG", "txt")]), (F.col("frame_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/data/train/"), F.col("flight_id").cast("string"), F.lit("_"), F.col("frame_id").cast("string"), F.lit("."), ending)
    flight, frame = doc.file_key(path)
    return f.select("frame_id", flight.alias("flight"), frame.alias("frame"), doc.is_image(path).alias("is_image"))


@query(f"SELECT frame_id, 'shot_' || frame_id || '_v2.png' AS name FROM {A.FRAMES}")
def file_name_sequence(spark, sf_dir):
    return A.frames(spark, sf_dir).select("frame_id", doc.file_names(F.col("frame_id"), "png", "shot", "v2").alias("name"))


@query(
    f"""SELECT frame_id, '{{' || string_agg('"' || track_id || '":{{"animal_class":' || class_id || ',"axis_aligned_bbs":[' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ']}}', ',' ORDER BY CAST(track_id AS VARCHAR)) || '}}' AS json
FROM (SELECT frame_id, track_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, arg_min(class_id, line) AS class_id FROM {CORNERS} GROUP BY frame_id, track_id) GROUP BY frame_id"""
)
def track_json(spark, sf_dir):
    boxes = lb.track_boxes(_corners(spark, sf_dir), ["frame_id", "track_id"], ["line"])
    return doc.track_json(boxes, ["frame_id"])


@query(f"SELECT flight_id, {rs('avg(e)', 'avg_error')}, {rs('max(e)', 'max_error')}, {rs('min(e)', 'min_error')} FROM (SELECT flight_id, abs(cam_x - cam_y) AS e FROM {A.FRAMES}) GROUP BY flight_id")
def error_stats(spark, sf_dir):
    e = F.abs(F.col("cam_x") - F.col("cam_y"))
    out = A.frames(spark, sf_dir).groupBy("flight_id").agg(F.avg(e).alias("avg_error"), F.max(e).alias("max_error"), F.min(e).alias("min_error"))
    return out.select("flight_id", *[r(F.col(c), c) for c in out.columns[1:]])


@query(f"WITH p AS (SELECT img, x, 7 - y AS y, CAST(trunc(v * 500) AS DOUBLE) AS v FROM {A.PIXELS} WHERE img % 2 = 0 UNION ALL SELECT img, x, 7 - y, v FROM {A.PIXELS} WHERE img % 2 = 1) SELECT img, x, y, {rs('CASE WHEN max(v) OVER (PARTITION BY img) > 1 THEN v / 255 ELSE v END', 'v')} FROM p")
def normalize_pixels(spark, sf_dir):
    """Images in 0..255 and in 0..1 alike, upside down."""
    v = F.when(F.col("img") % 2 == 0, (F.col("v") * 500).cast("int").cast("double")).otherwise(F.col("v"))
    out = px.normalize_images(A.pixels(spark, sf_dir).select("img", "x", "y", v.alias("v")), ["img"], ("v",), 8)
    return out.select("img", "x", "y", r(F.col("v"), "v"))
