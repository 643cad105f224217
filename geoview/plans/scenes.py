"""Queries of the composed operators and of documents, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types
from ..config import FocusSettings, IntegralSettings, PipelineSettings, RenderSettings
from ..functions import camera as cam
from ..functions.geometry import Quad, Transform, perpendicular_or_error
from ..functions.vec import Quat, Vec3, random_quaternion
from ..operators import footprints as fp
from ..operators import frames as fr
from ..operators import labels as lb
from ..operators import lookups as lk
from ..operators import pixels as px
from ..operators import render as rd
from ..operators import tiles as tl
from ..sources import documents as doc
from ..sources import png, video
from . import adapters as A
from .catalogue import CORNERS, IN_CAMERA, ORACLE_SQL, WINDOW, _corners, _frame_camera, _hits_sql, _point, _triangles, _undistort_sql, query, r, rs

# --- the batch --------------------------------------------------------------

SETTINGS = PipelineSettings(ortho_width=70, ortho_height=70)
LABEL_RAYS = f"""(SELECT {{'f': frame_id, 'n': neighbour_id, 'p': phase, 't': track_id, 'c': class_id, 'l': line, 'x': x, 'y': y}} AS ray_id, ox, oy, oz,
  cos(a) * ux + sin(a) * uy AS dx, -sin(a) * ux + cos(a) * uy AS dy, CAST(-1 AS DOUBLE) AS dz FROM (
  SELECT DISTINCT w.frame_id, w.neighbour_id, w.phase, l.track_id, l.class_id, l.line, l.x, l.y, n.cam_x AS ox, n.cam_y AS oy, n.cam_z + c.tz AS oz, radians(n.rot_z_deg) AS a,
    (l.x / 512.0 - 1) * tan(radians(n.fovy) / 2) AS ux, (1 - l.y / 512.0) * tan(radians(n.fovy) / 2) AS uy
  FROM WINDOWS w JOIN {A.FRAMES} n ON n.frame_id = w.neighbour_id JOIN ({ORACLE_SQL["frame_correction_lookup"]}) c ON c.frame_id = w.frame_id
  JOIN (SELECT frame_id, track_id, class_id, line, unnest([x1, x2, x2, x1]) AS x, unnest([y1, y1, y2, y2]) AS y FROM {CORNERS}) l ON l.frame_id = w.neighbour_id))"""


def _batch_sql(windows: str) -> str:
    return f"""WITH b AS (SELECT h.ray_id.f AS frame_id, h.ray_id.t AS track_id, h.ray_id.c AS class_id, h.ray_id.p AS phase, h.ray_id.n AS n, h.ray_id.l AS line,
  1024 + (h.x - f.cam_x) * 2048 / 70 AS px, 1024 - (h.y - f.cam_y) * 2048 / 70 AS py FROM ({_hits_sql(1.0, '', 12, LABEL_RAYS.replace('WINDOWS', windows))}) h JOIN {A.FRAMES} f ON f.frame_id = h.ray_id.f),
t AS (SELECT frame_id, track_id, arg_min(class_id, ((phase * 1000000000 + n) * 1000 + line) * 10 + class_id) AS class_id, min(px) AS x1, min(py) AS y1, max(px) AS x2, max(py) AS y2 FROM b GROUP BY frame_id, track_id)
SELECT f.flight_id, t.frame_id, t.track_id, t.class_id, {rs('(x1 + x2) / 2 / 2048', 'xc')}, {rs('(y1 + y2) / 2 / 2048', 'yc')}, {rs('(x2 - x1) / 2048', 'w')}, {rs('(y2 - y1) / 2048', 'h')}
FROM t JOIN {A.FRAMES} f USING (frame_id) WHERE NOT (x1 > 2048 OR x2 < 0 OR y1 > 2048 OR y2 < 0)"""


def _batch(spark, sf_dir, settings: PipelineSettings) -> DataFrame:
    frames = A.frames(spark, sf_dir).withColumns({"rot_x_deg": F.lit(0.0), "rot_y_deg": F.lit(0.0)})
    zero = {c: F.lit(0.0) for c in rd.CORRECTION if c != "tz"}
    corrections = A.corrections(spark, sf_dir).withColumns(zero)
    out = rd.batch_labels(frames, _label_corners(spark, sf_dir), corrections, _triangles(spark, sf_dir), settings, 200, 200, 5, ensure_int=False)
    return out.select("flight_id", "frame_id", "track_id", "class_id", *[r(F.col(c), c) for c in ("xc", "yc", "w", "h")])


@query(_batch_sql(f"(SELECT frame_id, neighbour_id, phase FROM {WINDOW} UNION ALL SELECT frame_id, frame_id, 0 FROM {A.FRAMES})"))
def batch_labels(spark, sf_dir):
    """Labels of all frames and their neighbours, cast on the mesh and seen from
    above each frame."""
    return _batch(spark, sf_dir, SETTINGS)


@query(_batch_sql(f"(SELECT frame_id, frame_id AS neighbour_id, 0 AS phase FROM {A.FRAMES})"))
def batch_labels_unmerged(spark, sf_dir):
    return _batch(spark, sf_dir, PipelineSettings(merge_labels=False))


#: Frames whose numbers begin anew in each of seven flights, as their labels and
#: corrections do, with a default correction for each flight.
OWN_FRAMES = f"(SELECT * REPLACE (frame_id // 7 AS frame_id, frame_id % 7 AS flight_id) FROM {A.FRAMES})"
OWN_LABELS = f"(SELECT * REPLACE (frame_id // 7 AS frame_id), frame_id % 7 AS flight_id FROM {CORNERS})"
OWN_TZ = f"""(SELECT f.flight_id, f.frame_id, coalesce(arg_min(k.tz, k.pos), f.flight_id * CAST(0.5 AS DOUBLE)) AS tz FROM {OWN_FRAMES} f
  LEFT JOIN (SELECT pos, pos % 7 AS flight_id, lo // 7 AS lo, hi // 7 AS hi, tz FROM {A.CORRECTIONS}) k ON k.flight_id = f.flight_id AND f.frame_id BETWEEN k.lo AND k.hi GROUP BY f.flight_id, f.frame_id)"""
OWN_RAYS = f"""(SELECT {{'s': flight_id, 'f': frame_id, 'n': neighbour_id, 'p': phase, 't': track_id, 'c': class_id, 'l': line, 'x': x, 'y': y}} AS ray_id, ox, oy, oz,
  cos(a) * ux + sin(a) * uy AS dx, -sin(a) * ux + cos(a) * uy AS dy, CAST(-1 AS DOUBLE) AS dz FROM (
  SELECT DISTINCT f.flight_id, f.frame_id, n.frame_id AS neighbour_id, CASE WHEN n.frame_id = f.frame_id THEN 0 WHEN n.frame_id < f.frame_id THEN 1 ELSE 2 END AS phase, l.track_id, l.class_id, l.line, l.x, l.y,
    n.cam_x AS ox, n.cam_y AS oy, n.cam_z + c.tz AS oz, radians(n.rot_z_deg) AS a, (l.x / 512.0 - 1) * tan(radians(n.fovy) / 2) AS ux, (1 - l.y / 512.0) * tan(radians(n.fovy) / 2) AS uy
  FROM {OWN_FRAMES} f JOIN {OWN_FRAMES} n ON n.flight_id = f.flight_id AND n.frame_id IN (f.frame_id - 5, f.frame_id, f.frame_id + 5) JOIN {OWN_TZ} c ON c.flight_id = f.flight_id AND c.frame_id = f.frame_id
  JOIN (SELECT flight_id, frame_id, track_id, class_id, line, unnest([x1, x2, x2, x1]) AS x, unnest([y1, y1, y2, y2]) AS y FROM {OWN_LABELS}) l ON l.flight_id = n.flight_id AND l.frame_id = n.frame_id))"""


def _own(df: DataFrame) -> DataFrame:
    return df.withColumns({"flight_id": F.col("frame_id") % 7, "frame_id": F.expr("frame_id div 7")})


def _label_corners(spark, sf_dir) -> DataFrame:
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return _corners(spark, sf_dir).select("frame_id", "line", "track_id", "class_id", F.array(at(x1, y1), at(x2, y1), at(x2, y2), at(x1, y2)).alias("corners"))


@query(
    f"""WITH b AS (SELECT h.ray_id.s AS flight_id, h.ray_id.f AS frame_id, h.ray_id.t AS track_id, h.ray_id.c AS class_id, h.ray_id.p AS phase, h.ray_id.n AS n, h.ray_id.l AS line,
  1024 + (h.x - f.cam_x) * 2048 / 70 AS px, 1024 - (h.y - f.cam_y) * 2048 / 70 AS py FROM ({_hits_sql(1.0, '', 12, OWN_RAYS)}) h JOIN {OWN_FRAMES} f ON f.flight_id = h.ray_id.s AND f.frame_id = h.ray_id.f),
t AS (SELECT flight_id, frame_id, track_id, arg_min(class_id, ((phase * 1000000000 + n) * 1000 + line) * 10 + class_id) AS class_id, min(px) AS x1, min(py) AS y1, max(px) AS x2, max(py) AS y2 FROM b GROUP BY flight_id, frame_id, track_id)
SELECT flight_id, frame_id, track_id, class_id, {rs('(x1 + x2) / 2 / 2048', 'xc')}, {rs('(y1 + y2) / 2 / 2048', 'yc')}, {rs('(x2 - x1) / 2048', 'w')}, {rs('(y2 - y1) / 2048', 'h')}
FROM t WHERE NOT (x1 > 2048 OR x2 < 0 OR y1 > 2048 OR y2 < 0)"""
)
def batch_labels_by_flight(spark, sf_dir):
    """The batch over flights whose frame numbers, labels, corrections, defaults and
    meshes are their own."""
    frames = _own(A.frames(spark, sf_dir)).withColumns({"rot_x_deg": F.lit(0.0), "rot_y_deg": F.lit(0.0)})
    zero = {c: F.lit(0.0) for c in rd.CORRECTION if c != "tz"}
    corrections = A.corrections(spark, sf_dir).withColumns({"flight_id": F.col("pos") % 7, "lo": F.expr("lo div 7"), "hi": F.expr("hi div 7"), **zero})
    flights = frames.select("flight_id").distinct()
    default = flights.withColumns({**zero, "tz": F.col("flight_id") * 0.5})
    meshes = _triangles(spark, sf_dir).crossJoin(F.broadcast(flights))  # seven flights
    out = rd.batch_labels(frames, _own(_label_corners(spark, sf_dir)), corrections, meshes, SETTINGS, 5, 5, 5, default=default, ensure_int=False)
    return out.select("flight_id", "frame_id", "track_id", "class_id", *[r(F.col(c), c) for c in ("xc", "yc", "w", "h")])


# --- renders ----------------------------------------------------------------

GRID = 6
#: A view of odd size, so that no point lies on the edge of a pixel.
VIEW = (393.7, 381.3)


def _scenes(spark, sf_dir) -> DataFrame:
    """A flight's view: an orthographic camera over the mean of its shots."""
    return A.frames(spark, sf_dir).groupBy("flight_id").agg(F.avg("cam_x").alias("vx"), F.avg("cam_y").alias("vy"))


def _points(spark, sf_dir) -> DataFrame:
    view = cam.Camera.orthographic(Transform(Vec3.of("vx", "vy", 200.0)), *VIEW)
    return rd.view_points(_scenes(spark, sf_dir), ["flight_id"], view, GRID, GRID, _triangles(spark, sf_dir)).withColumnsRenamed({"x": "gx", "y": "gy", "z": "gz"})


def _shots(spark, sf_dir) -> DataFrame:
    images = A.images(spark, sf_dir).agg((F.max("img") + 1).alias("images"))  # one row
    return A.frames(spark, sf_dir).crossJoin(F.broadcast(images)).withColumn("shot_id", F.col("frame_id") % F.col("images")).drop("images")


def _render(spark, sf_dir, points: DataFrame, shots: DataFrame, keys: list[str], settings: IntegralSettings) -> DataFrame:
    camera = _frame_camera()
    pixels = A.pixels(spark, sf_dir).select(F.col("img").alias("shot_id"), "x", "y", "v", F.lit(1.0).alias("a"))
    bounds = fp.mesh_bounds(_triangles(spark, sf_dir))
    out = rd.render_integral(points, shots, keys, lambda: camera.uv(Vec3.of("gx", "gy", "gz")), pixels, (8, 8), ("v",), settings, camera=camera, bounds=bounds)
    return out.select(*keys, "rx", "ry", r(F.col("v"), "v"), F.col("overlap").cast("long").alias("overlap"))


VIEW_RAYS = f"""(SELECT {{'s': flight_id, 'rx': CAST(i % {GRID} AS INTEGER), 'ry': CAST(i // {GRID} AS INTEGER)}} AS ray_id, vx + ((i % {GRID} + 0.5) / {GRID} * 2 - 1) * CAST({VIEW[0]} AS DOUBLE) / 2 AS ox,
  vy + (1 - (i // {GRID} + 0.5) / {GRID} * 2) * CAST({VIEW[1]} AS DOUBLE) / 2 AS oy, CAST(200 AS DOUBLE) AS oz, CAST(0 AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS dy, CAST(-1 AS DOUBLE) AS dz
  FROM (SELECT flight_id, avg(cam_x) AS vx, avg(cam_y) AS vy FROM {A.FRAMES} GROUP BY flight_id), range({GRID * GRID}) t(i))"""


def _render_sql(frames: str, focus: str, threshold: int, contrast: bool) -> str:
    value = "CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END" if contrast else "v"
    keys = f"flight_id{', focus' if focus else ''}"
    return f"""WITH g AS (SELECT ray_id.s AS flight_id, ray_id.rx AS rx, ray_id.ry AS ry, x AS gx, y AS gy, z AS gz FROM ({_hits_sql(1.0, '', 12, VIEW_RAYS)})),
k AS (SELECT g.flight_id, rx, ry, frame_id, focus, cos(a) * (gx - cam_x) + sin(a) * (gy - cam_y) AS ux, -sin(a) * (gx - cam_x) + cos(a) * (gy - cam_y) AS uy, gz - cam_z AS uz, tan(radians(fovy) / 2) AS t
  FROM g JOIN (SELECT *, radians(rot_z_deg) AS a FROM {frames}) f ON f.flight_id = g.flight_id),
n AS (SELECT *, ux / -uz / t / 2 + 0.5 AS u, uy / -uz / t / 2 + 0.5 AS w FROM k WHERE uz < 0),
i AS (SELECT n.flight_id, focus, rx, ry, sum(p.v) / count(*) AS v, count(*) AS overlap FROM n JOIN {A.PIXELS} p ON p.img = n.frame_id % (SELECT max(vec_id) + 1 FROM embeddings)
  AND p.x = CAST(least(floor(n.u * 8), 7) AS INTEGER) AND p.y = CAST(least(floor((1 - n.w) * 8), 7) AS INTEGER)
  WHERE n.u BETWEEN 0 AND 1 AND n.w BETWEEN 0 AND 1 GROUP BY n.flight_id, focus, rx, ry HAVING count(*) > {threshold}),
c AS (SELECT *, min(v) OVER (PARTITION BY flight_id, focus) AS lo, max(v) OVER (PARTITION BY flight_id, focus) AS hi FROM i)
SELECT {keys}, rx, ry, {rs(value, 'v')}, overlap FROM c"""


@query(_render_sql(f"(SELECT *, 0 AS focus FROM {A.FRAMES})", "", 2, True))
def render_integral(spark, sf_dir):
    """Every flight's shots, integrated where its view meets the mesh."""
    return _render(spark, sf_dir, _points(spark, sf_dir), _shots(spark, sf_dir), ["flight_id"], IntegralSettings(alpha_threshold=2.0, auto_contrast=True))


@query(_render_sql(f"(SELECT * REPLACE (cam_z - focus * CAST(30 AS DOUBLE) / 3 AS cam_z) FROM {A.FRAMES}, range(3) t(focus))", "focus", 0, False))
def focus_frames(spark, sf_dir):
    """The same at three heights of focus."""
    s = FocusSettings(start_focus=0.0, end_focus=30.0, frame_count=3, alpha_threshold=0.1, auto_contrast=False)
    shots = rd.focus_shots(_shots(spark, sf_dir), fr.focus_plan(spark, s.start_focus, s.end_focus, s.frame_count))
    points = _points(spark, sf_dir).withColumn("focus", F.explode(F.sequence(F.lit(0), F.lit(s.frame_count - 1)).cast("array<long>")))
    return _render(spark, sf_dir, points, shots, ["flight_id", "focus"], s)


UNDER = f"(SELECT flight_id, CAST(i % {GRID} AS INTEGER) AS rx, CAST(i // {GRID} AS INTEGER) AS ry, (i + flight_id % 7) / 100.0 AS v FROM (SELECT DISTINCT flight_id FROM {A.FRAMES}), range({GRID * GRID}) t(i))"


def _background(spark, sf_dir) -> DataFrame:
    cell = F.explode(F.sequence(F.lit(0), F.lit(GRID * GRID - 1)))
    rows = A.frames(spark, sf_dir).select("flight_id").distinct().withColumn("i", cell)
    return rows.select("flight_id", (F.col("i") % GRID).cast("int").alias("rx"), F.expr(f"cast(i div {GRID} as int)").alias("ry"), ((F.col("i") + F.col("flight_id") % 7) / 100.0).alias("v"))


@query(
    f"""SELECT flight_id, rx, ry, {rs('coalesce(c.v, b.v)', 'v')}, coalesce(c.overlap, 0) AS overlap FROM {UNDER} b
  LEFT JOIN ({_render_sql(f"(SELECT *, 0 AS focus FROM {A.FRAMES})", "", 2, True)}) c USING (flight_id, rx, ry)"""
)
def render_background(spark, sf_dir):
    """Every flight's integral over a background, which shows where too few shots
    overlap."""
    camera = _frame_camera()
    pixels = A.pixels(spark, sf_dir).select(F.col("img").alias("shot_id"), "x", "y", "v", F.lit(1.0).alias("a"))
    s = IntegralSettings(alpha_threshold=2.0, auto_contrast=True, add_background=True)
    bounds = fp.mesh_bounds(_triangles(spark, sf_dir))
    out = rd.render_integral(_points(spark, sf_dir), _shots(spark, sf_dir), ["flight_id"], lambda: camera.uv(Vec3.of("gx", "gy", "gz")), pixels, (8, 8), ("v",), s, background=_background(spark, sf_dir), camera=camera, bounds=bounds)
    return out.select("flight_id", "rx", "ry", r(F.col("v"), "v"), F.col("overlap").cast("long").alias("overlap"))


@query(
    f"""WITH g AS (SELECT ray_id.s AS flight_id, ray_id.rx AS rx, ray_id.ry AS ry, x AS gx, y AS gy, z AS gz FROM ({_hits_sql(1.0, '', 12, VIEW_RAYS)})),
k AS (SELECT g.flight_id, rx, ry, frame_id, cos(a) * (gx - cam_x) + sin(a) * (gy - cam_y) AS ux, -sin(a) * (gx - cam_x) + cos(a) * (gy - cam_y) AS uy, gz - cam_z AS uz, tan(radians(fovy) / 2) AS t
  FROM g JOIN (SELECT *, radians(rot_z_deg) AS a FROM {A.FRAMES}) f ON f.flight_id = g.flight_id),
n AS (SELECT *, ux / -uz / t / 2 + 0.5 AS u, uy / -uz / t / 2 + 0.5 AS w FROM k WHERE uz < 0),
o AS (SELECT n.flight_id, n.frame_id, rx, ry, p.v FROM n JOIN {A.PIXELS} p ON p.img = n.frame_id % (SELECT max(vec_id) + 1 FROM embeddings)
  AND p.x = CAST(least(floor(n.u * 8), 7) AS INTEGER) AND p.y = CAST(least(floor((1 - n.w) * 8), 7) AS INTEGER) WHERE n.u BETWEEN 0 AND 1 AND n.w BETWEEN 0 AND 1),
c AS (SELECT f.flight_id, f.frame_id, b.rx, b.ry, coalesce(o.v * 0.5 + b.v * 0.5, b.v) AS v, o.v IS NOT NULL AS own FROM {UNDER} b JOIN {A.FRAMES} f USING (flight_id) LEFT JOIN o ON o.flight_id = f.flight_id AND o.frame_id = f.frame_id AND o.rx = b.rx AND o.ry = b.ry)
SELECT frame_id, count(*) AS pixels, {rs('sum(v * (1 + rx + 6 * ry))', 'sum', 4)} FROM c GROUP BY frame_id"""
)
def project_shots_complete(spark, sf_dir):
    """An image for each shot, half clear over the background of its flight, summed
    up with weights by place."""
    camera = _frame_camera()
    shots = _shots(spark, sf_dir).withColumn("shot", F.col("frame_id"))
    pixels = A.pixels(spark, sf_dir).select(F.col("img").alias("shot_id"), "x", "y", "v", F.lit(0.5).alias("a"))
    bounds = fp.mesh_bounds(_triangles(spark, sf_dir))
    out = rd.project_shots(_points(spark, sf_dir), shots, ["flight_id"], lambda: camera.uv(Vec3.of("gx", "gy", "gz")), pixels, (8, 8), ("v",), "Complete", _background(spark, sf_dir), shot="shot", camera=camera, bounds=bounds)
    return out.groupBy(F.col("shot").alias("frame_id")).agg(F.count(F.lit(1)).alias("pixels"), r(F.sum(F.col("v") * (1 + F.col("rx") + 6 * F.col("ry"))), "sum", 4))


@query(
    f"""WITH v AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {A.VERTICES}), p AS ({ORACLE_SQL["camera_positions"]})
SELECT frame_id, {rs('((cam_x - p.x) * 2 / trunc(x1 - x0 + 0.5) + 1) / 2 * 512', 'px')}, {rs('(1 - (cam_y - p.y) * 2 / trunc(y1 - y0 + 0.5)) / 2 * 512', 'py')} FROM {A.FRAMES}, v, p WHERE p.mode = 'BackgroundCentered'"""
)
def scene_camera_pixels(spark, sf_dir):
    """Shots in the view of a camera over the middle of the mesh, as large as it."""
    shots = A.frames(spark, sf_dir).select("frame_id", *[F.col(f"cam_{c}").alias(c) for c in "xyz"])
    row, camera = rd.scene_camera(shots, "frame_id", fr.aabb_of(A.vertices(spark, sf_dir)), RenderSettings(positioning_mode="BackgroundCentered", camera_dist=10.0))
    x, y = camera.world_to_pixel(Vec3.of("cam_x", "cam_y", "cam_z"), 512, 512)
    return A.frames(spark, sf_dir).crossJoin(F.broadcast(row)).select("frame_id", r(x, "px"), r(y, "py"))  # one row


@query(
    f"""SELECT frame_id, {rs('cos(a) * ux - sin(a) * uy', 'dx', 9)}, {rs('sin(a) * ux + cos(a) * uy', 'dy', 9)} FROM (
  SELECT f.frame_id, radians(rot_z_deg) AS a, ((u * 1000 + 512) / 512.0 - 1) * tan(radians(fovy) / 2) AS ux, (1 - (v * 1000 + 512) / 512.0) * tan(radians(fovy) / 2) AS uy
  FROM ({_undistort_sql(5, "(frame_id % 1024 - 512) / 1000.0", "(frame_id * 3 % 1024 - 512) / 1000.0")}) d JOIN {A.FRAMES} f USING (frame_id))"""
)
def undistorted_rays(spark, sf_dir):
    """Rays through a pixel of every frame, of a lens with distortion."""
    x, y = (F.col("frame_id") % 1024).cast("double"), (F.col("frame_id") * 3 % 1024).cast("double")
    out = rd.pixel_rays(A.frames(spark, sf_dir), _frame_camera(), x, y, 1024, 1024, (Vec3.of(-0.1, 0.01, 0.001), 0.001, -0.002), (1000.0, 1000.0, 512.0, 512.0))
    return out.select("frame_id", r(F.col("dx"), "dx", 9), r(F.col("dy"), "dy", 9))


@query(
    f"""WITH s AS (SELECT vec_id AS img, row_number() OVER (ORDER BY vec_id) - 1 AS n, count(*) OVER () AS total FROM embeddings),
o AS (SELECT img, n + CASE WHEN n = 0 THEN 0 ELSE 3 END + k AS out_id FROM s, range(6) t(k) WHERE k <= CASE WHEN n = 0 THEN 3 ELSE 0 END + CASE WHEN n = total - 1 THEN 2 ELSE 0 END),
b AS (SELECT img, x, y, CAST(trunc(greatest(v, 0) * 255) AS INTEGER) AS b FROM {A.PIXELS})
SELECT out_id, count(*) AS pixels, sum(b * (x + 8 * y))::BIGINT AS red, sum((255 - b) * (x + 8 * y))::BIGINT AS blue FROM o JOIN b USING (img) GROUP BY out_id"""
)
def video_roundtrip(spark, sf_dir):
    """All images as a video with a longer first and last frame, in segments, and the
    frames read back from them."""
    p = A.pixels(spark, sf_dir).withColumn("red", px.to_byte(F.greatest("v", F.lit(0.0))))
    p = p.select("img", "x", "y", "red", F.lit(0).alias("green"), (255 - F.col("red")).alias("blue"), F.lit(255).alias("alpha"))
    images = png.images_from_pixels(p, "img", 8, 8, ("red", "green", "blue", "alpha"))
    shown = fr.video_sequence(images, "img", 3, 2)
    back = video.segment_frames(video.video_segments(shown, per_segment=50))
    cells = back.select((F.col("segment") * 50 + F.col("at")).alias("out_id"), F.posexplode("rgba").alias("i", "v")).withColumns({"cell": F.floor(F.col("i") / 4), "ch": F.col("i") % 4})
    weighted = lambda ch: F.sum(F.when(F.col("ch") == ch, F.col("v") * F.col("cell"))).cast("long")
    return cells.groupBy("out_id").agg(F.count_if(F.col("ch") == 0).alias("pixels"), weighted(0).alias("red"), weighted(2).alias("blue"))


@query(
    f"""WITH p AS ({ORACLE_SQL["shutter_growth"]}), s AS (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)
SELECT frame, first, last, CAST(sum(p_size) AS BIGINT) AS light FROM p JOIN s ON n >= first AND n < last GROUP BY frame, first, last"""
)
def shutter_frames(spark, sf_dir):
    """What every frame of a growing exposure adds up."""
    shots = A.sequence(spark, sf_dir).withColumn("light", F.col("size").cast("long"))
    plan = fr.shutter_plan(spark, shots.count(), 100, lambda i: i + 1)
    return rd.shutter_sums(plan.select("frame", "first", "last"), shots, "shot", ["light"])


@query(
    f"""SELECT frame_id, {rs('cam_x + 2 * cos(a) - 3 * sin(a)', 'x')}, {rs('cam_y + 2 * sin(a) + 3 * cos(a)', 'y')}, {rs('cam_z + 4', 'z')},
  {rs('cos(b) * ux + sin(b) * uy', 'dx', 9)}, {rs('-sin(b) * ux + cos(b) * uy', 'dy', 9)} FROM (
  SELECT *, radians(rot_z_deg) AS a, radians(rot_z_deg) - CAST(0.25 AS DOUBLE) AS b, (frame_id % 1024 / 512.0 - 1) * tan(radians(fovy) / 2) AS ux, (1 - frame_id * 3 % 1024 / 512.0) * tan(radians(fovy) / 2) AS uy FROM {A.FRAMES})"""
)
def label_cameras(spark, sf_dir):
    """A frame's label camera under a correction (0.25 about z), its ray through a
    pixel, and its pose moved along its own axes."""
    zero = F.lit(0.0)
    c = cam.frame_camera(Vec3.of("cam_x", "cam_y", "cam_z"), Vec3(zero, zero, F.col("rot_z_deg")), "fovy", Vec3.of(0, 0, 0), Vec3.of(0, 0, 0.25))
    _, d = c.ray((F.col("frame_id") % 1024).cast("double"), (F.col("frame_id") * 3 % 1024).cast("double"), 1024, 1024)
    pose = Transform(Vec3.of("cam_x", "cam_y", "cam_z"), Quat.about("z", F.radians("rot_z_deg")))
    p = pose.moved("right", 2).moved("up", 3).moved("forward", 4).position
    return A.frames(spark, sf_dir).select("frame_id", r(p.x, "x"), r(p.y, "y"), r(p.z, "z"), r(d.x, "dx", 9), r(d.y, "dy", 9))


@query(f"SELECT frame_id, {rs('x0 * s', 'x', 9)}, {rs('y0 * s', 'y', 9)}, {rs('-s * sqrt(x0 * x0 + y0 * y0 + 9)', 'z', 9)}, true AS upright FROM (SELECT frame_id, frame_id % 7 - 3 AS x0, frame_id % 5 - 2 AS y0, 0 AS s FROM {A.FRAMES})")
def looking_at(spark, sf_dir):
    """The target of a view lies on its axis, at its distance."""
    eye = Vec3(F.col("frame_id") % 7 - 3.0, F.col("frame_id") % 5 - 2.0, F.lit(3.0))
    m = Transform(eye).looking_at(Vec3.of(0, 0, 0))
    at = m.point(Vec3.of(0, 0, 0))
    turned = Transform(eye, Quat.about("z", F.col("frame_id") / 10))
    upright = perpendicular_or_error(turned.direction("up"), turned.direction("forward"))
    return A.frames(spark, sf_dir).select("frame_id", r(at.x, "x", 9), r(at.y, "y", 9), r(at.z + eye.length(), "z", 9), upright.alias("upright"))


@query(f"SELECT frame_id, {rs('(ux * 2048 / 70 + 1) / 2 * 2048', 'px')}, {rs('(1 - uy * 2048 / 70) / 2 * 2048', 'py')} FROM {IN_CAMERA}")
def scaled_ortho_pixels(spark, sf_dir):
    x, y = _frame_camera(True).scaled_ortho_pixel(_point(), 2048, 2048)
    return A.frames(spark, sf_dir).select("frame_id", r(x, "px"), r(y, "py"))


@query(f"SELECT count(*) AS rotations, count(*) FILTER (true) // 4 AS frames, true AS within, CAST(0 AS DOUBLE) AS first, true AS unit FROM (SELECT 1 FROM {A.FRAMES}, range(4))")
def random_rotation_bounds(spark, sf_dir):
    """What holds for random rotations and quaternions whatever the draw."""
    q = random_quaternion((-10, -20, -30), (10, 20, 30), seed=3)
    norm = q.vector.dot(q.vector) + q.w * q.w
    rows = fr.random_rotations(A.frames(spark, sf_dir).select("frame_id"), 0.5, 3, seed=11).select("*", norm.alias("norm"))
    later = F.col("rotation_nr") > 0
    return rows.agg(
        F.count(F.lit(1)).alias("rotations"), F.countDistinct("frame_id").alias("frames"), F.every((F.col("rotation") >= -0.5) & (F.col("rotation") < 0.5) & (~later | (F.col("rotation") != 0))).alias("within"),
        F.max(F.when(~later, F.abs("rotation"))).alias("first"), F.every(F.abs(F.col("norm") - 1) < 1e-9).alias("unit"),
    )


# --- documents --------------------------------------------------------------


@query(
    f"""SELECT flight_id, row_number() OVER (PARTITION BY flight_id ORDER BY frame_id) - 1 AS position, 'pics/' || flight_id || '_' || frame_id || '.png' AS image, {rs('cam_x', 'x')}, {rs('fovy', 'fovy')},
  {rs("CASE WHEN frame_id % 2 = 0 THEN sin(radians(rot_z_deg) / 2) ELSE CAST(0.6 AS DOUBLE) END", 'qz', 9)}, {rs("CASE WHEN frame_id % 2 = 0 THEN cos(radians(rot_z_deg) / 2) ELSE CAST(0.8 AS DOUBLE) END", 'qw', 9)} FROM {A.FRAMES}"""
)
def pose_documents(spark, sf_dir):
    """Every flight's poses as a JSON document, with rotations of three numbers or
    four and angles that are numbers or lists, read again and joined to frames by
    their position."""
    f = A.frames(spark, sf_dir)
    even = F.col("frame_id") % 2 == 0
    rotation = F.when(even, F.array(F.lit(0.0), F.lit(0.0), F.col("rot_z_deg"))).otherwise(F.array(*[F.lit(v) for v in (0.0, 0.0, 0.6, 0.8)]))
    name = F.concat_ws("_", F.col("flight_id").cast("string"), F.concat(F.col("frame_id").cast("string"), F.lit(".png")))
    image = F.struct(
        F.col("frame_id").alias("order"), F.when(even, name).alias("imagefile"), F.when(~even, name).alias("file"), F.array("cam_x", "cam_y", "cam_z").alias("pos"), rotation.alias("rotation"),
        F.when(even, F.col("fovy").cast("string")).otherwise(F.concat(F.lit("["), F.col("fovy").cast("string"), F.lit("]"))).alias("fovy"),
    )
    docs = f.groupBy("flight_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(image)).alias("images"))).alias("json"))
    poses = doc.poses_of(docs.select("flight_id", F.from_json("json", types.POSES).alias("d")).select("flight_id", "d.images"), F.col("flight_id"), image_dir="pics")
    frames = poses.select("flight_id", "frame_id")
    met = lk.attach_poses(frames, poses)
    at = lambda c, i: F.get(c, F.lit(i))
    return met.select("flight_id", F.col("frame_id").alias("position"), "image", r(at("location", 0), "x"), r(F.col("fovy"), "fovy"), r(at("quaternion", 2), "qz", 9), r(at("quaternion", 3), "qw", 9))


@query(
    f"""SELECT CAST(pos % 10 AS VARCHAR) AS flight_id, row_number() OVER (PARTITION BY pos % 10 ORDER BY pos) - 1 AS pos, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi,
  round(tz, 6) + 0.0 AS tz, CAST(0.5 AS DOUBLE) AS rx FROM {A.CORRECTIONS}"""
)
def correction_documents(spark, sf_dir):
    """Corrections of all flights as one JSON document, read again."""
    none = F.lit(0.0)
    one = F.struct(
        F.col("lo").cast("int").alias("start frame"), F.col("hi").cast("int").alias("end frame"), F.struct(none.alias("x"), none.alias("y"), F.col("tz").alias("z")).alias("translation"),
        F.struct(F.lit(0.5).alias("x"), none.alias("y"), none.alias("z")).alias("rotation"),
    )
    rows = A.corrections(spark, sf_dir).groupBy((F.col("pos") % 10).cast("string").alias("flight")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    docs = rows.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("flight", "all"))).alias("corrections"))).alias("json"))
    out = doc.corrections_of(docs.select(F.from_json("json", types.CORRECTIONS).alias("d")).select("d.*"))
    return out.select("flight_id", "pos", "lo", "hi", r(F.col("tz"), "tz"), r(F.col("rx"), "rx"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS flight_id, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS intervals, round(s_acctbal / 10000, 6) + 0.0 AS default_tz FROM supplier")
def flight_corrections(spark, sf_dir):
    """A document for every flight: intervals and a default, or just the default."""
    c = A.corrections(spark, sf_dir)
    move = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("tz").alias("z"))
    both = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("start frame"), F.lit(9).alias("end frame"), move.alias("translation"), move.alias("rotation"))).alias("corrections"), F.struct(move.alias("translation"), move.alias("rotation")).alias("default")))
    alone = F.to_json(F.struct(move.alias("translation"), move.alias("rotation")))
    docs = c.select(F.col("pos").cast("string").alias("flight_id"), F.from_json(F.when(F.col("pos") % 2 == 0, both).otherwise(alone), types.FLIGHT_CORRECTIONS).alias("d")).select("flight_id", "d.*")
    rows, default = doc.flight_corrections_of(docs)
    n = rows.groupBy("flight_id").agg(F.count(F.lit(1)).cast("int").alias("intervals"))
    return default.join(n, "flight_id", "left").select("flight_id", F.coalesce("intervals", F.lit(0)).alias("intervals"), r(F.col("tz"), "default_tz"))


def _export(spark, sf_dir) -> DataFrame:
    """Nations as flights of two missions, of which the last holds: flight i is in
    mission i % 3 and i % 2, and has one label of two frames."""
    n = A.table(spark, sf_dir, "nation")
    i = F.col("n_nationkey")
    state = F.struct(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: k.cast("double")).alias("coordinates"), F.col("n_name").alias("label"), i.cast("string").alias("track"))
    frames = F.map_from_arrays(F.array(i.cast("string"), (i + 100).cast("string")), F.array(state, state))
    flight = F.struct((i + 1).alias("nr_of_frames_before_current"), (i + 2).alias("nr_of_frames_after_current"), F.create_map(F.lit("l0"), frames).alias("labels"))
    flights = n.select(i.alias("i"), i.cast("string").alias("flight_id"), flight.alias("flight"))
    i = F.col("i")
    in_missions = flights.select("flight_id", "flight", F.explode(F.array_distinct(F.array((i % 3).cast("string"), (i % 2).cast("string")))).alias("mission"))
    missions = in_missions.groupBy("mission").agg(F.map_from_entries(F.collect_list(F.struct("flight_id", "flight"))).alias("flights"))
    i = F.col("n_nationkey")
    ids = n.select(F.struct(i.alias("order"), i.cast("string").alias("k"), F.concat(F.lit("Q"), F.col("n_regionkey").cast("string")).alias("v")).alias("e")).agg(F.array_sort(F.collect_list("e")).alias("all"))
    labels = ids.select(F.map_from_entries(F.transform("all", lambda e: F.struct(e["k"], e["v"]))).alias("labels"))
    body = missions.agg(F.map_from_entries(F.collect_list(F.struct("mission", F.struct("flights")))).alias("missions")).crossJoin(F.broadcast(labels))  # one row each
    text = F.to_json(F.struct(F.struct(F.lit(5).alias("neighbor_frame_fps"), "labels").alias("metadata"), "missions"))
    return body.select(F.from_json(text, types.EXPORT).alias("d")).select("d.*")


@query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS flight_id, CAST(greatest(n_nationkey % 3, n_nationkey % 2) AS VARCHAR) AS mission_id, n_nationkey + 1 AS before, n_nationkey + 2 AS after, 5 AS stride,
  CAST(n_nationkey + 100 * k AS BIGINT) AS frame_id, n_name AS label, CAST(n_nationkey AS VARCHAR) AS track FROM nation, range(2) t(k)"""
)
def export_documents(spark, sf_dir):
    """An export's flights with their mission and window, and their label states."""
    flights = doc.export_flights(_export(spark, sf_dir))
    states = doc.frame_states(flights.select("flight_id", "labels"))
    return flights.drop("labels").join(states, "flight_id").select("flight_id", "mission_id", "before", "after", "stride", "frame_id", "label", "track")


@query("SELECT 'Q' || n_regionkey AS label, max(n_nationkey) AS class_id FROM nation GROUP BY n_regionkey")
def export_label_ids(spark, sf_dir):
    return doc.label_ids(_export(spark, sf_dir))


# --- pixels -----------------------------------------------------------------

BYTES = f"(SELECT img, x, y, CAST(trunc(greatest(v, 0) * 255) AS INTEGER) AS b FROM {A.PIXELS})"


@query(f"SELECT img, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CASE WHEN (x + y) % 3 = 0 THEN 0 ELSE b END AS red, CASE WHEN (x + y) % 3 = 0 THEN 0 ELSE 255 - b END AS green, CASE WHEN (x + y) % 3 = 0 THEN 0 ELSE 255 END AS alpha FROM {BYTES}")
def png_roundtrip(spark, sf_dir):
    """Images assembled from pixels, of which a third is absent, as PNG and back."""
    p = A.pixels(spark, sf_dir).withColumn("red", px.to_byte(F.greatest("v", F.lit(0.0))))
    p = p.filter((F.col("x") + F.col("y")) % 3 != 0).select("img", "x", "y", "red", (255 - F.col("red")).alias("green"), F.lit(7).alias("blue"), F.lit(255).alias("alpha"))
    images = png.images_from_pixels(p, "img", 8, 8, ("red", "green", "blue", "alpha"))
    back = png.decode_images(png.encode_images(images, "img"), key="img")
    out = px.image_pixels(back.select("img", "rgba"), "img", "rgba", 8, channels=4)
    return out.select("img", "x", "y", F.col("v0").alias("red"), F.col("v1").alias("green"), F.col("v3").alias("alpha"))


@query(f"SELECT img, x, y, {rs('b / CAST(255 AS DOUBLE)', 'soft')}, CASE WHEN b < 255 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS hard FROM {BYTES}")
def masks(spark, sf_dir):
    p = A.pixels(spark, sf_dir).withColumn("b", px.to_byte(F.greatest("v", F.lit(0.0))))
    return p.select("img", "x", "y", r(px.soft_mask(F.col("b")), "soft"), px.binary_mask(F.col("b")).alias("hard"))


@query(
    f"""WITH p AS {A.PIXELS} SELECT c.img, c.x, c.y, {rs('w.v + e.v + n.v + s.v - 4 * c.v', 'laplacian')} FROM p c LEFT JOIN p w ON w.img = c.img AND w.y = c.y AND w.x = c.x - 1
  LEFT JOIN p e ON e.img = c.img AND e.y = c.y AND e.x = c.x + 1 LEFT JOIN p n ON n.img = c.img AND n.x = c.x AND n.y = c.y - 1 LEFT JOIN p s ON s.img = c.img AND s.x = c.x AND s.y = c.y + 1"""
)
def laplacian_rows(spark, sf_dir):
    out = px.laplacian_of_rows(A.pixels(spark, sf_dir).select("img", "x", "y", "v"), ["img"], "v")
    return out.select("img", "x", "y", r(F.col("laplacian"), "laplacian"))


@query(f"SELECT img, {rs('''\"left\" + (\"right\" - \"left\") / 2.0 - 4.0''', 'dx')}, {rs('top + (bottom - top) / 2.0 - 4.0', 'dy')} FROM ({ORACLE_SQL['crop_borders']})")
def crop_center_delta(spark, sf_dir):
    p = A.pixels(spark, sf_dir).select("img", "x", "y", F.when(F.col("v") > 0.2, 1).otherwise(0).alias("q"))
    out = px.content_borders(p, "img", "q", 8, 8).withColumns(px.center_delta(8, 8))
    return out.select("img", r(F.col("dx"), "dx"), r(F.col("dy"), "dy"))


@query(
    f"""WITH p AS {A.PIXELS} SELECT c.img, c.x, c.y, {rs('w.v + e.v + n.v + s.v - 4 * c.v', 'laplacian')} FROM p c JOIN p w ON w.img = c.img AND w.y = c.y AND w.x = abs(c.x - 1)
  JOIN p e ON e.img = c.img AND e.y = c.y AND e.x = 7 - abs(7 - (c.x + 1)) JOIN p n ON n.img = c.img AND n.x = c.x AND n.y = abs(c.y - 1) JOIN p s ON s.img = c.img AND s.x = c.x AND s.y = 7 - abs(7 - (c.y + 1))"""
)
def laplacian_tiles(spark, sf_dir):
    """The Laplacian of every pixel, by tiles of three pixels with their border."""
    out = tl.tiled_laplacian(A.pixels(spark, sf_dir), "img", "v", 8, 8, size=3)
    return out.select("img", "x", "y", r(F.col("laplacian"), "laplacian"))


@query(ORACLE_SQL["laplacian_variance"])
def laplacian_variance_tiles(spark, sf_dir):
    out = tl.tiled_laplacian_variance(A.pixels(spark, sf_dir), "img", "v", 8, 8, size=5)
    return out.select("img", r(F.col("laplacian_variance"), "laplacian_variance"))


#: Boxes in a view of 64 x 64 pixels, drawn in the order of their lines.
DRAWN = f"""(SELECT frame_id, x, y, arg_max(class_id, line * 1000000 + track_id) AS class_id FROM (
  SELECT frame_id, line, track_id, class_id, x, unnest([y1, y2]) AS y FROM (SELECT *, unnest(range(x1, x2 + 1)) AS x FROM BOXES)
  UNION ALL SELECT frame_id, line, track_id, class_id, unnest([x1, x2]) AS x, y FROM (SELECT *, unnest(range(y1, y2 + 1)) AS y FROM BOXES)) WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63 GROUP BY frame_id, x, y)""".replace(
    "BOXES", f"(SELECT frame_id, line, track_id, class_id, x1 // 16 AS x1, y1 // 16 AS y1, x2 // 16 AS x2, y2 // 16 AS y2 FROM {CORNERS})"
)


@query(f"SELECT frame_id, count(*) AS pixels, sum(x * 64 + y)::BIGINT AS places, sum((x + 64 * y) * class_id)::BIGINT AS classes FROM {DRAWN} GROUP BY frame_id")
def drawn_labels(spark, sf_dir):
    """The outlines of every frame's boxes, the last on top, summed up by frame."""
    box = _corners(spark, sf_dir).select("frame_id", "line", "track_id", "class_id", *[F.expr(f"{c} div 16").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    lines = box.select("frame_id", "line", "track_id", "class_id", lb.quad_of(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("coords"))
    out = lb.drawn(lines, ["frame_id"], ["line", "track_id"], 64, 64)
    x, y = F.col("x"), F.col("y")
    return out.groupBy("frame_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum(x * 64 + y).cast("long").alias("places"), F.sum((x + 64 * y) * F.col("class_id")).cast("long").alias("classes"))


# --- geometry ---------------------------------------------------------------


@query(
    f"SELECT vid AS tid, {rs('x + 0.5', 'cx')}, {rs('y + 0.5', 'cy')}, vid % 3 = 0 AS is_flat FROM {A.VERTICES}"
)
def quad_flatness(spark, sf_dir):
    """Unit squares at the mesh's vertices, two of three with a corner lifted."""
    v = Vec3.of("x", "y", "z")
    lift = (F.col("vid") % 3).cast("double") * 0.25
    q = Quad(v, v + Vec3.of(1, 0, 0), v + Vec3(F.lit(1.0), F.lit(1.0), lift), v + Vec3.of(0, 1, 0))
    return A.vertices(spark, sf_dir).select(F.col("vid").alias("tid"), r(q.center.x, "cx"), r(q.center.y, "cy"), q.flat().alias("is_flat"))


@query(ORACLE_SQL["polyline_bbox"].replace("8 AS n FROM p", "CASE WHEN frame_id % 2 = 0 THEN 8 ELSE 10 END AS n FROM p"))
def polyline_bbox_of_rings(spark, sf_dir):
    """Rings of four or five corners, as texts, closed by their first one."""
    rows = _corners(spark, sf_dir)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    quad = lb.quad_of(x1, y1, x2, y2)
    ring = F.when(F.col("frame_id") % 2 == 0, quad).otherwise(F.concat(quad, F.array(x1, y2)))
    rows = rows.withColumn("ring", lb.without_closing_vertex(F.transform(F.concat(ring, F.array(x1, y1)), lambda v: v.cast("string"))))
    return rows.select("frame_id", "line", "track_id", *[c.alias(f"b{n}") for n, c in lb.polyline_box(F.col("ring")).items()], F.size("ring").alias("n"))


@query(ORACLE_SQL["nms_greedy"].replace("'x2': b.x2, 'y2': b.y2", "'x2': b.x1 + b.x2, 'y2': b.y1 + b.y2").replace("k.x2, b.x2", "k.x2, b.x1 + b.x2").replace("k.y2, b.y2", "k.y2, b.y1 + b.y2").replace("(b.x2 - b.x1) * (b.y2 - b.y1)", "b.x2 * b.y2"))
def nms_literal(spark, sf_dir):
    """Suppression with corners read as widths and heights."""
    boxes = _corners(spark, sf_dir).select("frame_id", "line", "track_id", "class_id", "x1", "y1", "x2", "y2")
    return lb.nms(boxes, ["frame_id"], ["line", "track_id", "class_id"], 0.3, literal=True).select("frame_id", "line", "track_id", "class_id", "x1", "y1", "x2", "y2")
