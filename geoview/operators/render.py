"""Composed operators: labels of a batch, and integral, focus and shutter renders.

They join what the other operators give: poses, corrections, windows of
neighbours, rays on the mesh, samples of shots and sums over them.  A scene, the
unit that is rendered, is any set of key columns; all of its work meets in
equi-joins on these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import POSITIONING_MODES, RESULT_MODES, IntegralSettings, PipelineSettings, RenderSettings
from ..functions import camera as cam
from ..functions.geometry import Transform, nearest_int
from ..functions.vec import Number, Quat, Vec3
from . import frames as fr
from . import labels as lb
from . import lookups as lk
from . import pixels as px
from .raycast import RAY, hits_of, raycast

POSE = ("cam_x", "cam_y", "cam_z", "rot_x_deg", "rot_y_deg", "rot_z_deg", "fovy")
CORRECTION = ("tx", "ty", "tz", "rx", "ry", "rz")
#: What the view over a frame takes of its pose.
VIEWED = ("cam_x", "cam_y", "cam_z")
#: A block of frames is at least so many reaches of the window, and so many frames, wide.
BLOCK_REACHES, BLOCK_FRAMES = 8, 256
#: Blocks are dealt to so many times the tasks of a shuffle: a label that arrives there
#: is a ray for each corner and each frame of its window.
BLOCK_TASKS = 4


def _vec(names: list[str] | tuple[str, ...]) -> Vec3:
    return Vec3.of(*names)


def pixel_rays(rows: DataFrame, camera: cam.Camera, x: Column, y: Column, width: int, height: int, distortion: tuple[Vec3, Number, Number] | None = None, focal: tuple[Number, Number, Number, Number] = (1.0, 1.0, 0.0, 0.0)) -> DataFrame:
    """``rows`` with rays ox..dz through their pixels; with a distortion (k1 to k3,
    p1, p2) and the camera's fx, fy, cx, cy, pixels are undistorted first."""
    if distortion is not None:
        fx, fy, cx, cy = focal
        u, v = cam.undistorted(x, y, *distortion, fx, fy, cx, cy)
        rows = rows.withColumns({"ux__": u * fx + cx, "uy__": v * fy + cy})
        x, y = F.col("ux__"), F.col("uy__")
    o, d = camera.ray(x, y, width, height)
    return rows.select("*", *o.columns("o"), *d.columns("d")).drop("ux__", "uy__")


def project_labels(labels: DataFrame, triangles: DataFrame, keys: list[str], shot: cam.Camera, view: cam.Camera, view_columns: list[str], shot_size: tuple[int, int], view_size: tuple[int, int], corners: str = "corners", ensure_int: bool = True, by: list[str] | None = None) -> DataFrame:
    """(keys, x1, y1, x2, y2, n_hits): labels seen by ``shot``, as ``view`` sees them.

    Every corner (x, y) of a label is cast on the mesh, or on the one of its ``by``
    columns, and projected again; the box encloses those that hit, and a label of
    which none does has no row.  ``keys`` name one label; cameras are columns of
    ``labels``, those of the view ``view_columns``.  Where the mesh is broadcast, rows
    that are dealt by some of ``keys`` stay in their tasks.
    """
    points = labels.select(*labels.columns, F.posexplode(corners).alias("n__", "at__")).drop(corners)
    points = points.withColumns({"atx__": F.col("at__.x"), "aty__": F.col("at__.y")}).drop("at__")
    rays = pixel_rays(points, shot, F.col("atx__").cast("double"), F.col("aty__").cast("double"), *shot_size)
    ids = [*keys, "n__", "atx__", "aty__"]
    named = list(dict.fromkeys([*ids, *(by or []), *view_columns]))
    hits = hits_of(rays.select(*named, *RAY), triangles, by)
    # Each hit is projected before the nearest is taken: an aggregate of plain numbers.
    hits = hits.select(*named, "t", *[(F.col(f"o{c}") + F.col("t") * F.col(f"d{c}")).alias(c) for c in "xyz"])
    u, v = view.world_to_pixel(_vec("xyz"), *view_size, ensure_int=ensure_int)
    seen = hits.select(*ids, "t", u.alias("u__"), v.alias("v__")).groupBy(*ids).agg(F.min_by("u__", "t").alias("u__"), F.min_by("v__", "t").alias("v__"))
    return seen.groupBy(*keys).agg(F.min("u__").alias("x1"), F.min("v__").alias("y1"), F.max("u__").alias("x2"), F.max("v__").alias("y2"), F.count(F.lit(1)).alias("n_hits"))


def frame_corrections(frames: DataFrame, corrections: DataFrame, default: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """``frames`` with the CORRECTION columns of each: of the first interval that
    holds it, among those of its flight if corrections name one, or else the
    default, which may be a row for each flight."""
    by = ["flight_id"] if "flight_id" in corrections.columns else []
    own = None if isinstance(default, DataFrame) else {c: 0.0 for c in CORRECTION} | (default or {})
    out = lk.interval_lookup(frames, corrections, {"pos": None, **(own or {})}, by=by).drop("pos")
    if own is not None:
        return out
    side = default.select("flight_id", *[F.col(c).alias(f"{c}__") for c in CORRECTION])
    return out.join(side, "flight_id", "left").withColumns({c: F.coalesce(c, f"{c}__", F.lit(0.0)) for c in CORRECTION}).drop(*[f"{c}__" for c in CORRECTION])


def output_name(rotation: Column | None = None) -> Column:
    """``{flight}_{frame}``, with the rotation, its point as ``_``, where it is not 0."""
    name = F.concat_ws("_", F.col("flight_id").cast("string"), F.col("frame_id").cast("string"))
    if rotation is None:
        return name
    return F.when(rotation == 0, name).otherwise(F.concat_ws("_", name, F.replace(rotation.cast("string"), F.lit("."), F.lit("_"))))


def batch_frames(frames: DataFrame, settings: PipelineSettings, done: DataFrame | None = None) -> DataFrame:
    """The central frames of a batch, with rotation_nr, rotation and the name of what
    is made of them.

    Flights of exclude_flights are left out, and the first initial_skip frames of each
    flight.  Each frame has rotation 0 and additional_rotations random ones; names
    in ``done`` (name) are left out.
    """
    s = settings
    if s.exclude_flights:
        frames = frames.filter(~F.col("flight_id").cast("string").isin(*s.exclude_flights))
    if s.initial_skip > 0:
        # The ids that are skipped are a few for each flight.
        least = F.row_number().over(Window.partitionBy("flight_id").orderBy("frame_id"))
        skipped = frames.select("flight_id", "frame_id", least.alias("n__")).filter(F.col("n__") <= s.initial_skip).drop("n__")
        frames = frames.join(skipped, ["flight_id", "frame_id"], "left_anti")
    if s.additional_rotations > 0:
        out = fr.random_rotations(frames, s.rotation_radians, s.additional_rotations, s.rotation_seed)
    else:
        out = frames.withColumns({"rotation_nr": F.lit(0), "rotation": F.lit(0.0)})
    out = out.withColumn("name", output_name(F.col("rotation")))
    return out if done is None else lk.pending(out, done.select("name"), ["name"])


def _met_by_frame(central: DataFrame, labels: DataFrame) -> DataFrame:
    """Central frames with their own labels, dealt by frame."""
    own = central.withColumns({"neighbour_id": F.col("frame_id"), "phase": F.lit(0), **{f"n_{c}": F.col(c) for c in POSE}})
    labels = labels.withColumnRenamed("neighbour_id", "frame_id")
    return own.drop(*(c for c in POSE if c not in VIEWED)).join(labels, [c for c in ("flight_id", "frame_id") if c in labels.columns])


def _met_by_block(frames: DataFrame, central: DataFrame, labels: DataFrame, before: int, after: int, stride: int) -> DataFrame:
    """Central frames with the labels of their windows, dealt by ``task__``.

    Frames and labels are dealt once, by blocks of frames; those near a border also go to
    the next block.  A running list of central frames, which are light, goes along the
    frames of a block, and each label is multiplied by its frame's list in the task that
    also takes the window's boxes together.
    """
    lo, hi = max(before, 0), max(after, 0)
    width = max(BLOCK_REACHES * max(lo, hi), BLOCK_FRAMES)
    tasks = BLOCK_TASKS * int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [c for c in ("flight_id",) if c in labels.columns]
    block = lambda c: F.expr(f"cast({c} as bigint) div {width}")
    near = F.explode(F.sequence(block(f"neighbour_id - {hi}"), block(f"neighbour_id + {lo}"))).alias("block__")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("task__", F.pmod(F.hash(*by, "block__"), F.lit(tasks))).repartitionById(tasks, "task__")

    pose = F.struct(*[F.col(c).alias(f"n_{c}") for c in POSE]).alias("pose__")
    one = F.struct("frame_id", *[c for c in central.columns if c not in ("flight_id", "frame_id", *POSE) or c in VIEWED]).alias("one__")
    there = frames.select("flight_id", F.col("frame_id").alias("neighbour_id"), pose).select("*", near)
    asking = central.select("flight_id", F.col("frame_id").alias("neighbour_id"), one, block("frame_id").alias("block__"))
    both = dealt(there.unionByName(asking, allowMissingColumns=True)).withColumns({"at__": F.col("neighbour_id").cast("long"), "rest__": F.pmod("neighbour_id", F.lit(stride))})
    around = Window.partitionBy("task__", "flight_id", "block__", "rest__").orderBy("at__").rangeBetween(-hi, lo)
    asked = both.withColumn("all__", F.collect_list("one__").over(around)).filter(F.col("pose__").isNotNull())
    asked = asked.select("task__", "block__", "flight_id", "neighbour_id", "pose__", "all__")
    if by:  # equal types have equal hashes
        labels = labels.withColumn("flight_id", F.col("flight_id").cast(frames.schema["flight_id"].dataType))
    met = dealt(labels.select("*", near)).join(asked, ["task__", "block__", *by, "neighbour_id"]).withColumn("one__", F.explode("all__"))
    n, f = F.col("neighbour_id"), F.col("one__.frame_id")
    met = met.filter((n == f) | n.between(f - before, f + after))
    rest = [c for c in labels.columns if c not in ("neighbour_id", *by)]
    return met.select("task__", "flight_id", "neighbour_id", *rest, "pose__.*", "one__.*", F.when(n == f, 0).when(n < f, 1).otherwise(2).alias("phase"))


def _met_by_pairs(frames: DataFrame, central: DataFrame, labels: DataFrame, before: Column | int, after: Column | int, stride: Column | int) -> DataFrame:
    """The same where reach or stride are columns, dealt by neighbour."""
    window = frames.select("flight_id", "frame_id", F.col("frame_id").alias("neighbour_id"), F.lit(0).alias("phase")).unionByName(lk.neighbours(frames, before, after, stride))
    poses = frames.select("flight_id", F.col("frame_id").alias("neighbour_id"), *[F.col(c).alias(f"n_{c}") for c in POSE])
    asked = window.join(central.drop(*(c for c in POSE if c not in VIEWED)), ["flight_id", "frame_id"])
    return asked.join(poses, ["flight_id", "neighbour_id"]).join(labels, [c for c in ("flight_id", "neighbour_id") if c in labels.columns])


def batch_labels(
    frames: DataFrame, labels: DataFrame, corrections: DataFrame, triangles: DataFrame, settings: PipelineSettings,
    before: Column | int, after: Column | int, stride: Column | int, default: dict[str, float] | DataFrame | None = None, ensure_int: bool = True,
    done: DataFrame | None = None,
) -> DataFrame:
    """(flight_id, frame_id, track_id, class_id, xc, yc, w, h): the batch's labels, with
    rotation_nr, rotation and name where there are additional rotations.

    A frame is a flight and a number within it.  ``frames`` has flight_id, frame_id and
    a pose; ``labels`` flight_id, frame_id, line, class_id, corners in pixels and, if
    labels belong to tracks, track_id; ``corrections`` pos, lo, hi, CORRECTION columns
    and flight_id, unless they hold for all flights; ``triangles`` may have a flight_id
    too.  Labels without flight_id are those of the one frame of their number.
    Labels of a frame's neighbours, or with merge_labels off or project_orthogonal
    on of itself alone, are cast through their own frame's pose under the central
    frame's correction, and projected into an orthographic view over it, turned by the
    rotation.  Boxes of a track merge, each label without tracks is a box of its own;
    those fully outside drop, and overlaps with apply_nms.

    Labels are shuffled once, to where their frames are; with a constant reach all that
    follows is in the same tasks, as long as the mesh is broadcast.
    """
    s = settings
    turned = s.additional_rotations > 0
    names = ["rotation_nr", "rotation", "name"] if turned else []
    central = batch_frames(frame_corrections(frames, corrections, default), s, done)
    central = central.select("flight_id", "frame_id", *POSE, *CORRECTION, *names)
    tracked = "track_id" in labels.columns
    if not tracked:
        labels = labels.withColumn("track_id", F.col("line"))
    # Two arrays of numbers are a third of an array of structs.
    flat = [F.col(f"corners.{c}").alias(f"{c}s__") for c in "xy"]
    labels = labels.select(*[c for c in ("flight_id",) if c in labels.columns], F.col("frame_id").alias("neighbour_id"), "line", "track_id", "class_id", *flat)
    if not (s.merge_labels and tracked and not s.project_orthogonal):
        rows = _met_by_frame(central, labels)
    elif all(isinstance(v, int) for v in (before, after, stride)):
        rows = _met_by_block(frames, central, labels, before, after, stride)
    else:
        rows = _met_by_pairs(frames, central, labels, before, after, stride)
    rows = rows.withColumn("corners", F.arrays_zip(F.col("xs__").alias("x"), F.col("ys__").alias("y"))).drop("xs__", "ys__")
    position, degrees = _vec([f"n_cam_{c}" for c in "xyz"]), _vec([f"n_rot_{c}_deg" for c in "xyz"])
    shot = cam.frame_camera(position, degrees, "n_fovy", _vec(("tx", "ty", "tz")), _vec(("rx", "ry", "rz")))
    above = _vec(("cam_x", "cam_y", "cam_z")) + _vec(("tx", "ty", "tz")) + Vec3.of(0, 0, s.camera_distance)
    pose = Transform(above, Quat.about("z", F.col("rotation"))) if turned else Transform(above)
    view = cam.Camera.orthographic(pose, s.ortho_width, s.ortho_height)
    frame = ["flight_id", "frame_id", *names]
    task = [c for c in ("task__",) if c in rows.columns]
    keys = [*task, *frame, "track_id", "class_id", "phase", "neighbour_id", "line"]
    size = (s.render_width, s.render_height)
    mesh_by = ["flight_id"] if "flight_id" in triangles.columns else None
    boxes = project_labels(rows, triangles, keys, shot, view, [*VIEWED, "tx", "ty", "tz"], (s.input_width, s.input_height), size, ensure_int=ensure_int, by=mesh_by)
    tracks = lb.track_boxes(boxes, [*task, *frame, "track_id"], ["phase", "neighbour_id", "line", "class_id"]).drop(*task)
    if s.apply_nms:
        tracks = lb.nms(tracks, frame, ["track_id"], s.nms_iou)
    shown = tracks.withColumn("box__", lb.box_yolo(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], *size)).filter(F.col("box__").isNotNull())
    return shown.select(*frame, "track_id", "class_id", "box__.*")


def view_points(scenes: DataFrame, keys: list[str], camera: cam.Camera, width: int, height: int, triangles: DataFrame) -> DataFrame:
    """(keys, rx, ry, x, y, z): where the centre of each pixel of a scene's view
    meets the mesh; pixels that miss it are absent."""
    cells = scenes.withColumn("cell__", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))))
    cells = cells.withColumns({"rx": (F.col("cell__") % width).cast("int"), "ry": F.expr(f"cast(cell__ div {width} as int)")})
    rays = pixel_rays(cells, camera, F.col("rx") + 0.5, F.col("ry") + 0.5, width, height)
    hits = raycast(rays.withColumn("ray_id", F.struct(*keys, "rx", "ry")), triangles)
    return hits.select("ray_id.*", "x", "y", "z")


def render_integral(
    points: DataFrame, shots: DataFrame, keys: list[str], project: Callable[[], tuple[Column, Column, Column]], pixels: DataFrame, size: tuple[int, int],
    channels: tuple[str, ...], settings: IntegralSettings, background: DataFrame | None = None, camera: cam.Camera | None = None, bounds: dict[str, float] | None = None,
) -> DataFrame:
    """(keys, rx, ry, channels, overlap): the scene's shots integrated at its points.

    Channels are 0..1: sums over an overlap of more than alpha_threshold, then
    stretched together if auto_contrast holds.  With add_background, pixels of
    ``background`` (keys, rx, ry, channels) stand where there is no overlap.  With the
    shots' ``camera``, points (gx, gy, gz) and shots meet by the cells of footprints.
    """
    seen = px.sample_shots(points, shots, project, keys, pixels, *size, camera=camera, bounds=bounds)
    at = [*keys, "rx", "ry"]
    out = px.integral(seen, at, channels, threshold=settings.alpha_threshold)
    if settings.auto_contrast:
        out = px.auto_contrast(out, keys, channels)
    if background is None or not settings.add_background:
        return out
    under = background.select(*at, *[F.col(c).alias(f"{c}_under__") for c in channels])
    both = under.join(out, at, "full")
    return both.select(*at, *[F.coalesce(c, f"{c}_under__").alias(c) for c in channels], F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def project_shots(
    points: DataFrame, shots: DataFrame, keys: list[str], project: Callable[[], tuple[Column, Column, Column]], pixels: DataFrame, size: tuple[int, int],
    channels: tuple[str, ...], mode: str = "Complete", background: DataFrame | None = None, shot: str = "shot_id", alpha: str = "a", camera: cam.Camera | None = None, bounds: dict[str, float] | None = None,
) -> DataFrame:
    """(keys, shot, rx, ry, channels): an image for each shot of a scene.

    ``ShotOnly`` has the pixels that the shot covers; ``Complete`` has every pixel of the
    background (keys, rx, ry, channels), with the shot's over it by their alpha.
    """
    if mode not in RESULT_MODES:
        raise ValueError(f"{mode!r} is none of {RESULT_MODES}")
    seen = px.sample_shots(points, shots, project, keys, pixels, *size, camera=camera, bounds=bounds).select(*keys, shot, "rx", "ry", *channels, alpha)
    if mode == "ShotOnly":
        return seen.drop(alpha)
    if background is None:
        raise ValueError("a complete image needs a background")
    over = seen.withColumnsRenamed({c: f"{c}_over__" for c in (*channels, alpha)})
    every = background.select(*keys, "rx", "ry", *channels).join(shots.select(*keys, shot).distinct(), keys)
    both = every.join(over, [*keys, shot, "rx", "ry"], "left")
    mixed = [F.coalesce(px.overlay(F.col(c), F.col(f"{c}_over__"), F.col(f"{alpha}_over__")), F.col(c)).alias(c) for c in channels]
    return both.select(*keys, shot, "rx", "ry", *mixed)


def scene_camera(shots: DataFrame, order: str, box: DataFrame, settings: RenderSettings, rotation: Quat | None = None, ortho: bool = True) -> tuple[DataFrame, cam.Camera]:
    """One row (vx, vy, vz, view_width, view_height) and the camera that it describes.

    The position follows positioning_mode, raised by camera_dist; an orthographic view
    without ortho_size is as wide and high as the mesh's box, in whole numbers.
    ``shots`` has x, y, z in the order of a unique column, ``box`` is what ``aabb_of``
    gives of the mesh.
    """
    if settings.positioning_mode not in POSITIONING_MODES:
        raise ValueError(f"{settings.positioning_mode!r} is none of {POSITIONING_MODES}")
    at = fr.camera_positions(shots, order, settings.camera_dist, box).filter(F.col("mode") == settings.positioning_mode)
    size = [F.lit(float(v)) for v in settings.ortho_size] if settings.ortho_size else [nearest_int(F.col(f"max_{c}") - F.col(f"min_{c}")).cast("double") for c in "xy"]
    sized = box.select(size[0].alias("view_width"), size[1].alias("view_height"))
    row = at.select(*[F.col(c).alias(f"v{c}") for c in "xyz"]).crossJoin(F.broadcast(sized))  # one row each
    pose = Transform(_vec(("vx", "vy", "vz")), rotation) if rotation is not None else Transform(_vec(("vx", "vy", "vz")))
    if ortho:
        return row, cam.Camera.orthographic(pose, "view_width", "view_height")
    return row, cam.Camera.perspective(pose, settings.fovy)


def focus_shots(shots: DataFrame, plan: DataFrame, z: str = "cam_z") -> DataFrame:
    """Every shot in every frame of a focus plan, moved against its focus.  The
    plan has one row for each frame of the animation."""
    steps = plan.agg(F.array_sort(F.collect_list(F.struct(F.col("frame").alias("focus"), F.col("z").alias("at")))).alias("steps__"))
    rows = shots.crossJoin(F.broadcast(steps))  # one row
    return rows.select("*", F.explode("steps__").alias("s__")).withColumns({"focus": F.col("s__.focus"), z: F.col(z) - F.col("s__.at")}).drop("steps__", "s__")


def shutter_sums(plan: DataFrame, shots: DataFrame, order: str, values: list[str]) -> DataFrame:
    """``plan`` (frame, first, last) with the sums of ``values`` over shots
    first..last-1 in the order of a unique column.

    Sums up to each shot come from one pass over ranges of shots; a frame takes
    the difference of two of them, by equi-joins, however long its exposure is.
    """
    ranked = fr.ranked(shots.select(order, *values), order).withColumn("range__", F.expr(f"rank__ div {fr.RANGE}"))
    within = Window.partitionBy("range__").orderBy("rank__")
    ahead = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("range__").agg(*[F.sum(v).alias(v) for v in values])
    starts = starts.select("range__", *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"{v}_start__") for v in values])
    upto = ranked.select("rank__", "range__", *[F.sum(v).over(within).alias(v) for v in values]).join(starts, "range__")
    upto = upto.select((F.col("rank__") + 1).alias("end__"), *[(F.col(v) + F.col(f"{v}_start__")).alias(v) for v in values])
    out = plan
    for side in ("last", "first"):
        sums = upto.select(F.col("end__").alias(side), *[F.col(v).alias(f"{v}_{side}__") for v in values])
        out = out.join(sums, side, "left")
    return out.select(*plan.columns, *[(F.coalesce(f"{v}_last__", F.lit(0)) - F.coalesce(f"{v}_first__", F.lit(0))).alias(v) for v in values])
