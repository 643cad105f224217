"""JSON and text documents: poses, export configurations, corrections, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import types
from ..functions.vec import Quat, Vec3
from .json_array import RANGE_BYTES, read_json_array


def file_key(path: Column) -> tuple[Column, Column]:
    """Flight and frame of a name like ``{flight}_{frame}.png``."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(name, "_")
    return F.get(parts, F.lit(0)), F.get(F.split(F.get(parts, F.lit(1)), r"\."), F.lit(0)).try_cast("bigint")


def is_image(path: Column) -> Column:
    """Names that end in .png or .jpg, in small letters."""
    return path.rlike(r"\.(png|jpg)$")


def image_listing(spark: SparkSession, directory: str, flight: str | None = None) -> DataFrame:
    """(path, flight_id, frame_id) of image files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg}").load(directory).select("path")
    flight_id, frame_id = file_key(F.col("path"))
    out = files.select("path", flight_id.alias("flight_id"), frame_id.alias("frame_id"))
    return out if flight is None else out.filter(F.col("flight_id") == flight)


def read_poses(spark: SparkSession, path: str, count: int | None = None, fovy: float = 50.0, image_dir: str | None = None, flight_id: str | None = None) -> DataFrame:
    """(flight_id, frame_id, image, location, rotation, quaternion, fovy); the
    position in the document is the frame id.

    Of aliases the first present wins.  A rotation of three numbers is in
    degrees (applied as z, y, x), one of four a quaternion; other lengths, and a
    missing file, location or rotation, raise an error.
    """
    return poses_of(spark.read.schema(types.POSES).json(path, multiLine=True), F.lit(flight_id), count, fovy, image_dir)


def poses_of(docs: DataFrame, flight_id: Column, count: int | None = None, fovy: float = 50.0, image_dir: str | None = None) -> DataFrame:
    """The same from documents that are rows with a column ``images``."""
    images = F.col("images") if count is None else F.slice("images", 1, count)
    return _poses(docs.select(flight_id.alias("flight_id"), F.posexplode(images).alias("frame_id", "i")), fovy, image_dir)


def read_large_poses(spark: SparkSession, path: str, fovy: float = 50.0, image_dir: str | None = None, flight_id: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As ``read_poses``, of one document that many tasks read by ranges of bytes."""
    image = StructType.fromDDL(types.POSES)["images"].dataType.elementType
    found = read_json_array(spark, path, "images", range_bytes)
    return _poses(found.select(F.lit(flight_id).alias("flight_id"), F.col("position").alias("frame_id"), F.from_json("value", image).alias("i")), fovy, image_dir)


def _poses(rows: DataFrame, fovy: float, image_dir: str | None) -> DataFrame:
    """From rows (flight_id, frame_id, i), an image of the document each."""
    need = lambda c, what: F.when(c.isNull(), F.raise_error(F.lit(f"a pose has no {what}")).cast("array<double>")).otherwise(c)
    file = F.coalesce("i.imagefile", "i.file", "i.image")
    rotation = need(F.coalesce("i.rotation", "i.rot", "i.quaternion"), "rotation")
    angle = F.coalesce("i.fovy", "i.fov", "i.fieldofview")
    angle = F.coalesce(F.get(F.from_json(angle, "array<double>"), F.lit(0)), angle.try_cast("double"), F.lit(fovy))
    rows = rows.select(
        "flight_id",
        F.col("frame_id").cast("bigint").alias("frame_id"),
        F.when(file.isNull(), F.raise_error(F.lit("a pose has no file")).cast("string")).otherwise(F.concat(F.lit(f"{image_dir.rstrip('/')}/" if image_dir else ""), file)).alias("image"),
        need(F.coalesce("i.location", "i.pos", "i.loc"), "location").alias("location"),
        rotation.alias("rotation"),
        angle.alias("fovy"),
    )
    return rows.withColumn("quaternion", rotation_quaternion(F.col("rotation")))


def rotation_quaternion(rotation: Column) -> Column:
    """Three degrees or four quaternion parts as a quaternion."""
    degrees = Vec3(*[F.radians(F.get(rotation, F.lit(i))) for i in range(3)])
    wrong = F.raise_error(F.lit("a rotation has 3 or 4 numbers")).cast("array<double>")
    return F.when(F.size(rotation) == 4, rotation).when(F.size(rotation) == 3, Quat.from_eulers(degrees, "zyx").array()).otherwise(wrong)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(types.EXPORT).json(path, multiLine=True)


def export_flights(export: DataFrame) -> DataFrame:
    """(flight_id, mission_id, before, after, stride, labels); where a flight is
    in several missions, the last by mission name holds."""
    m = export.select("metadata.neighbor_frame_fps", F.explode("missions").alias("mission_id", "mission"))
    f = m.select("neighbor_frame_fps", "mission_id", F.explode("mission.flights").alias("flight_id", "flight"))
    last = f.groupBy("flight_id").agg(F.max_by(F.struct("mission_id", "flight", "neighbor_frame_fps"), "mission_id").alias("l"))
    return last.select(
        "flight_id", "l.mission_id", F.col("l.flight.nr_of_frames_before_current").alias("before"), F.col("l.flight.nr_of_frames_after_current").alias("after"),
        F.col("l.neighbor_frame_fps").alias("stride"), F.col("l.flight.labels").alias("labels"),
    )


def frame_states(flights: DataFrame) -> DataFrame:
    """(flight_id, frame_id, label_key, coordinates, label, track)."""
    by_label = flights.select("flight_id", F.explode("labels").alias("label_key", "frames"))
    return by_label.select("flight_id", "label_key", F.explode("frames").alias("frame", "s")).select("flight_id", F.col("frame").cast("bigint").alias("frame_id"), "label_key", "s.*")


def label_ids(export: DataFrame) -> DataFrame:
    """(label, class_id): id -> label inverted; of ids with one label the last
    in the document's order holds."""
    rows = export.select(F.posexplode(F.map_entries("metadata.labels")).alias("pos", "e"))
    return rows.groupBy(F.col("e.value").alias("label")).agg(F.max_by(F.col("e.key"), "pos").cast("int").alias("class_id"))


def _interval(c: str) -> list[Column]:
    return [F.col(f"{c}.start frame").alias("lo"), F.col(f"{c}.end frame").alias("hi"), *[F.col(f"{c}.{k}.{a}").alias(f"{p}{a}") for k, p in (("translation", "t"), ("rotation", "r")) for a in "xyz"]]


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(flight_id, pos, lo, hi, tx..rz) of one file for all flights; a flight
    that is not in it has no rows."""
    return corrections_of(spark.read.schema(types.CORRECTIONS).json(path, multiLine=True))


def corrections_of(docs: DataFrame) -> DataFrame:
    """The same from documents that are rows with a column ``corrections``."""
    docs = docs.select(F.explode("corrections").alias("flight_id", "all"))
    return docs.select("flight_id", F.posexplode("all").alias("pos", "c")).select("flight_id", "pos", *_interval("c"))


def read_flight_corrections(spark: SparkSession, path: str, flight_id: str) -> tuple[DataFrame, DataFrame]:
    """Corrections and the default of one flight's file, which holds either
    ``corrections`` and ``default`` or just the default."""
    return flight_corrections_of(spark.read.schema(types.FLIGHT_CORRECTIONS).json(path, multiLine=True).withColumn("flight_id", F.lit(flight_id)))


def flight_corrections_of(doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from rows with a flight_id and the fields of such a file."""
    rows = doc.select("flight_id", F.posexplode("corrections").alias("pos", "c")).select("flight_id", "pos", *_interval("c"))
    parts = [F.coalesce(F.col(f"default.{k}.{a}"), F.col(f"{k}.{a}"), F.lit(0.0)).alias(f"{p}{a}") for k, p in (("translation", "t"), ("rotation", "r")) for a in "xyz"]
    return rows, doc.select("flight_id", *parts)


def yolo_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """Boxes of lines of exactly five tokens; others are ignored."""
    t = F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")
    rows = lines.withColumn("t__", t).filter(F.size("t__") == 5)
    names = ("xc", "yc", "w", "h")
    return rows.select("*", F.get("t__", F.lit(0)).cast("double").cast("int").alias("class_id"), *[F.get("t__", F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(names)]).drop("t__", value)


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    flight, frame = file_key(F.col("_metadata.file_path"))
    return yolo_rows(spark.read.text(path).select("value", flight.alias("flight_id"), frame.alias("frame_id")))


def legacy_labels(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, points) from the older label documents."""
    rows = spark.read.schema(types.LEGACY_LABELS).json(path, multiLine=True).select(F.explode("states").alias("s"))
    return rows.select(F.col("s.frameIdx").cast("bigint").alias("frame_id"), F.col("s.pxlCoordinates").alias("points"))


def yolo_lines(boxes: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in ("class_id", "xc", "yc", "w", "h")])


def write_yolo(boxes: DataFrame, path: str, partition_by: tuple[str, ...] = ("split", "frame_id")) -> None:
    """One text file or more for each split and frame."""
    boxes.select(*partition_by, yolo_lines(boxes).alias("value")).write.partitionBy(*partition_by).text(path)


def track_json(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by, json): {track: {animal_class, axis_aligned_bbs}}."""
    body = F.struct(F.col("class_id").alias("animal_class"), F.array("x1", "y1", "x2", "y2").alias("axis_aligned_bbs"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("track_id").cast("string").alias("k"), body.alias("v"))))
    return boxes.groupBy(*by).agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def checkerboard(spark: SparkSession, tiles: int, size: int, color: tuple, other: tuple) -> DataFrame:
    """(x, y, c0..) of a checkerboard; no rows if tiles or size is 0."""
    if len(color) != len(other):
        raise ValueError("both colours need as many components")
    side = tiles * size
    cells = spark.range(side * side).select((F.col("id") % max(side, 1)).cast("int").alias("x"), F.floor(F.col("id") / max(side, 1)).cast("int").alias("y"))
    even = F.pmod(F.floor(F.col("x") / max(size, 1)) + F.floor(F.col("y") / max(size, 1)), F.lit(2)) == 0
    return cells.select("x", "y", *[F.when(even, F.lit(a)).otherwise(F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate(zip(color, other))])


def file_names(number: Column, kind: str, prefix: str | None = None, suffix: str | None = None) -> Column:
    parts = [F.lit(prefix)] * (prefix is not None) + [number.cast("string")] + [F.lit(suffix)] * (suffix is not None)
    return F.concat(F.concat_ws("_", *parts), F.lit(f".{kind}"))
