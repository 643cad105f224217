"""One file for each frame, whole or not at all.

``write_files`` hands rows (name, content) to a data source writer.  A task writes a
file beside its place, in a folder of its attempt, and moves it there when it is
whole, so a lost task leaves no part of a file under its name, and a repeated one
puts the same file there again.  Messages name the folders of attempts, which go
when the job commits or aborts.  A later run lists what is there and leaves it out,
before anything is computed for it.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = "_attempts"


def _system(path: str):
    """The file system of a path, as tasks open it, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = _system(self.path)
        attempt = posixpath.join(root, STAGING, uuid.uuid4().hex)
        made: set[str] = set()
        files = 0
        for name, content in rows:
            place = posixpath.join(root, name)
            if posixpath.normpath(place) == root or not posixpath.normpath(place).startswith(root.rstrip("/") + "/"):
                raise ValueError(f"{name!r} is not a name below {root}")
            for folder in {attempt, posixpath.dirname(place)} - made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            part = posixpath.join(attempt, str(files))
            with system.open_output_stream(part) as out:
                out.write(bytes(content) if content is not None else b"")
            system.move(part, place)
            files += 1
        return Written(attempt, files)

    def _clear(self, messages: list) -> None:
        system, root = _system(self.path)
        for m in messages:
            if m is not None and m.files:
                system.delete_dir(m.attempt)
        staging = posixpath.join(root, STAGING)
        if system.get_file_info(staging).type.name == "Directory":
            system.delete_dir(staging)  # with what lost attempts left

    def commit(self, messages: list) -> None:
        self._clear(messages)

    def abort(self, messages: list) -> None:
        self._clear(messages)


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def finished(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(name) of the files under a path that have an ending, without it; none if the
    path does not exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "name string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").option("recursiveFileLookup", "true").load(path).select("path")
    inside = F.substring_index("path", path.split(":", 1)[-1].strip("/") + "/", -1)
    return files.select(F.substring(inside, F.lit(1), F.length(inside) - len(ending)).alias("name"))


def write_files(rows: DataFrame, name: Column, content: Column, path: str, ending: str, resume: bool = True) -> None:
    """One file ``{name}{ending}`` under ``path`` for each row; with ``resume`` rows whose
    file exists are left out."""
    spark = rows.sparkSession
    spark.dataSource.register(FrameFiles)
    if resume:
        key = "name__"
        rows = rows.withColumn(key, name).join(finished(spark, path, ending).withColumnRenamed("name", key), key, "left_anti")
        name = F.col(key)
    out = rows.select(F.concat(name, F.lit(ending)).alias("name"), content.cast("binary").alias("content"))
    out.write.format("frame_files").mode("append").option("path", path).save()


def write_label_files(boxes: DataFrame, name: Column, path: str, resume: bool = True) -> None:
    """``{name}.txt`` for each frame, with a line ``class xc yc w h`` for each box, by class
    and place."""
    values = ("class_id", "xc", "yc", "w", "h")
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in values])
    lines = boxes.select(name.alias("name"), F.struct(*values, line.alias("line")).alias("b")).groupBy("name").agg(F.array_sort(F.collect_list("b")).alias("all"))
    text = F.concat(F.array_join(F.transform("all", lambda b: b["line"]), "\n"), F.lit("\n"))
    write_files(lines, F.col("name"), text, path, ".txt", resume)


def write_track_files(boxes: DataFrame, by: list[str], name: Column, path: str, resume: bool = True) -> None:
    """``{name}.json`` for each frame: its tracks with class and boxes."""
    from .documents import track_json

    write_files(track_json(boxes, by), name, F.col("json"), path, ".json", resume)


def write_image_files(images: DataFrame, name: Column, path: str, resume: bool = True) -> None:
    """``{name}.png`` for each image (width, height, rgba)."""
    from . import png

    key = "name__"
    named = images.select(name.alias(key), "width", "height", "rgba")
    if resume:
        named = named.join(finished(images.sparkSession, path, ".png").withColumnRenamed("name", key), key, "left_anti")
    write_files(png.encode_images(named, key), F.col(key), F.col("content"), path, ".png", False)
