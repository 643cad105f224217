"""Token-ID output: Parquet list columns with selective reads.

``write_token_files`` encodes whole texts and writes one row per document, in
ascending order of its id across and within files: the id column, ``part`` (the
file's number), ``first`` (ids in the file before it), ``n_tokens`` and ``ids``,
a list of 32-bit integers.  All numbers are delta-encoded (Parquet v2 pages);
row groups and pages have set sizes and carry page indexes, so a reader of some documents or of the counts
alone skips the id pages.

Edge cases: a null or empty text has only the end id; null ids come first; rows
with equal ids stand next to each other, in an order that follows from their
texts, and many of one id lie in several files; an empty table
gives an empty set of files; other columns are not written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidied
from .tokens import encoder

#: Ids are near uniform over a vocabulary: a dictionary of them saves nothing
#: over packed deltas and costs a lookup for each.
FILE_OPTIONS = {
    "parquet.enable.dictionary": "false",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}
TWO_LEVELS = "spark.sql.parquet.writeLegacyFormat"
#: Rows of an encoded batch; it bounds what a worker holds at once.
BATCH_ROWS = 512


def _encode_part(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        tail = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            encode = encoder(tokenizer_path).encode
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                raw = encode(batch.column(1).to_pylist())
                n = np.array([len(x) // 4 + 1 for x in raw], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = pa.py_buffer(tail.join(raw) + tail)  # the end id follows each text
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, flat]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(raw), part, np.int32)), pa.array(first + ends[:-1]), pa.array(n), ids],
                    names=["id", "part", "first", "n_tokens", "ids"],
                )
                first += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes ``docs`` and writes the files under ``path``.

    Texts, which are smaller than their ids, cross the one range shuffle; they
    are encoded behind it, in file order, in bounded batches.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    whole, small = T.LongType(), T.IntegerType()
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", small), T.StructField("first", whole), T.StructField("n_tokens", whole), T.StructField("ids", T.ArrayType(small, False))])
    out = small_batches(ordered).mapInArrow(tidied(_encode_part(tokenizer_path, end_id)), schema).withColumnRenamed("id", id_col)
    # Lists of two levels, which Parquet allows where no element is null, save
    # the writer two calls for every id.
    before = spark.conf.get(TWO_LEVELS)
    spark.conf.set(TWO_LEVELS, "true")
    try:
        out.write.options(**FILE_OPTIONS).parquet(path)
    finally:
        spark.conf.set(TWO_LEVELS, before)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents with ``start`` (ids of all documents before), n_tokens and ids.

    Starts come from counts alone: one sum for each file, then a running sum
    over the files, of which there are as many as tasks that wrote.
    """
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select(id_col, (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``ids`` replaced by ids_crc32 over little-endian unsigned 32-bit ids."""
    keep = [c for c in rows.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            ids = b.column(len(keep))
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            ends = ids.offsets.to_numpy()
            crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, ids_col).mapInArrow(run, f"{schema}, ids_crc32 long")
