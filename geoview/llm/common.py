"""What the operators of this subpackage share: shared tables and row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import drop, new_path, written

__all__ = ["TEXT_ROWS", "claim", "drop", "free_name", "held_out", "new_path", "row_hash", "small_batches", "tidied", "tidy", "with_text", "written"]

#: Rows of an Arrow batch of whole texts; it bounds what either side of the
#: pipe to Python holds at once.
TEXT_ROWS = 1_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns of a row; equal rows have equal ones."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])


def with_text(df: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, int]:
    """Columns ``keep`` of ``df`` and where its text is among the result's; the
    text goes to Python once, and a second time only if it isn't a kept string."""
    if text_col in keep and df.schema[text_col].dataType.simpleString() == "string":
        return df.select(*keep), keep.index(text_col)
    return df.select(*keep, F.col(text_col).cast("string").alias(free_name(df, "text"))), len(keep)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches are bound to TEXT_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df


_keepers: dict[str, Callable[[], None]] = {}


def claim(name: str, forget: Callable[[], None]) -> None:
    """Makes ``name`` the one memo of this worker process; workers outlive
    tasks, and memos of operators that ran before would add up."""
    for other in [k for k in _keepers if k != name]:
        _keepers.pop(other)()
        tidy()
    _keepers[name] = forget


def tidy() -> None:
    """Gives memory that is free inside this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library keeps its own way


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a task, which tidies up at its end."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        tidy()

    return whole
