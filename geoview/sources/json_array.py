"""The elements of one large JSON array, read in many tasks.

A document is cut into ranges of bytes.  Where a range begins inside a string or
outside one can't be told from its bytes, so a first pass scans each range both ways
and returns a few numbers for either: whether it ends in a string, how far it goes
down or up, and where the array's key stands.  Put together in order, these tell
where each range begins, and a second pass gives the elements that begin in it, read
to their ends.  The driver sees those numbers alone.

Elements are objects or arrays; others have no row.  The array is the document itself,
or the first one under ``key`` in the document's object.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written
from .sink import _system

RANGE_BYTES = 16 << 20
#: Bytes that are read on at a time for an element that goes beyond its range.
MORE_BYTES = 1 << 20


def _read(path: str, start: int, size: int) -> bytes:
    system, at = _system(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return f.read(size)


def _backslashes(path: str, start: int) -> int:
    """How many backslashes stand right before a place."""
    n = 0
    while start > n:
        size = min(64, start - n)
        part = _read(path, start - n - size, size)
        run = len(part) - len(part.rstrip(b"\\"))
        n += run
        if run < size:
            break
    return n


def levels(data: bytes, before: int, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it is outside strings, and the level behind it; level 0
    stands before the first byte, and ``before`` backslashes do."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    at = np.arange(n)
    plain = np.maximum.accumulate(np.where(b != 92, at, -1 - before)) if n else at
    run = np.zeros(n, np.int64)  # backslashes right before each byte
    if n:
        run[0] = before
        run[1:] = at[1:] - 1 - plain[:-1]
    quote = (b == 34) & (run % 2 == 0)
    inside = (np.cumsum(quote) - quote + in_string) % 2 == 1
    outside = ~inside & ~quote
    step = np.where(outside, ((b == 123) | (b == 91)).astype(np.int64) - ((b == 125) | (b == 93)), 0)
    return outside, np.cumsum(step)


def summary(data: bytes, before: int, key: str | None) -> list[dict]:
    """What a range does, read from outside a string and from inside one."""
    out = []
    for in_string in (False, True):
        outside, level = levels(data, before, in_string)
        found = []
        if key is not None:
            for m in re.finditer(re.escape(json.dumps(key)).encode() + rb"\s*:\s*\[", data):
                open_ = m.end() - 1
                if outside[open_] and (m.start() == 0 or outside[m.start() - 1]):
                    later = level[open_:]
                    found.append([open_, int(level[open_]), int(later.min())])
        quotes = np.frombuffer(data, np.uint8) == 34
        last = len(data) - 1
        ends = in_string if last < 0 else bool(not outside[last] and not quotes[last]) or bool(quotes[last] and _opens(data, before, in_string))
        out.append({"string": ends, "level": int(level[-1]) if len(level) else 0, "least": int(level.min()) if len(level) else 0, "found": found})
    return out


def _opens(data: bytes, before: int, in_string: bool) -> bool:
    """Whether the text is inside a string behind its last byte, a quote."""
    more, _ = levels(data + b" ", before, in_string)
    return not bool(more[-1])


def _scan(batches: Iterator[pa.RecordBatch], key: str | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, path, lo, hi in zip(*(c.to_pylist() for c in b.columns[:4])):
            data = _read(path, lo, hi - lo)
            text = json.dumps(summary(data, _backslashes(path, lo), key))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([text])], names=["range", "summary"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements that begin in ranges (range, path, lo, hi, from, level, string)."""
    for b in batches:
        for i, path, lo, hi, start, level0, in_string in zip(*(c.to_pylist() for c in b.columns)):
            data, size, values, n = _read(path, lo, hi - lo), hi - lo, [], 0
            before = _backslashes(path, lo)
            while True:
                _, level = levels(data, before, in_string)
                level = level + level0
                prior = np.concatenate([[level0], level[:-1]])
                own = np.arange(len(level)) >= start - lo
                closed = np.flatnonzero(own & (level < 2) & (prior >= 2))
                stop = int(closed[0]) if len(closed) else len(level)
                opens = np.flatnonzero(own & (prior == 2) & (level == 3) & (np.arange(len(level)) < min(stop, size)))
                ends = np.flatnonzero((prior == 3) & (level == 2))
                if not len(opens) or (len(ends) and ends[-1] > opens[-1]):
                    break
                more = _read(path, lo + len(data), MORE_BYTES)
                if not more:
                    raise ValueError(f"{path} ends within an element")
                data += more
            match = np.searchsorted(ends, opens, side="right")
            for a, e in zip(opens.tolist(), ends[match].tolist() if len(opens) else []):
                values.append(data[a : e + 1].decode())
                if len(values) == 4096:
                    yield _batch(i, n, values)
                    n, values = n + len(values), []
            if values:
                yield _batch(i, n, values)


def _batch(i: int, n: int, values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int64)), pa.array(np.arange(n, n + len(values))), pa.array(values, pa.string())], names=["range", "i", "value"])


def read_json_array(spark: SparkSession, path: str, key: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(position, value): the elements of a document's array as texts, in its order."""
    system, at = _system(path)
    size = system.get_file_info(at).size
    starts = list(range(0, size or 0, range_bytes))
    ranges = [(i, path, lo, min(lo + range_bytes, size)) for i, lo in enumerate(starts)]
    if key is not None and len(ranges) > 1:
        # Borders are put where no key can lie across them: behind a line's or an
        # element's comma, as near as may be.
        ranges = _moved(ranges, len(key) + 64)
    kinds = "range long, path string, lo long, hi long"
    table = spark.createDataFrame(ranges, kinds).repartition(max(1, len(ranges)), "range")
    got = {r["range"]: json.loads(r["summary"]) for r in table.mapInArrow(lambda b: _scan(b, key), "range long, summary string").collect()}
    level, string, begun, over, rows = 0, False, key is None, False, []
    for i, p, lo, hi in ranges:
        own = got[i][string]
        if not begun:
            first = next((f for f in own["found"] if level + f[1] == 2), None)
            if first is not None:
                begun = True
                rows.append((i, p, lo, hi, lo + first[0] + 1, level, string))
                over = level + first[2] < 2
        elif not over:
            # The document itself is the array: one level more keeps both alike.
            shift = 1 if key is None else 0
            rows.append((i, p, lo, hi, lo + (1 if key is None and i == 0 else 0), level + shift, string))
            over = (level + own["least"] < 2) if key is not None else False
        level, string = level + own["level"], own["string"]
    if not rows:
        return spark.createDataFrame([], "position long, value string")
    todo = spark.createDataFrame(rows, f"{kinds}, start long, level long, string boolean").repartition(len(rows), "range")
    found = written(todo.mapInArrow(_elements, "range long, i long, value string"), "json-elements")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = found.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return found.join(F.broadcast(before), "range").select((F.col("before") + F.col("i")).alias("position"), "value")


def _moved(ranges: list[tuple], width: int) -> list[tuple]:
    """Ranges whose borders have a comma right before them, where there is one near."""
    path, borders = ranges[0][1], [0]
    for *_, lo, _ in ranges[1:]:
        cut = _read(path, lo, width * 16).find(b",")
        borders.append(lo + cut + 1 if cut >= 0 else lo)
    borders.append(ranges[-1][3])
    return [(i, path, lo, hi) for i, (lo, hi) in enumerate(zip(borders, borders[1:])) if hi > lo]
