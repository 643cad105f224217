"""Lookups and joins: by interval, by neighbourhood, by floor and by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows under which the small side of a lookup is broadcast.
BROADCAST_ROWS = 200_000
#: Keys whose quantiles cut a floor lookup into ranges.
SAMPLE_KEYS = 8_192
RANGE_ROWS = 100_000
MAX_RANGES = 512


def _small(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` with a broadcast hint if it is known to be small enough."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def interval_lookup(
    frames: DataFrame,
    intervals: DataFrame,
    default: dict[str, object],
    by: list[str] | None = None,
    frame_col: str = "frame_id",
    central_col: str | None = None,
) -> DataFrame:
    """``frames`` with the payload of the interval that holds each frame.

    ``intervals`` has pos (list order), lo and hi (inclusive), the ``by`` columns
    and a payload.  The first interval by pos that holds the frame wins; else the
    last one that holds ``central_col``; else ``default``.

    Intervals are cut into bins about as wide as they are on average (one small
    aggregate finds that out), so they take two bins on average and overlap
    within a bin is all that grows; every bin holds an ordered array, and frames
    find theirs in one equi-join that keeps their rows as they are.
    """
    by = by or []
    payload = [c for c in intervals.columns if c not in ("lo", "hi", *by)]
    stats = intervals.agg(F.avg(F.col("hi") - F.col("lo") + 1), F.count(F.lit(1))).first()
    width = max(1, int(stats[0] or 1))
    at = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("bin__")
    body = F.struct("pos", "lo", "hi", *[c for c in payload if c != "pos"])
    bins = intervals.filter(F.col("lo") <= F.col("hi")).select(*by, at, body.alias("one__"))
    bins = bins.groupBy(*by, "bin__").agg(F.array_sort(F.collect_list("one__")).alias("all__"))
    bins = _small(bins, 2 * stats[1])

    def joined(df: DataFrame, probe: str, name: str, last: bool) -> DataFrame:
        side = bins.withColumnRenamed("all__", name)
        df = df.withColumn("bin__", F.floor(F.col(probe) / width)).join(side, [*by, "bin__"], "left").drop("bin__")
        hits = F.filter(name, lambda i: (i["lo"] <= F.col(probe)) & (F.col(probe) <= i["hi"]))
        return df.withColumn(name, F.try_element_at(hits, F.lit(-1 if last else 1)))

    out = joined(frames, frame_col, "own__", last=False)
    found = F.col("own__")
    if central_col:
        out = joined(out, central_col, "central__", last=True)
        found = F.coalesce(found, F.col("central__"))
    out = out.withColumn("found__", found)
    values = {c: F.when(F.col("found__").isNull(), F.lit(default.get(c))).otherwise(F.col("found__")[c]) for c in payload}
    return out.withColumns(values).drop("own__", "central__", "found__")


def neighbours(frames: DataFrame, before: Column | int, after: Column | int, stride: Column | int = 1, flight_col: str = "flight_id", frame_col: str = "frame_id") -> DataFrame:
    """(flight, frame, neighbour_id, phase) for the neighbours of every frame
    at multiples of ``stride``: phase 1 up to ``before`` frames earlier, phase 2
    up to ``after`` later.  The three may be columns of ``frames``.

    With constant reach, frames meet in an equi-join by flight, remainder of the
    stride and range of ids: each frame asks the two or three ranges that it
    reaches, so the work follows the frames that exist.  With columns, the ids
    that may exist are listed per frame and found by an equi-join.
    """
    f = F.col(frame_col)
    there = frames.select(flight_col, f.cast("long").alias("neighbour_id")).distinct()
    if all(isinstance(v, int) for v in (before, after, stride)):
        width = max(before, after, stride, 1)
        span = lambda c: F.floor(c / width).cast("long")
        asked = frames.select(flight_col, frame_col, F.pmod(f, F.lit(stride)).alias("rest__"), F.explode(F.sequence(span(f - max(before, 0)), span(f + max(after, 0)))).alias("span__"))
        n = F.col("neighbour_id")
        held = there.select(flight_col, n, F.pmod(n, F.lit(stride)).alias("rest__"), span(n).alias("span__"))
        near = asked.join(held, [flight_col, "rest__", "span__"]).filter((n != f) & n.between(f - before, f + after))
        return near.select(flight_col, frame_col, n, F.when(n < f, 1).otherwise(2).alias("phase"))
    before, after, stride = (F.lit(v) if isinstance(v, int) else v for v in (before, after, stride))

    def steps(reach: Column, sign: int, phase: int) -> Column:
        n = F.floor(reach / stride).cast("int")
        some = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(some, lambda k: F.struct((f + sign * k * stride).cast("long").alias("neighbour_id"), F.lit(phase).alias("phase")))

    wanted = frames.select(flight_col, frame_col, F.explode(F.concat(steps(before, -1, 1), steps(after, 1, 2))).alias("n"))
    return wanted.select(flight_col, frame_col, "n.*").join(there, [flight_col, "neighbour_id"]).select(flight_col, frame_col, "neighbour_id", "phase")


def _range_of(key: Column, edges: list) -> Column:
    """How many of the sorted ``edges`` are not above ``key``, by halving."""

    def at(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(edges[mid]), at(lo, mid)).otherwise(at(mid + 1, hi))

    return at(0, len(edges))


def floor_lookup(probes: DataFrame, table: DataFrame, key_col: str, value_cols: list[str], by: list[str] | None = None, buckets: int | None = None, hot_keys: bool = False) -> DataFrame:
    """``probes`` with the values at the greatest key of ``table`` that is not
    above theirs; null where there is none, as for a null key.

    Keys, of any type that has an order, are cut into ranges of about as many
    rows each, at quantiles of ``SAMPLE_KEYS`` of them; a running last value within
    each (by, range) answers most probes, and the last row of the nearest earlier
    range that has one, from a summary of one row for each range that exists,
    answers the others.  So no task holds all keys, with or without ``by``.  There
    are ``buckets`` ranges, or one for every ``RANGE_ROWS`` rows of the table, up to
    ``MAX_RANGES``.

    Equal keys share a range, so a key of very many probes is one task's.  With
    ``hot_keys`` each distinct key is looked up once, and probes meet the answers in an
    equi-join, which adaptive plans split where one key has very many.
    """
    by = by or []
    if hot_keys:
        asked = probes.select(*by, key_col).distinct()
        found = floor_lookup(asked, table, key_col, value_cols, by, buckets)
        names = {c: f"{c}__" for c in (*by, key_col)}
        met = [F.col(f"p__.{c}").eqNullSafe(F.col(f"f__.{n}")) for c, n in names.items()]
        out = probes.alias("p__").join(found.withColumnsRenamed(names).alias("f__"), met, "left")
        return out.select("p__.*", *[F.col(f"f__.{c}") for c in ("floor_key", *value_cols)])
    buckets = buckets or min(MAX_RANGES, max(8, table.count() // RANGE_ROWS))
    some = sorted(r[0] for r in table.select(key_col).filter(F.col(key_col).isNotNull()).orderBy(F.rand(7)).limit(SAMPLE_KEYS).collect())
    edges = sorted({some[len(some) * i // buckets] for i in range(1, buckets)}) if some else []
    at = _range_of(F.col(key_col), edges)
    hit = F.struct(F.col(key_col).alias("key__"), *value_cols)
    rows = table.filter(F.col(key_col).isNotNull()).select(*by, key_col, hit.alias("hit__"), at.alias("bucket__"))
    asked = probes.withColumn("bucket__", at).withColumn("hit__", F.lit(None).cast(rows.schema["hit__"].dataType)).withColumn("probe__", F.lit(True))
    both = asked.unionByName(rows.withColumn("probe__", F.lit(False)), allowMissingColumns=True)
    last = both.groupBy(*by, "bucket__").agg(F.max_by("hit__", F.when(~F.col("probe__"), F.col(key_col))).alias("last__"))
    # A window over at most ``buckets`` rows for each value of ``by``.
    earlier = Window.partitionBy(*by).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    spans = last.select(*by, "bucket__", F.last("last__", ignorenulls=True).over(earlier).alias("before__"))
    order = Window.partitionBy(*by, "bucket__").orderBy(F.col(key_col), F.col("probe__")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("hit__", F.last("hit__", ignorenulls=True).over(order)).filter("probe__").join(spans, [*by, "bucket__"], "left")
    got = F.when(F.col(key_col).isNotNull(), F.coalesce("hit__", "before__"))
    return out.withColumn("got__", got).select(*probes.columns, F.col("got__.key__").alias("floor_key"), *[F.col(f"got__.{c}").alias(c) for c in value_cols])


def echo_lookup(df: DataFrame, table: DataFrame, key_col: str, value_col: str, result: str, small: bool = False) -> DataFrame:
    """The value of a key, a stored null included, or the key where there is none."""
    side = table.select(F.col(key_col), F.col(value_col).alias("value__"), F.lit(True).alias("there__"))
    out = df.join(F.broadcast(side) if small else side, key_col, "left")
    return out.withColumn(result, F.when(F.col("there__"), F.col("value__")).otherwise(F.col(key_col).cast("string"))).drop("value__", "there__")


def cyclic(values: list[str], index: Column) -> Column:
    """The element at ``index`` modulo the length; negative ones count back."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def first_valid(data: Column, keys: list[str], default: Column | None = None, present: bool = False) -> Column:
    """The value of the first key of a map that is not null, or with
    ``present`` of the first that exists, even if its value is null."""
    default = F.lit(None) if default is None else default
    if not present:
        return F.coalesce(*[F.try_element_at(data, F.lit(k)) for k in keys], default)
    out = default
    for k in reversed(keys):
        out = F.when(F.map_contains_key(data, k), F.try_element_at(data, F.lit(k))).otherwise(out)
    return out


def attach_poses(frames: DataFrame, poses: DataFrame, keys: tuple[str, ...] = ("flight_id", "frame_id")) -> DataFrame:
    """Frames with the pose of their position in the flight."""
    return frames.join(poses, list(keys))


def pending(frames: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Frames without an output yet."""
    return frames.join(done, on, "left_anti")


def existing(frames: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Frames that have an output."""
    return frames.join(done, on, "left_semi")


def with_class_ids(labels: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels with the class id of their text, and those that have none."""
    known = labels.join(classes.select("label", "class_id"), "label", "left")
    return known.filter(F.col("class_id").isNotNull()), known.filter(F.col("class_id").isNull()).drop("class_id")
