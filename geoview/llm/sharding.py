"""Sharding: a reproducible shuffle by a Feistel permutation of row numbers.

Rows get global numbers 0..N-1 in the order (bucket, hash), where the hash is of
all columns and the bucket follows from it; rows that only share a 64-bit hash
are in no set order, so the order depends on the rows alone, not on files or
partitions.  A balanced Feistel network over pairs (left < a, right < b), where a*b >= N > a*b - a,
permutes 0..a*b-1; a number that leaves 0..N-1 walks on along its cycle until it
is inside again.  So the shuffle of N rows is a bijection that anyone can
compute from (row number, N, seed): shard = p mod S and slot = p div S, which
makes shard sizes differ by one row at most and slots gapless.

Only DataFrame expressions run here.  The data is counted once per bucket (a
pass over the hashes), and crosses one shuffle, by bucket; buckets hold about
``BUCKET_ROWS`` rows and mix all columns into their hash, so they stay even when a
third of the rows share an id or a text.  Rows equal in all columns share a hash:
where a bucket is over ``HOT_BUCKET`` times as full as others, its hashes of many
rows (a thousand at most) get buckets of their own, as many as their rows need;
these rows alone are written first, so that each keeps its bucket when a task
runs again.  The broadcast table of bucket offsets has ``MAX_BUCKETS`` rows and
those.

Edge cases: nulls in any column are hashed like values; rows equal in all
columns are interchangeable, and each gets a slot of its own; an empty table
gives no rows; clashing column names get an underscore.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, row_hash, written

BUCKET_ROWS = 2_000
MAX_BUCKETS = 1 << 16
HOT_BUCKET = 8
HOT_HASHES = 1_000
ROUNDS = 4
#: Steps of a walk.  A step ends outside with probability below 2/sqrt(N), and
#: a walk can't be longer than a*b-N+1, so longer ones do not occur; one that
#: did would raise an error and not give a wrong place.
WALK_STEPS = 32


def number_rows(df: DataFrame, row_number: str) -> tuple[DataFrame, int]:
    """``df`` with gapless row numbers from 0, and the number of rows."""
    n = df.count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    full = HOT_BUCKET * max(BUCKET_ROWS, n // buckets)
    h, b, first, own = (free_name(df, c) for c in ("row_hash", "row_bucket", "bucket_first", "hot_bucket"))
    keyed = df.withColumn(h, row_hash(df)).withColumn(b, F.pmod(F.col(h), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy(b).agg(F.count(F.lit(1)).alias("n"))
    over = [r[b] for r in sizes.filter(F.col("n") > full).select(b).limit(HOT_HASHES).collect()] if n > full else []
    if over:
        many = keyed.filter(F.col(b).isin(over)).groupBy(h).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > full // 2)
        # Numbered in order of their hashes; each has as many buckets as it needs.
        in_order = Window.orderBy(F.desc("n"), h)
        many = many.withColumn("at", F.row_number().over(in_order)).filter(F.col("at") <= HOT_HASHES)
        many = written(many.select(h, (F.lit(buckets) + F.col("at") * MAX_BUCKETS).alias(own), F.ceil(F.col("n") / full).alias("parts")), "hot-rows")
        hot = keyed.join(F.broadcast(many), h).withColumn(b, (F.col(own) + F.pmod(F.monotonically_increasing_id(), F.col("parts"))).cast("int"))
        hot = written(hot.select(*keyed.columns), "hot-rows")
        keyed = keyed.join(F.broadcast(many.select(h)), h, "left_anti").select(*keyed.columns).unionByName(hot)
        sizes = keyed.groupBy(b).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(b, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(first))
    within = F.row_number().over(Window.partitionBy(b).orderBy(h))
    placed = keyed.withColumn(row_number, within).join(F.broadcast(offsets), b)
    return placed.withColumn(row_number, F.col(first) + F.col(row_number) - 1).select(*df.columns, row_number), n


def feistel(number: Column, n: int, seed: int) -> Column:
    """The place 0..n-1 of row ``number``: a keyed bijection of 0..n-1."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def one_pass(x: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            left, right = s["l"], s["r"]
            left = F.pmod(left + F.pmod(F.xxhash64(right, i, F.lit(seed)), F.lit(a)), F.lit(a))
            right = F.pmod(right + F.pmod(F.xxhash64(left, i + 1, F.lit(seed)), F.lit(b)), F.lit(b))
            return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

        rounds = F.array(*[F.lit(2 * i) for i in range(ROUNDS)])
        start = F.struct(((x - F.pmod(x, F.lit(b))) / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
        return F.aggregate(rounds, start, step, lambda s: s["l"] * F.lit(b) + s["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK_STEPS)), one_pass(number.cast("long")), lambda x, _: F.when(x < n, x).otherwise(one_pass(x)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def shard_rows(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with row_number, shard (0..shards-1) and slot (gapless from 0)."""
    number = free_name(df, "row_number")
    numbered, n = number_rows(df, number)
    place = free_name(numbered, "place")
    placed = numbered.withColumn(place, feistel(F.col(number), n, seed))
    return placed.withColumns(
        {
            free_name(df, "shard"): F.pmod(F.col(place), F.lit(shards)).cast("int"),
            free_name(df, "slot"): ((F.col(place) - F.pmod(F.col(place), F.lit(shards))) / F.lit(shards)).cast("long"),
        }
    ).drop(place)
