"""The supplied tables as frames, labels, corrections, meshes, rays and images,
each as a DataFrame and as the SQL that it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    d = lambda c: c.cast("double")
    return table(spark, sf_dir, "events").select(
        i.alias("frame_id"), F.col("user_id").alias("flight_id"), d(i % 400).alias("cam_x"), d(i * 7 % 400).alias("cam_y"), d(i % 50 + 100).alias("cam_z"), d(i * 13 % 360).alias("rot_z_deg"), F.lit(50.0).alias("fovy")
    )


FRAMES = """(SELECT event_id AS frame_id, user_id AS flight_id, CAST(event_id % 400 AS DOUBLE) AS cam_x, CAST(event_id * 7 % 400 AS DOUBLE) AS cam_y,
  CAST(event_id % 50 + 100 AS DOUBLE) AS cam_z, CAST(event_id * 13 % 360 AS DOUBLE) AS rot_z_deg, CAST(50 AS DOUBLE) AS fovy FROM events)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("track_id"), ((F.col("l_linenumber") - 1) % 6).alias("class_id"),
        (F.col("l_discount") * 10).alias("xc"), (F.col("l_tax") * 12.5).alias("yc"), (F.col("l_quantity") / 500).alias("w"), (F.col("l_quantity") / 400).alias("h"),
    )


LABELS = """(SELECT l_orderkey AS frame_id, l_linenumber AS line, l_suppkey AS track_id, (l_linenumber - 1) % 6 AS class_id,
  l_discount * CAST(10 AS DOUBLE) AS xc, l_tax * CAST(12.5 AS DOUBLE) AS yc, l_quantity / CAST(500 AS DOUBLE) AS w, l_quantity / CAST(400 AS DOUBLE) AS h FROM lineitem)"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every supplier: every third interval overlaps the next, gaps lie behind
    the others."""
    s = F.col("s_suppkey")
    hi = s * 100 + F.when(s % 3 == 0, 149).otherwise(69)
    return table(spark, sf_dir, "supplier").select(s.alias("pos"), (s * 100).alias("lo"), hi.alias("hi"), (F.col("s_acctbal") / 10000).alias("tz"))


CORRECTIONS = "(SELECT s_suppkey AS pos, s_suppkey * 100 AS lo, s_suppkey * 100 + CASE WHEN s_suppkey % 3 = 0 THEN 149 ELSE 69 END AS hi, s_acctbal / CAST(10000 AS DOUBLE) AS tz FROM supplier)"


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(v.cast("long").alias("vid"), (v % 5 * 100).cast("double").alias("x"), (F.floor(v / 5) * 100).cast("double").alias("y"), (F.col("n_regionkey") * 2.5).alias("z"))


VERTICES = "(SELECT CAST(n_nationkey AS BIGINT) AS vid, CAST(n_nationkey % 5 * 100 AS DOUBLE) AS x, CAST(n_nationkey // 5 * 100 AS DOUBLE) AS y, n_regionkey * CAST(2.5 AS DOUBLE) AS z FROM nation)"


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles for every cell of the 5 x 5 grid."""
    v = F.col("vid")
    cells = vertices(spark, sf_dir).filter((v % 5 < 4) & (v < 20))
    two = F.array(F.struct((2 * v).alias("tid"), v.alias("a"), (v + 1).alias("b"), (v + 5).alias("c")), F.struct((2 * v + 1).alias("tid"), (v + 1).alias("a"), (v + 6).alias("b"), (v + 5).alias("c")))
    return cells.select(F.explode(two).alias("t")).select("t.*")


FACES = f"""(SELECT 2 * vid AS tid, vid AS a, vid + 1 AS b, vid + 5 AS c FROM {VERTICES} WHERE vid % 5 < 4 AND vid < 20
  UNION ALL SELECT 2 * vid + 1, vid + 1, vid + 6, vid + 5 FROM {VERTICES} WHERE vid % 5 < 4 AND vid < 20)"""
TRIANGLES = f"""(SELECT tid, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz
  FROM {FACES} f JOIN {VERTICES} p ON f.a = p.vid JOIN {VERTICES} q ON f.b = q.vid JOIN {VERTICES} r ON f.c = r.vid)"""


def rays(spark: SparkSession, sf_dir: str, tilt: float = 1.0) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("ray_id"), F.lit(200.0).alias("ox"), F.lit(200.0).alias("oy"), F.lit(150.0).alias("oz"),
        (((i % 97) / 97.0 - 0.5) * tilt).alias("dx"), (((i % 89) / 89.0 - 0.5) * tilt).alias("dy"), F.lit(-1.0).alias("dz"),
    )


def rays_sql(tilt: float = 1.0) -> str:
    d = lambda n: f"(CAST(event_id % {n} AS DOUBLE) / {n} - CAST(0.5 AS DOUBLE)) * CAST({tilt} AS DOUBLE)"
    return f"(SELECT event_id AS ray_id, CAST(200 AS DOUBLE) AS ox, CAST(200 AS DOUBLE) AS oy, CAST(150 AS DOUBLE) AS oz, {d(97)} AS dx, {d(89)} AS dy, CAST(-1 AS DOUBLE) AS dz FROM events)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images, as arrays; ``grp`` is the scene that they show."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.col("label").alias("grp"), "embedding")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, grp, x, y, v, a): a is 1 where the value is positive."""
    cells = images(spark, sf_dir).select("img", "grp", F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    return cells.select("img", "grp", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), v.alias("v"), F.when(v > 0, 1.0).otherwise(0.0).alias("a"))


PIXELS = """(SELECT img, grp, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y, CAST(v AS DOUBLE) AS v, CASE WHEN v > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS a
  FROM (SELECT vec_id AS img, label AS grp, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings))"""


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("shot"), F.col("p_size").alias("size"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") * 10).alias("k"), "value")
