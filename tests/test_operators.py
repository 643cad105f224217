import pytest
from pyspark.sql import functions as F

from geoview.operators import frames as fr
from geoview.operators import labels as lb
from geoview.operators import lookups as lk
from geoview.operators import pixels as px
from geoview.operators import raycast as rc


def test_interval_lookup(spark):
    spans = spark.createDataFrame([(0, 0, 10, "a"), (1, 5, 20, "b")], "pos int, lo int, hi int, v string")
    probes = spark.createDataFrame([(7, None), (15, None), (10, None), (30, 7), (30, None), (0, 30)], "frame_id int, c int")
    got = lk.interval_lookup(probes, spans, {"pos": -1, "v": "d"}, central_col="c")
    assert {(r["frame_id"], r["c"]): r["v"] for r in got.collect()} == {(7, None): "a", (15, None): "b", (10, None): "a", (30, 7): "b", (30, None): "d", (0, 30): "a"}
    none = lk.interval_lookup(probes, spans.limit(0), {"pos": -1, "v": "d"})
    assert {r["v"] for r in none.collect()} == {"d"}


def test_neighbours(spark):
    frames = spark.range(79, 112).select(F.lit("f").alias("flight_id"), F.col("id").alias("frame_id"))
    near = lk.neighbours(frames, 20, 10, 5).filter("frame_id = 100")
    got = sorted((r["phase"], r["neighbour_id"]) for r in near.collect())
    assert got == [(1, 80), (1, 85), (1, 90), (1, 95), (2, 105), (2, 110)]
    by_column = lk.neighbours(frames, F.lit(20), F.lit(10), F.lit(5)).filter("frame_id = 100")
    assert sorted((r["phase"], r["neighbour_id"]) for r in by_column.collect()) == got
    assert lk.neighbours(frames, 0, 0, 5).count() == 0


def test_floor_lookup(spark):
    table = spark.createDataFrame([(0, "a"), (10, "b"), (20, "c"), (None, "n")], "k long, v string")
    probes = spark.createDataFrame([(10,), (19,), (-1,), (500,), (None,), (20,)], "k long")
    got = {r["k"]: r["v"] for r in lk.floor_lookup(probes, table, "k", ["v"]).collect()}
    assert got == {10: "b", 19: "b", -1: None, 500: "c", None: None, 20: "c"}
    assert {r["v"] for r in lk.floor_lookup(probes, table.limit(0), "k", ["v"]).collect()} == {None}


def test_floor_lookup_by_group_and_far_buckets(spark):
    table = spark.createDataFrame([("x", 0, 1), ("x", 1_000_000, 2), ("y", 5, 3)], "g string, k long, v int")
    probes = spark.createDataFrame([("x", 999_999), ("x", 2_000_000), ("y", 4), ("y", 700_000), ("z", 1)], "g string, k long")
    got = {(r["g"], r["k"]): r["v"] for r in lk.floor_lookup(probes, table, "k", ["v"], by=["g"]).collect()}
    assert got == {("x", 999_999): 1, ("x", 2_000_000): 2, ("y", 4): None, ("y", 700_000): 3, ("z", 1): None}


def test_echo_keeps_stored_nulls(spark):
    table = spark.createDataFrame([(1, "one"), (2, None)], "k int, v string")
    got = lk.echo_lookup(spark.createDataFrame([(1,), (2,), (3,)], "k int"), table, "k", "v", "r")
    assert {r["k"]: r["r"] for r in got.collect()} == {1: "one", 2: None, 3: "3"}


def test_cyclic(spark):
    row = spark.range(1).select(*[lk.cyclic(list("abcdef"), F.lit(i)).alias(str(i)) for i in (-1, 0, 6, -7)]).first()
    assert tuple(row) == ("f", "a", "a", "f")


def test_boxes(spark):
    box = lambda x1, x2: lb.box_yolo(F.lit(x1), F.lit(0), F.lit(x2), F.lit(10), 1024, 1024)
    corners = lb.yolo_corners(F.lit(0.5), F.lit(0.5), F.lit(0.25), F.lit(0.5), 1024, 1024)
    row = spark.range(1).select(box(1100, 1200).alias("out"), box(1024, 1100).alias("touch"), *[c.alias(n) for n, c in corners.items()]).first()
    assert row["out"] is None and row["touch"] is not None and tuple(row[2:]) == (384, 256, 640, 768)


def test_nms(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 1, 1, 11, 11), (1, 2, 9, 9, 19, 19), (2, 0, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)], "f int, o int, x1 int, y1 int, x2 int, y2 int")
    got = sorted((r["f"], r["o"]) for r in lb.nms(boxes, ["f"], ["o"], 0.3).collect())
    assert got == [(1, 0), (1, 2), (2, 0), (2, 1)]
    assert lb.nms(boxes, ["f"], ["o"], 0.3, literal=True).count() <= 5


def test_merged_tracks_take_the_first_class(spark):
    window = spark.createDataFrame([(5, 5, 0), (5, 4, 1), (5, 6, 2)], "frame_id int, neighbour_id int, phase int")
    boxes = spark.createDataFrame([(6, "t", 1, 0, 0, 1, 1), (4, "t", 2, 5, 5, 9, 9)], "frame_id int, track_id string, class_id int, x1 int, y1 int, x2 int, y2 int")
    row = lb.merged_tracks(window, boxes).first()
    assert (row["class_id"], row["x1"], row["y2"], row["boxes"]) == (2, 0, 9, 2)


def test_integral_threshold_is_strict(spark):
    p = spark.createDataFrame([(0, 0.25, 1.0), (0, 0.75, 1.0)], "x int, r double, a double")
    assert px.integral(p, ["x"], ("r",), threshold=2).count() == 0
    row = px.integral(p, ["x"], ("r",), threshold=0.1).select(px.to_byte(F.col("r")).alias("b")).first()
    assert row["b"] == 127


def test_borders(spark):
    def image(rows):
        return spark.createDataFrame([(1, x, y, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "img int, x int, y int, v int")

    got = px.content_borders(image([[0, 0, 0, 0], [0, 5, 6, 0], [0, 0, 0, 0]]), "img", "v", 4, 3).first()
    assert (got["top"], got["right"], got["bottom"], got["left"]) == (1, 3, 2, 1)
    whole = px.content_borders(image([[1, 0, 2], [0, 0, 0], [3, 0, 4]]), "img", "v", 3, 3).first()
    assert (whole["top"], whole["right"], whole["bottom"], whole["left"]) == (0, 3, 3, 0)


def test_raycast_against_brute_force(spark):
    import random

    rng = random.Random(9)
    tris = [(i, *[rng.uniform(-50, 50) for _ in range(9)]) for i in range(60)]
    rays = [(i, *[rng.uniform(-60, 60) for _ in range(2)], rng.uniform(60, 90), *[rng.uniform(-2, 2) for _ in range(2)], rng.choice([-1.0, -0.2, 0.0, 0.5])) for i in range(150)]
    tri = spark.createDataFrame(tris, "tid long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    ray = spark.createDataFrame(rays, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r["ray_id"]: r["tid"] for r in rc.raycast(ray, tri, include_misses=True).collect()}

    def hit(o, d, a, b, c):
        sub = lambda p, q: [x - y for x, y in zip(p, q)]
        cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
        dot = lambda p, q: sum(x * y for x, y in zip(p, q))
        e1, e2 = sub(b, a), sub(c, a)
        p = cross(d, e2)
        det = dot(e1, p)
        if abs(det) < 1e-9:
            return None
        s = sub(o, a)
        q = cross(s, e1)
        u, v, t = dot(s, p) / det, dot(d, q) / det, dot(e2, q) / det
        return t if u >= 0 and v >= 0 and u + v <= 1 and t > 0 else None

    want = {}
    for i, *r in rays:
        hits = [(t, tid) for tid, *p in tris if (t := hit(r[:3], r[3:], p[:3], p[3:6], p[6:])) is not None]
        want[i] = min(hits)[1] if hits else None
    assert got == want and any(v is not None for v in want.values())
    assert rc.raycast(ray, tri.limit(0)).count() == 0


def test_plans(spark):
    plan = fr.shutter_plan(spark, 10, 0, lambda i: i * 0 + 1).collect()
    assert [r["last"] - r["first"] for r in plan] == [2, 3, 4, 5, 6, 7, 8, 9, 10, 10]
    assert [r["z"] for r in fr.focus_plan(spark, 0.0, 5.0, 5).orderBy("frame").collect()] == [0, 1, 2, 3, 4]
    video = fr.video_sequence(spark.range(3), "id", 2, 1).orderBy("out_id").collect()
    assert [(r["out_id"], r["id"]) for r in video] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 2)]
    single = fr.video_sequence(spark.range(1), "id", 2, 1)
    assert single.count() == 4


def test_random_rotations(spark):
    got = fr.random_rotations(spark.range(50), 0.5, 2, 7)
    assert got.count() == 150 and got.filter("rotation_nr = 0 AND rotation <> 0").count() == 0
    assert got.filter("abs(rotation) > 0.5").count() == 0


def test_overlay_and_colors(spark):
    row = spark.range(1).select(
        px.overlay(F.lit(10.0), F.lit(20.0), F.lit(255.0), whole=True).alias("a"), px.overlay(F.lit(10.0), F.lit(20.0), None).alias("b"),
        px.overlay(F.lit(10.0), F.lit(20.0), F.lit(0.5)).alias("c"), px.binary_mask(F.lit(254)).alias("d"), px.soft_mask(F.lit(255)).alias("e"),
    ).first()
    assert tuple(row) == pytest.approx((20, 20, 15, 0, 1))


def test_floor_lookup_of_texts_and_skewed_keys(spark):
    from geoview.operators import lookups as lk

    keys = ["b"] * 50 + ["d", "m", "x"]
    table = spark.createDataFrame([(k, i) for i, k in enumerate(sorted(set(keys)))], "k string, v int")
    probes = spark.createDataFrame([(k,) for k in ["a", "b", "c", "d", "zz", None]], "k string")
    got = {r["k"]: r["floor_key"] for r in lk.floor_lookup(probes, table, "k", ["v"], buckets=3).collect()}
    assert got == {"a": None, "b": "b", "c": "b", "d": "d", "zz": "x", None: None}
    table = spark.range(300).select(F.when(F.col("id") < 290, 5).otherwise(F.col("id") * 100).alias("k"), (F.col("id") % 2).alias("g"), F.col("id").alias("v")).dropDuplicates(["k", "g"])
    probes = spark.range(0, 40_000, 1000).select(F.col("id").alias("k"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("g"))
    have = [(r["g"], r["k"]) for r in table.collect()]
    for r in lk.floor_lookup(probes, table, "k", ["v"], by=["g"], buckets=4).collect():
        assert r["floor_key"] == max((k for g, k in have if g == r["g"] and k <= r["k"]), default=None)


def test_shutter_plan_in_ranges(spark, monkeypatch):
    from geoview.operators import frames as fr

    monkeypatch.setattr(fr, "RANGE", 7)
    got = [tuple(r) for r in fr.shutter_plan(spark, 60, 10, lambda i: i % 3, symmetrical=True).orderBy("frame").collect()]
    want, grown = [], 0
    for i in range(60):
        if grown >= 50:
            break
        grown += i % 3
        want.append((i, grown, max(10 - grown, 0), min(10 + grown + 1, 60)))
    assert got == want


def test_sums_of_exposures(spark, monkeypatch):
    from geoview.operators import frames as fr
    from geoview.operators import render

    monkeypatch.setattr(fr, "RANGE", 7)
    shots = spark.range(40).select((F.col("id") * 3).alias("shot"), (F.col("id") * F.col("id")).alias("light"))
    plan = spark.createDataFrame([(0, 0, 1), (1, 5, 25), (2, 39, 40), (3, 0, 40), (4, 8, 8)], "frame long, first long, last long")
    got = {r["frame"]: r["light"] for r in render.shutter_sums(plan, shots, "shot", ["light"]).collect()}
    assert got == {f: sum(i * i for i in range(a, b)) for f, a, b in ((0, 0, 1), (1, 5, 25), (2, 39, 40), (3, 0, 40), (4, 8, 8))}


def test_large_images_are_assembled_in_linear_time(spark):
    from geoview.sources import png

    n = 512
    pixels = spark.range(n * n).filter("id % 5 > 1").select(F.lit(1).alias("k"), (F.col("id") % n).cast("int").alias("x"), F.expr(f"cast(id div {n} as int)").alias("y"), *[(F.col("id") % 251).cast("int").alias(c) for c in "rgba"])
    rgba = png.images_from_pixels(pixels.unionByName(pixels.limit(3)), "k", n, n).first()["rgba"]
    assert len(rgba) == 4 * n * n
    assert all(rgba[4 * i] == (i % 251 if i % 5 > 1 else 0) for i in range(n * n))


def test_bilinear_samples(spark):
    values = [[0.0, 4.0, 8.0], [2.0, 6.0, 1.0]]
    pixels = spark.createDataFrame([(1, x, y, values[y][x], 1.0) for y in range(2) for x in range(3)], "shot_id long, x int, y int, v double, a double")
    at = [(0.5, 0.5), (0.0, 1.0), (1.0, 0.0), (1 / 6, 0.75), (0.4, 0.6), (0.97, 0.31)]
    surface = spark.createDataFrame([(1, i, *p) for i, p in enumerate(at)], "k long, vid long, gu double, gv double")
    shots = spark.createDataFrame([(1, 1)], "k long, shot_id long")
    seen = px.sample_shots(surface, shots, lambda: (F.col("gu"), F.col("gv"), F.lit(True)), ["k"], pixels, 3, 2, bilinear=("v", "a"))
    got = {r["vid"]: r for r in px.integral(seen, ["vid"], ("v",)).collect()}
    for i, (u, v) in enumerate(at):
        x, y = min(max(u * 3 - 0.5, 0), 2), min(max((1 - v) * 2 - 0.5, 0), 1)
        want = sum(values[r][c] * max(0, 1 - abs(x - c)) * max(0, 1 - abs(y - r)) for r in range(2) for c in range(3))
        assert abs(got[i]["v"] - want) < 1e-9 and abs(got[i]["overlap"] - 1) < 1e-9, i


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("count", [300_000, 2_000_000])
def test_ranks_of_many_wide_rows(spark, adaptive, count):
    """Every row once and in its place, with and without adaptive plans."""
    from geoview.operators import render

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(count).select(((F.col("id") * 7_919) % count * 3).alias("shot"), F.lit("x" * 80).alias("note"), F.lit(1).cast("long").alias("light"))
        wrong = fr.ranked(rows, "shot").agg(F.count(F.lit(1)), F.count_if(F.col("rank__") * 3 != F.col("shot"))).first()
        assert tuple(wrong) == (count, 0)
        if count == 300_000:
            video = fr.video_sequence(rows, "shot", 1, 1).agg(F.count(F.lit(1)), F.countDistinct("out_id"), F.max("out_id")).first()
            assert tuple(video) == (count + 2, count + 2, count + 1)
            plan = spark.createDataFrame([(0, 0, count), (1, 100, 200_000)], "frame long, first long, last long")
            assert {r["frame"]: r["light"] for r in render.shutter_sums(plan, rows, "shot", ["light"]).collect()} == {0: count, 1: 199_900}
            shots = rows.select("shot", *[F.col("shot").cast("double").alias(c) for c in "xyz"])
            ground = spark.createDataFrame([(0.0,) * 5], "center_x double, center_y double, center_z double, min_z double, max_z double")
            at = {r["mode"]: r["x"] for r in fr.camera_positions(shots, "shot", 0.0, ground).collect()}
            assert at["CenterShot"] == count // 2 * 3 and at["LastShot"] == (count - 1) * 3 and len(at) == 6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_footprints_bring_few_pairs_together(spark, sf_dir):
    """Pairs by cell are all that are seen and few others, also for cameras that are
    tilted, that see the horizon, that stand within the surface or look from below."""
    from geoview.functions import camera as cam
    from geoview.functions.geometry import Transform
    from geoview.functions.vec import Quat, Vec3
    from geoview.operators import footprints as fp
    from geoview.plans import adapters as A
    from geoview.plans import catalogue as C

    surface = spark.range(100 * 100).select(F.col("id").alias("pid"), (F.col("id") % 100 * 4.0 + 1).alias("gx"), (F.floor(F.col("id") / 100) * 4.0 + 1).alias("gy"), (F.col("id") % 11 * 1.0).alias("gz"))

    def pairs(shots, camera):
        u, v, front = camera.uv(Vec3.of("gx", "gy", "gz"))
        met = fp.met_by_cell(surface, shots, [], camera, ("gx", "gy", "gz"), None).select("shot", "pid", (front & u.between(0, 1) & v.between(0, 1)).alias("seen"))
        whole = shots.crossJoin(surface).filter(front & u.between(0, 1) & v.between(0, 1)).select("shot", "pid")
        rows = met.collect()
        kept = {(r["shot"], r["pid"]) for r in rows if r["seen"]}
        assert kept == {tuple(r) for r in whole.collect()} and len({(r["shot"], r["pid"]) for r in rows}) == len(rows)
        return len(rows), len(kept)

    frames = A.frames(spark, sf_dir).filter("frame_id < 150").withColumnRenamed("frame_id", "shot")
    met, kept = pairs(frames, C._frame_camera())
    assert kept > 10_000 and met < 3 * kept
    tilt = spark.range(60).select(F.col("id").alias("shot"), (F.col("id") * 37 % 400 * 1.0).alias("x"), (F.col("id") * 53 % 400 * 1.0).alias("y"), (F.col("id") % 5 * 40.0 - 20).alias("z"), (F.col("id") % 12 * 30.0).alias("a"), (F.col("id") * 7 % 180 * 1.0).alias("b"))
    pose = Transform(Vec3.of("x", "y", "z"), Quat.about("z", F.radians("a")).times(Quat.about("x", F.radians("b"))))
    assert pairs(tilt, cam.Camera.perspective(pose, 40.0, 1.5))[1] > 1000
    assert pairs(tilt, cam.Camera.orthographic(pose, 60.0, 30.0))[1] > 1000
    assert fp.met_by_cell(surface.limit(0), frames, [], C._frame_camera(), ("gx", "gy", "gz"), None).count() == 0


def test_rays_walk_the_cells_that_they_cross(spark):
    """Rows of the walk are the cells that a track crosses, level rays included."""
    import math

    from geoview.operators import raycast as rc

    span = {"x0": 0.0, "x1": 100.0, "y0": 0.0, "y1": 100.0, "z0": 0.0, "z1": 10.0, "extent": 20.0, "n": 1}
    cell, levels = rc.grid_of(span)
    assert (cell, levels) == (10.0, 1)
    rays = [(0, -5.0, 33.0, 5.0, 1.0, 0.0, 0.0), (1, 50.0, -7.0, 3.0, 0.0, 2.0, 0.0), (2, 1.0, 2.0, 8.0, 1.0, 0.93, 0.0), (3, 0.0, 99.0, 40.0, 3.0, -3.1, -1.0), (4, 55.0, 55.0, 30.0, 0.0, 0.0, -1.0), (5, 200.0, 5.0, 5.0, 1.0, 0.0, 0.0), (6, 5.0, 5.0, 20.0, 0.0, 0.0, 1.0), (7, 95.0, 3.0, 20.0, -0.7, 0.9, -0.11)]
    table = spark.createDataFrame(rays, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    tracks = rc._with_level(rc._tracks(table, span, cell), cell, levels)
    got = {}
    for r in rc.walked(tracks, cell).collect():
        got.setdefault(r["ray_id"], []).append((r["gx"], r["gy"]))
    for i, ox, oy, oz, dx, dy, dz in rays:
        ends = (0.0, 1000.0) if dz == 0 else sorted((-oz / dz, (10 - oz) / dz))
        near, far = max(ends[0], 0.0), ends[1]
        want = set()
        for k in range(200_001):
            t = near + (far - near) * k / 200_000
            x, y = ox + t * dx, oy + t * dy
            if 0 < x < 100 and 0 < y < 100 and far >= 0:
                want.add((math.floor(x / 10), math.floor(y / 10)))
        own = got.get(i, [])
        assert want <= set(own) and len(own) == len(set(own)), i
        # Beyond those crossed, only cells that a track touches at an edge.
        assert len(own) <= 2 * (len(want) + 2), i
    assert len(got[2]) < 25 and len(got[0]) <= 12


def test_rays_meet_the_mesh_of_their_own_key(spark):
    from geoview.operators import raycast as rc

    tri = spark.createDataFrame([(f, 0, 0.0, 0.0, h, 9.0, 0.0, h, 0.0, 9.0, h) for f, h in (("a", 1.0), ("b", 2.0))], "flight_id string, tid long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    rays = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ray_id long, flight_id string").select("*", *[F.lit(v).alias(n) for n, v in zip(("ox", "oy", "oz", "dx", "dy", "dz"), (1.0, 1.0, 5.0, 0.0, 0.0, -1.0))])
    got = {r["ray_id"]: r["z"] for r in rc.raycast(rays, tri, by=["flight_id"]).collect()}
    assert got == {1: 1.0, 2: 2.0}


def test_suppression_of_crowded_frames(spark):
    """100,000 boxes of one frame in seconds; small ones against the definition."""
    import random
    import time

    rng = random.Random(4)
    rows = [(f, o, *(x := (rng.randint(0, 60), rng.randint(0, 60))), x[0] + rng.choice([0, 3, 9, 200]), x[1] + rng.choice([2, 8, 150]), "t" * (o % 3)) for f in range(6) for o in range(70)]
    table = spark.createDataFrame(rows, "f int, o int, x1 int, y1 int, x2 int, y2 int, note string")

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        union = sum((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)) - both
        return both / union if union > 0 else 0.0

    want = []
    for f in range(6):
        kept = []
        for r in [r for r in rows if r[0] == f]:
            if all(overlap(k[2:6], r[2:6]) <= 0.2 for k in kept):
                kept.append(r)
        want += kept
    assert sorted(map(tuple, lb.nms(table, ["f"], ["o"], 0.2).collect())) == sorted(want) and len(want) < len(rows)
    big = spark.range(100_000).select(F.lit(1).alias("f"), F.col("id").alias("o"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(4000))).cast("int").alias(n) for c, n in enumerate(("x1", "y1"))])
    big = big.withColumns({"x2": F.col("x1") + 20, "y2": F.col("y1") + 20})
    start = time.time()
    n = lb.nms(big, ["f"], ["o"], 0.1).count()
    assert 20_000 < n < 80_000 and time.time() - start < 30


def test_a_frame_number_belongs_to_its_flight(spark):
    from geoview.config import PipelineSettings
    from geoview.operators import render as rd

    pose = [(f, n, 100.0 * f, 0.0, 50.0, 0.0, 0.0, 0.0, 50.0) for f in (1, 2) for n in (6, 7, 8)]
    frames = spark.createDataFrame(pose, "flight_id long, frame_id long, " + ", ".join(f"{c} double" for c in rd.POSE))
    labels = spark.createDataFrame([(1, 7, 0, 5, 2, [(500.0, 500.0), (520.0, 530.0)])], "flight_id long, frame_id long, line int, track_id long, class_id int, corners array<struct<x:double,y:double>>")
    none = spark.createDataFrame([(0, 7, 7, 1) + (0.0,) * 6], "pos int, lo long, hi long, flight_id long, " + ", ".join(f"{c} double" for c in rd.CORRECTION))
    mesh = spark.createDataFrame([(0, -1000.0, -1000.0, 0.0, 2000.0, -1000.0, 0.0, -1000.0, 2000.0, 0.0)], "tid long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    run = lambda s, labels=labels, **k: rd.batch_labels(frames, labels, none, mesh, s, 5, 5, 1, **k)
    got = sorted((r["flight_id"], r["frame_id"], r["class_id"]) for r in run(PipelineSettings()).collect())
    assert got == [(1, 6, 2), (1, 7, 2), (1, 8, 2)]
    assert {r["frame_id"] for r in run(PipelineSettings(project_orthogonal=True)).collect()} == {7}
    assert {r["frame_id"] for r in run(PipelineSettings(initial_skip=1)).collect()} == {7, 8}
    assert run(PipelineSettings(exclude_flights=("1",))).count() == 0
    by_line = run(PipelineSettings(), labels.drop("track_id")).collect()
    assert [(r["frame_id"], r["track_id"]) for r in by_line] == [(7, 0)]
    turned = run(PipelineSettings(additional_rotations=2, rotation_seed=5)).collect()
    assert len(turned) == 9 and {r["rotation_nr"] for r in turned} == {0, 1, 2}
    names = {r["name"] for r in turned}
    assert len(names) == 9 and "1_7" in names and all("." not in n for n in names)
    done = spark.createDataFrame([("1_7",)], "name string")
    assert {r["frame_id"] for r in run(PipelineSettings(), done=done).collect()} == {6, 8}


def _shuffles(plan, column):
    """The most shuffles that rows of scans of ``column`` go through."""
    children = plan.children()
    below = max((_shuffles(children.apply(i), column) for i in range(children.size())), default=-1)
    if plan.nodeName().startswith("Scan"):
        return 0 if f"{column}#" in plan.simpleString(100) else -1
    return below + 1 if below >= 0 and plan.nodeName() == "Exchange" else below


@pytest.mark.parametrize("name", ["batch_labels_by_flight", "batch_labels", "batch_labels_unmerged", "drawn_labels"])
def test_labels_are_shuffled_once(spark, sf_dir, name):
    from geoview.queries import QUERIES

    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
        assert _shuffles(plan, "l_orderkey") == 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("reach", [(7, 3, 2), (0, 5, 1), (30, 30, 5)])
def test_windows_over_the_borders_of_blocks(spark, monkeypatch, reach):
    """Blocks against pairs of frames, and frame numbers that name their flight."""
    import random

    from geoview.config import PipelineSettings
    from geoview.operators import render as rd

    monkeypatch.setattr(rd, "BLOCK_FRAMES", 4)
    monkeypatch.setattr(rd, "BLOCK_REACHES", 1)
    rng = random.Random(8)
    ids = [(f, n) for f in (1, 2) for n in range(-40, 60) if rng.random() < 0.7]
    frames = spark.createDataFrame([(f, n, float(n), 9.0 * f, 50.0, 0.0, 0.0, float(n % 360), 50.0) for f, n in ids], "flight_id int, frame_id long, " + ", ".join(f"{c} double" for c in rd.POSE))
    seen = [(f, n, k, rng.randint(0, 3), k % 2, [(float(x), 500.0), (520.0, float(x))]) for f, n in [*ids, (3, 7)] for k in range(rng.randint(0, 3)) for x in [rng.randint(400, 600)]]
    labels = spark.createDataFrame(seen, "flight_id long, frame_id long, line int, track_id long, class_id int, corners array<struct<x:double,y:double>>")
    shifts = spark.createDataFrame([(i, 10 * i - 40, 10 * i - 33, i % 2 + 1, 0.0, 0.0, float(i)) + (0.0,) * 3 for i in range(10)], "pos int, lo long, hi long, flight_id int, " + ", ".join(f"{c} double" for c in rd.CORRECTION))
    mesh = spark.createDataFrame([(0, -1000.0, -1000.0, 0.0, 2000.0, -1000.0, 0.0, -1000.0, 2000.0, 0.0)], "tid long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    run = lambda frames, labels, shifts, reach: sorted(tuple(round(v, 6) for v in r) for r in rd.batch_labels(frames, labels, shifts, mesh, PipelineSettings(), *reach, ensure_int=False).collect())
    want = run(frames, labels, shifts, [F.lit(v) for v in reach])
    assert len(want) > 100 and run(frames, labels, shifts, reach) == want
    # Frames 1000 apart for each flight.
    apart = lambda df, *c: df.withColumns({k: F.col(k) + 1000 * F.col("flight_id") for k in c})
    got = run(apart(frames, "frame_id"), apart(labels, "frame_id").drop("flight_id"), apart(shifts, "lo", "hi"), reach)
    assert got == sorted((f, n + 1000 * f, *rest) for f, n, *rest in want)
