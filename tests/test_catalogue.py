"""Every query against the SQL that it equals, over the smallest tables."""

import math
import os

import duckdb
import pytest

from geoview.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    return None if isinstance(v, float) and math.isnan(v) else round(float(v), 9) + 0.0


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    found = [tuple(r) for r in got.collect()]
    assert found
    if name not in ORACLE_SQL:
        return
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, found) == rows(names, want.fetchall())


def test_names_match():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_frames_are_read_with_few_columns(spark, sf_dir):
    plan = QUERIES["shot_stride"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(event_id,7)" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_lookups_do_not_fall_back_to_nested_loops(spark, sf_dir):
    for name in ("frame_correction_lookup", "frame_correction_central_fallback", "neighbour_window", "raycast_nearest", "floor_lookup"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_whole_shot_sampling_takes_every_frame_and_image(spark, duck, sf_dir):
    got = {(r["frame_id"], r["vid"]): (r["v"], r["overlap"]) for r in QUERIES["shot_pixel_sampling"](spark, sf_dir).collect()}
    images = dict(duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    ground = duck.execute("SELECT n_nationkey, n_nationkey % 5 * 100, n_nationkey // 5 * 100, n_regionkey * 2.5 FROM nation").fetchall()
    frames = {n for (n,) in duck.execute("SELECT event_id FROM events").fetchall()}
    seen, edges = {}, set()
    for at in frames:
        a, t = math.radians(at * 13 % 360), math.tan(math.radians(25))
        for vid, gx, gy, gz in ground:
            x, y, z = gx - at % 400, gy - at * 7 % 400, at % 50 + 100 - float(gz)
            u, v = ((math.cos(a) * x + math.sin(a) * y) / z / t + 1) * 4, 8 - ((math.cos(a) * y - math.sin(a) * x) / z / t + 1) * 4
            windows = [(f, vid) for f in range(at - 4, at + 1) if f in frames]
            if min(abs(u - round(u)), abs(v - round(v))) < 1e-6:
                edges.update(windows)
            elif 0 <= u <= 8 and 0 <= v <= 8:
                for w in windows:
                    seen.setdefault(w, []).append((at % len(images), images[at % len(images)][int(v) * 8 + int(u)]))
    sure = {w: x for w, x in seen.items() if w not in edges}
    assert got.keys() - edges == sure.keys() and len(sure) > 0.9 * len(got)
    for w, x in sure.items():
        assert got[w][1] == len(x) and abs(got[w][0] - sum(v for _, v in x) / len(x)) < 1e-6, w
    assert {f % 10 for f, _ in sure} == set(range(10))
    assert {i for x in seen.values() for i, _ in x} >= set(list(images)[-20:])


def test_whole_roundtrip_reaches_the_edges_of_the_mesh(spark, sf_dir):
    got = {r["frame_id"] for r in QUERIES["pixel_world_roundtrip"](spark, sf_dir).collect()}
    hit, miss = set(), set()
    for i in range(1000):
        a, t = math.radians(i * 13 % 360), math.tan(math.radians(25))
        x, y = (i % 1024 / 512 - 1) * t, (1 - i * 3 % 1024 / 512) * t
        dx, dy = math.cos(a) * x - math.sin(a) * y, math.sin(a) * x + math.cos(a) * y
        # Where the ray is at the mesh's greatest and least height.
        ends = [(i % 400 + h * dx, i * 7 % 400 + h * dy) for h in (i % 50 + 90, i % 50 + 100)]
        if all(1e-6 < c < 400 - 1e-6 for p in ends for c in p):
            hit.add(i)
        elif any(all(p[c] < -1e-6 for p in ends) or all(p[c] > 400 + 1e-6 for p in ends) for c in (0, 1)):
            miss.add(i)
    assert hit <= got and not miss & got
    assert len(hit) > 500 and len(miss) > 50


def test_whole_lookups_use_every_correction(spark, duck, sf_dir):
    every = {s for (s,) in duck.execute("SELECT s_suppkey FROM supplier").fetchall()}
    for name in ("frame_correction_lookup", "frame_correction_central_fallback"):
        found = {r["frame_id"]: r["pos"] for r in QUERIES[name](spark, sf_dir).collect()}
        assert set(found.values()) == every | {0} and found[170] == 0
        assert found[180] == (3 if "fallback" in name else 0)
