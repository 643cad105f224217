"""JPEG files, files of frames, tiles and drawn lines."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoview.operators import labels as lb
from geoview.operators import tiles as tl
from geoview.sources import jpg, png, sink


def encoded(planes, factors, every=0):
    """A baseline JPEG of planes (already subsampled), all scales 1, whose Huffman
    codes all have eight bits."""
    symbols = bytes(range(12)), bytes(sorted({(r << 4) | s for r in range(16) for s in range(1, 11)} | {0, 0xF0}))
    marker = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    height, width = planes[0].shape
    head = b"\xff\xd8" + marker(0xDB, b"\0" + b"\1" * 64) + marker(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h * 16 + v, 0]) for i, (h, v) in enumerate(factors)))
    for kind, s in zip((0x00, 0x10), symbols):
        head += marker(0xC4, bytes([kind]) + bytes([0] * 7 + [len(s)] + [0] * 8) + s)
    if every:
        head += marker(0xDD, struct.pack(">H", every))
    head += marker(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0")
    hm, vm = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    cos = np.array([[np.cos((2 * n + 1) * k * np.pi / 16) * (1 / 8 if k == 0 else 1 / 4) ** 0.5 for n in range(8)] for k in range(8)])
    zig = sorted(((x + y), (y if (x + y) % 2 else x), x, y) for x in range(8) for y in range(8))
    blocks = []
    for p, (h, v) in zip(planes, factors):
        p = np.pad(p, ((0, down * v * 8 - p.shape[0]), (0, across * h * 8 - p.shape[1])), "edge").astype(float) - 128
        blocks.append([[[int(q) for q in np.round([(cos @ p[8 * i : 8 * i + 8, 8 * j : 8 * j + 8] @ cos.T)[y, x] for *_, x, y in zig])] for j in range(across * h)] for i in range(down * v)])
    out, bits, last, marks = b"", "", [0] * len(planes), 0

    def number(v):
        n = abs(v).bit_length()
        return n, "" if not n else format(v if v > 0 else v + (1 << n) - 1, f"0{n}b")

    def closed(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") if bits else b""

    for unit in range(across * down):
        if every and unit and unit % every == 0:
            out += closed(bits) + bytes([0xFF, 0xD0 + marks % 8])
            bits, last, marks = "", [0] * len(planes), marks + 1
        for c, (h, v) in enumerate(factors):
            for y in range(v):
                for x in range(h):
                    z = blocks[c][unit // across * v + y][unit % across * h + x]
                    n, b = number(z[0] - last[c])
                    bits, last[c] = bits + format(symbols[0].index(n), "08b") + b, z[0]
                    run = 0
                    end = max([k for k in range(1, 64) if z[k]], default=0)
                    for k in range(1, end + 1):
                        if not z[k]:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + format(symbols[1].index(0xF0), "08b"), run - 16
                        n, b = number(z[k])
                        bits, run = bits + format(symbols[1].index(run << 4 | n), "08b") + b, 0
                    if end < 63:
                        bits += format(symbols[1].index(0), "08b")
    return head + out + closed(bits) + b"\xff\xd9"


def smooth(h, w, a, b):
    y, x = np.mgrid[0:h, 0:w]
    return np.round(128 + 60 * np.sin(x / a) + 50 * np.cos(y / b)).astype(int)


def test_jpeg_planes():
    gray = smooth(21, 35, 7, 5)
    got = jpg.decode(encoded([gray], [(1, 1)]))
    assert got.shape == (21, 35, 4) and np.abs(got[:, :, 0].astype(int) - gray).max() <= 2 and (got[:, :, 3] == 255).all()
    noise = np.random.default_rng(1).integers(0, 256, (16, 16))
    assert np.abs(jpg.decode(encoded([noise], [(1, 1)]))[:, :, 1].astype(int) - noise).max() <= 2
    for factors in ([(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)]):
        h, v = factors[0]
        y, cb, cr = smooth(40, 52, 9, 11), smooth(40, 52, 60, 80), smooth(40, 52, 90, 70)
        small = [p.reshape(40 // v, v, 52 // h, h).mean((1, 3)).round().astype(int) for p in (cb, cr)]
        for every in (0, 2):
            got = jpg.decode(encoded([y, *small], factors, every)).astype(int)
            b, r = cb - 128, cr - 128
            want = np.clip(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], 2), 0, 255)
            assert np.abs(got[:, :, :3] - want).max() <= 4 and np.abs(got[:, :, :3] - want).mean() < 1, (factors, every)


def test_fixed_jpeg_values():
    """One block of known coefficients: its pixels by the transform's definition."""
    flat = encoded([np.full((8, 8), 200)], [(1, 1)])
    assert (jpg.decode(flat)[:, :, :3] == 200).all()
    assert [int(z) for z in jpg.ZIGZAG[:10]] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and int(jpg.ZIGZAG[63]) == 63


def test_jpeg_files_among_others(spark, tmp_path):
    good = encoded([smooth(8, 16, 5, 5)], [(1, 1)])
    files = {"1_1.jpg": good, "1_2.png": png.encode(np.full((2, 3, 4), 9, np.uint8)), "1_3.jpg": good[:60], "1_4.jpg": good.replace(b"\xff\xc0", b"\xff\xc2", 1), "1_5.jpg": b"\xff\xd8"}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    got = {r["path"].split("/")[-1]: r for r in png.read_images(spark, str(tmp_path)).collect()}
    assert (got["1_1.jpg"]["width"], got["1_1.jpg"]["height"], len(got["1_1.jpg"]["rgba"])) == (16, 8, 512)
    assert got["1_2.png"]["rgba"] == [9] * 24
    assert all(got[n]["error"] and got[n]["rgba"] is None for n in ("1_3.jpg", "1_4.jpg", "1_5.jpg"))


def test_files_of_frames(spark, tmp_path):
    path = str(tmp_path / "labels")
    boxes = spark.createDataFrame([(1, i % 20, i % 3, i / 100, 0.5, 0.25, 0.125) for i in range(60)], "flight_id long, frame_id long, class_id int, xc double, yc double, w double, h double").repartition(5)
    name = F.concat_ws("_", "flight_id", "frame_id")
    sink.write_label_files(boxes, name, path)
    assert sorted(os.listdir(path)) == sorted(f"1_{i}.txt" for i in range(20))
    assert open(f"{path}/1_0.txt").read() == "0 0.0 0.5 0.25 0.125\n1 0.4 0.5 0.25 0.125\n2 0.2 0.5 0.25 0.125\n"
    os.remove(f"{path}/1_3.txt")
    times = {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path)}
    sink.write_label_files(boxes, name, path)
    assert len(os.listdir(path)) == 20 and all(os.stat(f"{path}/{n}").st_mtime_ns == t for n, t in times.items())
    assert sorted(r["name"] for r in sink.finished(spark, path, ".txt").collect()) == sorted(f"1_{i}" for i in range(20))
    assert sink.finished(spark, path + "/none", ".txt").count() == 0


def test_a_lost_task_leaves_whole_files_only(spark, tmp_path):
    path = str(tmp_path / "out")
    late = F.when(F.col("id") == 37, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.repeat(F.lit("x"), 10_000))
    rows = spark.range(0, 40, 1, 2).select("id", late.alias("text"))
    with pytest.raises(Exception, match="lost"):
        sink.write_files(rows, F.col("id").cast("string"), F.col("text"), path, ".txt")
    left = [n for n in os.listdir(path) if n != sink.STAGING] if os.path.isdir(path) else []
    assert all(os.path.getsize(f"{path}/{n}") == 10_000 for n in left)
    whole = spark.range(0, 40, 1, 2).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    sink.write_files(whole, F.col("id").cast("string"), F.col("text"), path, ".txt")
    assert sorted(os.listdir(path)) == sorted(f"{i}.txt" for i in range(40))
    with pytest.raises(Exception, match="not a name below"):
        sink.write_files(whole.limit(1), F.lit("../up"), F.col("text"), path, ".txt", resume=False)


def test_images_and_tracks_as_files(spark, tmp_path):
    images = spark.createDataFrame([(i, 2, 1, [i] * 8) for i in range(3)], "frame_id int, width int, height int, rgba array<int>")
    sink.write_image_files(images, F.col("frame_id").cast("string"), str(tmp_path / "i"))
    got = {r["path"].split("/")[-1]: r["rgba"] for r in png.read_images(spark, str(tmp_path / "i")).collect()}
    assert got == {f"{i}.png": [i] * 8 for i in range(3)}
    boxes = spark.createDataFrame([(5, "t", 2, 0, 1, 2, 3)], "frame_id int, track_id string, class_id int, x1 int, y1 int, x2 int, y2 int")
    sink.write_track_files(boxes, ["frame_id"], F.col("frame_id").cast("string"), str(tmp_path / "j"))
    assert open(tmp_path / "j/5.json").read() == '{"t":{"animal_class":2,"axis_aligned_bbs":[0,1,2,3]}}'


def test_pixels_outside_an_image_are_left_out(spark):
    pixels = spark.createDataFrame([(1, 9, 0, 5, 5, 5, 5), (1, 1, 1, 7, 7, 7, 7), (1, 0, -1, 5, 5, 5, 5)], "k int, x int, y int, r int, g int, b int, a int")
    assert png.images_from_pixels(pixels, "k", 2, 2).first()["rgba"] == [0] * 12 + [7] * 4


@pytest.mark.parametrize("shape,size", [((1, 1), 3), ((1, 9), 4), ((7, 2), 3), ((12, 12), 4), ((13, 10), 5)])
def test_tiles_equal_the_whole_image(spark, shape, size):
    h, w = shape
    image = np.random.default_rng(h * 31 + w).normal(size=shape)
    table = spark.createDataFrame([("i", x, y, float(image[y, x])) for y in range(h) for x in range(w)], "img string, x int, y int, v double")
    pad = np.pad(image, 1, "reflect") if min(shape) > 1 else np.pad(np.pad(image, ((0, 0), (1, 1)), "reflect" if w > 1 else "edge"), ((1, 1), (0, 0)), "reflect" if h > 1 else "edge")
    want = pad[1:-1, :-2] + pad[1:-1, 2:] + pad[:-2, 1:-1] + pad[2:, 1:-1] - 4 * image
    got = {(r["x"], r["y"]): r["laplacian"] for r in tl.tiled_laplacian(table, "img", "v", w, h, size).collect()}
    assert len(got) == h * w and all(abs(got[x, y] - want[y, x]) < 1e-9 for y in range(h) for x in range(w))
    assert abs(tl.tiled_laplacian_variance(table, "img", "v", w, h, size).first()["laplacian_variance"] - want.var()) < 1e-9


def test_a_large_image_in_tiles(spark):
    """2,000 x 2,000 pixels equal the whole array's result."""
    n = 2000
    v = F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")
    rows = spark.range(0, n * n, 1, 8).select(F.lit(1).alias("img"), (F.col("id") % n).cast("int").alias("x"), F.expr(f"cast(id div {n} as int)").alias("y"), v.alias("v"))
    whole = np.empty((n, n))
    for b in rows.select("x", "y", "v").toArrow().to_batches():
        whole[b.column(1).to_numpy(), b.column(0).to_numpy()] = b.column(2).to_numpy()
    pad = np.pad(whole, 1, "reflect")
    want = (pad[1:-1, :-2] + pad[1:-1, 2:] + pad[:-2, 1:-1] + pad[2:, 1:-1] - 4 * whole).var()
    assert abs(tl.tiled_laplacian_variance(rows, "img", "v", n, n).first()["laplacian_variance"] / want - 1) < 1e-9


def test_drawn_lines(spark):
    lines = spark.createDataFrame([(1, 0, 4, [1, 1, 7, 4, 1, 4]), (1, 1, 5, [1, 4, 3, 4]), (2, 0, 1, [-2, 0, 2, 0]), (3, 0, 1, [5, 5])], "f int, o int, class_id int, coords array<int>")
    got = {}
    for r in lb.drawn(lines, ["f"], ["o"], 8, 8).collect():
        got.setdefault(r["f"], {})[r["x"], r["y"]] = r["class_id"]
    # The slanted edge from (1, 1) to (7, 4): a step right, half a step down.
    slant = {(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 4), (7, 4)}
    assert set(got[1]) == slant | {(x, 4) for x in range(1, 8)} | {(1, y) for y in range(1, 5)}
    assert {p for p, c in got[1].items() if c == 5} == {(1, 4), (2, 4), (3, 4)}
    assert set(got[2]) == {(0, 0), (1, 0), (2, 0)} and set(got[3]) == {(5, 5)}
    pixels = spark.createDataFrame([(2, x, 0, 9, 9, 9) for x in range(4)], "f int, x int, y int, r int, g int, b int")
    shown = {r["x"]: (r["b"], r["g"], r["r"]) for r in lb.drawn_on(pixels, lb.drawn(lines, ["f"], ["o"], 8, 8), ["f"]).collect()}
    assert shown == {0: (255, 102, 0), 1: (255, 102, 0), 2: (255, 102, 0), 3: (9, 9, 9)}


def test_video_in_segments(spark, tmp_path):
    from geoview.sources import video

    rng = np.random.default_rng(2)
    shapes = [rng.integers(0, 256, (3, 5, 4)) for _ in range(7)]
    for s in shapes:
        s[:, :, 3] = 255
    images = spark.createDataFrame([(i * 10, 5, 3, [int(v) for v in s.reshape(-1)]) for i, s in enumerate(shapes)], "shot long, width int, height int, rgba array<int>")
    video.write_video(images, "shot", str(tmp_path / "v"), fps=25, first_repeats=2, last_repeats=1, per_segment=4)
    names = sorted(os.listdir(tmp_path / "v"))
    assert names == ["00000000.avi", "00000001.avi", "00000002.avi"]
    shown = [px for n in names for px in video.decode_segment((tmp_path / "v" / n).read_bytes())]
    order = [0, 0, 0, 1, 2, 3, 4, 5, 6, 6]
    assert len(shown) == 10 and all((shown[i] == shapes[k]).all() for i, k in enumerate(order))
    head = (tmp_path / "v" / names[0]).read_bytes()
    assert struct.unpack("<I", head[4:8])[0] == len(head) - 8 and struct.unpack("<I", head[48:52])[0] == 4
    video.write_video(images, "shot", str(tmp_path / "w"), change=lambda px: 255 - px, per_segment=100)
    first = next(video.decode_segment((tmp_path / "w" / "00000000.avi").read_bytes()))
    assert (first[:, :, :3] == 255 - shapes[0][:, :, :3]).all()
    with pytest.raises(ValueError):
        video.write_video(images.limit(0), "shot", str(tmp_path / "x"))
    paths = spark.createDataFrame([(str(tmp_path / "v" / n),) for n in [*names, "none.avi"]], "path string")
    assert video.delete_files(spark, paths) == 3 and os.listdir(tmp_path / "v") == [n for n in os.listdir(tmp_path / "v") if n.startswith(".")]


def test_floor_lookup_of_a_hot_key(spark):
    from geoview.operators import lookups as lk

    table = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 5, "c")], "g int, k long, v string")
    probes = spark.range(3000).select((F.col("id") % 2 + 1).cast("int").alias("g"), F.when(F.col("id") < 2900, 9).when(F.col("id") < 2990, 4).alias("k").cast("long"), "id")
    one, two = (lk.floor_lookup(probes, table, "k", ["v"], by=["g"], hot_keys=h) for h in (False, True))
    key = lambda df: sorted((r["id"], r["g"], str(r["floor_key"]), str(r["v"])) for r in df.collect())
    assert one.columns == two.columns and key(one) == key(two) and len(key(one)) == 3000


def test_large_documents_in_ranges(spark, tmp_path):
    """However a document is cut, its elements are those of the whole."""
    import json
    import random

    from geoview.sources import documents as doc
    from geoview.sources.json_array import read_json_array

    rng = random.Random(6)
    odd = ['a "quoted" {brace', "back\\slash\\", 'end\\"', "[1, {2}]", "ünï", "\\\\", '"images": [', "plain"]
    images = [{"imagefile": f"{i}_{rng.choice(odd)}.png", "location": [i, 2.5, 3], "rotation": [1, 2, {} and 0 or 3], "fovy": [50.0 + i], "more": {"x": [rng.choice(odd), {"y": None}]}} for i in range(60)]
    whole = {"note": 'has "images": [ in it', "first": [1, {"images": [{"no": 1}]}], "images": images, "after": [{"images": []}, {"z": 9}], "last": {"images": [{"q": 1}]}}
    for n, text in enumerate((json.dumps(whole), json.dumps(whole, indent=1, ensure_ascii=False))):
        path = tmp_path / f"poses{n}.json"
        path.write_text(text)
        for size in (97, 1000, 1 << 20):
            got = sorted((r["position"], r["value"]) for r in read_json_array(spark, str(path), "images", size).collect())
            assert [p for p, _ in got] == list(range(60)) and [json.loads(v) for _, v in got] == images, (n, size)
        one, many = doc.read_poses(spark, str(path)), doc.read_large_poses(spark, str(path), range_bytes=500)
        assert one.columns == many.columns and sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
    (tmp_path / "list.json").write_text(json.dumps(images))
    got = sorted((r["position"], r["value"]) for r in read_json_array(spark, str(tmp_path / "list.json"), None, 211).collect())
    assert [json.loads(v) for _, v in got] == images
    (tmp_path / "none.json").write_text('{"images": []}')
    assert read_json_array(spark, str(tmp_path / "none.json"), "images", 5).count() == 0
