import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoview.config import LABEL_COLORS, PipelineSettings
from geoview.sources import documents as doc
from geoview.sources import glb, png, remote


def save(path, content):
    path.write_text(json.dumps(content))
    return str(path)


def test_poses(spark, tmp_path):
    images = [
        {"imagefile": "a.png", "location": [1, 2, 3], "rotation": [0, 0, 90], "fovy": [42.5]},
        {"image": "b.png", "pos": [4, 5, 6], "quaternion": [0, 0, 0, 1], "fov": 30},
        {"file": "c.png", "loc": [7, 8, 9], "rot": [10, 20, 30]},
    ]
    at = save(tmp_path / "poses.json", {"images": images})
    got = doc.read_poses(spark, at, image_dir="/img").orderBy("frame_id").collect()
    assert [r["image"] for r in got] == ["/img/a.png", "/img/b.png", "/img/c.png"] and [r["fovy"] for r in got] == [42.5, 30, 50]
    assert got[0]["quaternion"] == pytest.approx([0, 0, 2**-0.5, 2**-0.5]) and got[1]["quaternion"] == [0, 0, 0, 1]
    assert doc.read_poses(spark, at, count=2).count() == 2
    for broken in ({"location": [1, 2, 3], "rotation": [0, 0, 0]}, {"file": "x", "rotation": [0, 0, 0]}, {"file": "x", "pos": [0, 0, 0], "rot": [1, 2]}):
        with pytest.raises(Exception):
            doc.read_poses(spark, save(tmp_path / "bad.json", {"images": [broken]})).collect()


def test_export(spark, tmp_path):
    flights = lambda n: {"f1": {"nr_of_frames_before_current": n, "nr_of_frames_after_current": 2, "labels": {"deer": {"7": {"coordinates": [1, 2, 3, 4, 1, 2], "label": "Q1", "track": "t1"}}}}}
    at = save(tmp_path / "export.json", {"metadata": {"neighbor_frame_fps": 5, "labels": {"0": "Q1", "1": "Q2", "2": "Q1"}}, "missions": {"m1": {"flights": flights(1)}, "m2": {"flights": flights(9)}}})
    export = doc.read_export(spark, at)
    f = doc.export_flights(export)
    row = f.first()
    assert f.count() == 1 and (row["before"], row["after"], row["stride"]) == (9, 2, 5)
    state = doc.frame_states(f).first()
    assert (state["frame_id"], state["label"], state["track"]) == (7, "Q1", "t1")
    assert {r["label"]: r["class_id"] for r in doc.label_ids(export).collect()} == {"Q1": 2, "Q2": 1}


def test_corrections(spark, tmp_path):
    xyz = lambda v: {"x": v, "y": 0.0, "z": 0.0}
    one = {"start frame": 3, "end frame": 9, "translation": xyz(1.5), "rotation": xyz(0.1)}
    at = save(tmp_path / "c.json", {"corrections": {"f1": [one, one]}})
    got = doc.read_corrections(spark, at).orderBy("pos").collect()
    assert [(r["flight_id"], r["pos"], r["lo"], r["hi"], r["tx"], r["rx"]) for r in got] == [("f1", 0, 3, 9, 1.5, 0.1), ("f1", 1, 3, 9, 1.5, 0.1)]
    both = save(tmp_path / "b.json", {"corrections": [one], "default": {"translation": xyz(7.0), "rotation": xyz(0.0)}})
    rows, default = doc.read_flight_corrections(spark, both, "f")
    assert rows.count() == 1 and default.first()["tx"] == 7.0
    rows, default = doc.read_flight_corrections(spark, save(tmp_path / "d.json", {"translation": xyz(8.0), "rotation": xyz(0.0)}), "f")
    assert rows.count() == 0 and default.first()["tx"] == 8.0


def test_yolo_files(spark, tmp_path):
    (tmp_path / "f1_12.txt").write_text("0 0.5 0.5 0.1 0.2\nnot a box\n\n 3  0.1\t0.2 0.3 0.4 \n1 2 3\n")
    got = doc.read_yolo(spark, str(tmp_path)).orderBy("class_id").collect()
    assert [(r["flight_id"], r["frame_id"], r["class_id"], r["xc"]) for r in got] == [("f1", 12, 0, 0.5), ("f1", 12, 3, 0.1)]
    boxes = spark.createDataFrame([("val", 4, 1, 0.5, 0.5, 0.25, 0.125)], "split string, frame_id int, class_id int, xc double, yc double, w double, h double")
    doc.write_yolo(boxes, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == "1 0.5 0.5 0.25 0.125"


def test_listing_and_legacy(spark, tmp_path):
    for name in ("f1_3.png", "f2_4.jpg", "f1_5.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {(r["flight_id"], r["frame_id"]) for r in doc.image_listing(spark, str(tmp_path)).collect()}
    assert got == {("f1", 3), ("f2", 4)} and doc.image_listing(spark, str(tmp_path), "f1").count() == 1
    (tmp_path / "old").mkdir()
    at = save(tmp_path / "old" / "labels.json", [{"states": [{"frameIdx": 2, "pxlCoordinates": [{"x": 1, "y": 2}]}]}])
    assert doc.legacy_labels(spark, at).first()["frame_id"] == 2


def mesh():
    points = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.5), (1.0, 1.0, 0.25)]
    # Interleaved with texture coordinates: 20 bytes from vertex to vertex.
    body = b"".join(struct.pack("<5f", *p, i / 4, 1 - i / 4) for i, p in enumerate(points)) + struct.pack("<6H", 0, 1, 2, 1, 3, 2)
    info = {
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "TEXCOORD_0": 1}, "indices": 2}]}],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 4},
            {"bufferView": 0, "byteOffset": 12, "componentType": 5126, "type": "VEC2", "count": 4},
            {"bufferView": 1, "componentType": 5123, "type": "SCALAR", "count": 6},
        ],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 80, "byteStride": 20}, {"buffer": 0, "byteOffset": 80, "byteLength": 12}],
    }
    text = json.dumps(info).encode()
    text += b" " * (-len(text) % 4)
    chunks = struct.pack("<II", len(text), glb.JSON_CHUNK) + text + struct.pack("<II", len(body), glb.BINARY_CHUNK) + body
    return b"glTF" + struct.pack("<II", 2, 12 + len(chunks)) + chunks


def test_glb(spark, tmp_path):
    at = tmp_path / "m.glb"
    at.write_bytes(mesh())
    glb.register(spark)
    v = spark.read.format("glb").option("part", "vertices").load(str(at)).orderBy("vid").collect()
    assert [(r["x"], r["y"], r["z"]) for r in v][2] == (0.0, 1.0, 0.5) and v[1]["u"] == 0.25
    t = glb.read_glb(spark, str(at), "triangles").orderBy("tid").collect()
    assert [(r["a"], r["b"], r["c"]) for r in t] == [(0, 1, 2), (1, 3, 2)]
    with pytest.raises(ValueError):
        glb.chunks(b"nothing here")


def uri(data, kind="application/octet-stream"):
    return f"data:{kind};base64," + base64.b64encode(data).decode()


def embedded_mesh(**more):
    """A triangle in JSON: zeros, of which two points are stored sparsely."""
    body = struct.pack("<2H", 1, 2) + struct.pack("<6f", 1, 0, 0, 0, 2, 0.5)
    return {
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}} | ({"material": 0} if more else {})]}],
        "accessors": [{"componentType": 5126, "type": "VEC3", "count": 3, "sparse": {"count": 2, "indices": {"bufferView": 0, "componentType": 5123}, "values": {"bufferView": 1}}}],
        "bufferViews": [{"byteLength": 4}, {"byteOffset": 4, "byteLength": 24}],
        "buffers": [{"byteLength": 28, "uri": uri(body)}],
    } | more


def test_embedded_gltf(spark, tmp_path):
    at = save(tmp_path / "m.gltf", embedded_mesh())
    v = glb.read_glb(spark, at).orderBy("vid").collect()
    assert [(r["x"], r["y"], r["z"], r["u"]) for r in v] == [(0, 0, 0, None), (1, 0, 0, None), (0, 2, 0.5, None)]
    assert [(r["a"], r["b"], r["c"]) for r in glb.read_glb(spark, at, "triangles").collect()] == [(0, 1, 2)]
    assert glb.mesh_rows(json.dumps({"asset": {}}).encode(), "vertices") == []
    with pytest.raises(ValueError):
        glb.chunks(json.dumps({"buffers": [{"uri": "elsewhere.bin"}]}).encode())


def test_textures(spark, tmp_path):
    image = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4)
    color = {"materials": [{"pbrMetallicRoughness": {"baseColorTexture": {"index": 0}}}]}
    file = png.encode(image)
    save(tmp_path / "uri.gltf", embedded_mesh(**color, images=[{"uri": uri(file, "image/png")}]))
    inside = embedded_mesh(**color, textures=[{"source": 1}], images=[{}, {"bufferView": 2}])
    inside["buffers"].append({"uri": uri(b"..." + file)})
    inside["bufferViews"].append({"buffer": 1, "byteOffset": 3, "byteLength": len(file)})
    save(tmp_path / "view.gltf", inside)
    save(tmp_path / "plain.gltf", embedded_mesh())
    save(tmp_path / "none.gltf", {"asset": {}})
    save(tmp_path / "jpg.gltf", embedded_mesh(**color, images=[{"uri": uri(b"no image")}]))
    (tmp_path / "m.glb").write_bytes(mesh())
    got = {r["path"].rsplit("/", 1)[1]: r for r in glb.read_textures(spark, str(tmp_path)).collect()}
    for name in ("uri.gltf", "view.gltf"):
        assert (got[name]["width"], got[name]["height"]) == (3, 2) and got[name]["rgba"] == image[::-1].reshape(-1).tolist()
    for name in ("plain.gltf", "m.glb"):
        rgba = np.array(got[name]["rgba"]).reshape(64, 64, 4)
        assert rgba[7, 7].tolist() == [255, 0, 255, 255] and rgba[7, 8].tolist() == [0, 0, 0, 255] and rgba[8, 8].tolist() == [255, 0, 255, 255]
    assert got["none.gltf"]["rgba"] is None and "no mesh" in got["none.gltf"]["error"]
    assert got["jpg.gltf"]["rgba"] is None and got["jpg.gltf"]["error"]


def test_remote(spark, tmp_path):
    root = str(tmp_path)
    store = remote.FolderStore(root)
    seen = []
    assert remote.upload(store, "a/m.glb", b"data", progress=seen.append) and not remote.upload(store, "a/m.glb", b"other") and seen == [4]
    assert remote.exists(store, "a/m.glb") and not remote.exists(store, "a/none")
    assert {i.path for i in remote.walk(store)} == {"a", "a/m.glb"} and len(list(remote.walk(store, depth=1))) == 1
    assert store.rename("a/m.glb", "n.glb") and not store.rename("a/m.glb", "x")
    paths = spark.createDataFrame([("a/n.glb",), ("a/none.glb",)], "path string")
    got = {r["path"]: r["content"] for r in remote.read_remote(paths, lambda: remote.FolderStore(root)).collect()}
    assert bytes(got["a/n.glb"]) == b"data" and got["a/none.glb"] is None


def test_settings():
    s = PipelineSettings.from_env({"SPLITS": "a, b", "NMS_IOU": "0.4", "ADD_BACKGROUND": "0", "ROTATION_LIMIT": "180", "ROTATION_LIMIT_RADIAN": "0"})
    assert s.splits == ("a", "b") and s.nms_iou == 0.4 and s.add_background is False and s.rotation_radians == pytest.approx(3.14159265, abs=1e-6)
    assert len(LABEL_COLORS) == 6 and PipelineSettings.from_env({}) == PipelineSettings()


def test_checkerboard_and_names(spark):
    got = doc.checkerboard(spark, 2, 1, (1, 2), (3, 4)).orderBy("y", "x").collect()
    assert [r["c0"] for r in got] == [1, 3, 3, 1] and doc.checkerboard(spark, 0, 5, (1,), (0,)).count() == 0
    with pytest.raises(ValueError):
        doc.checkerboard(spark, 1, 1, (1,), (0, 0))
    assert spark.range(1).select(doc.file_names(F.lit(3), "png").alias("n")).first()["n"] == "3.png"


def test_png(spark, tmp_path):
    import zlib

    import numpy as np

    from geoview.sources import png

    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    assert (png.decode(png.encode(image)) == image).all()
    part = lambda kind, c: struct.pack(">I", len(c)) + kind + c + struct.pack(">I", zlib.crc32(kind + c))

    def filtered(px):
        """RGB lines, each with another filter."""
        h, w, n = px.shape
        p, lines = px.astype(int), []
        for y in range(h):
            row = []
            for x in range(w):
                for c in range(n):
                    a = p[y, x - 1, c] if x else 0
                    b = p[y - 1, x, c] if y else 0
                    d = p[y - 1, x - 1, c] if x and y else 0
                    near = min((abs(a + b - d - v), i, v) for i, v in enumerate((a, b, d)))[2]
                    row.append((p[y, x, c] - (0, a, b, (a + b) // 2, near)[y % 5]) % 256)
            lines.append(bytes([y % 5, *row]))
        return b"".join(lines)

    rgb = rng.integers(0, 256, (10, 6, 3), dtype=np.uint8)
    data = png.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(filtered(rgb))) + part(b"IEND", b"")
    assert (png.decode(data)[:, :, :3] == rgb).all() and (png.decode(data)[:, :, 3] == 255).all()
    (tmp_path / "a.png").write_bytes(data)
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in png.read_images(spark, str(tmp_path)).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"], len(got["a.png"]["rgba"])) == (6, 10, 240) and got["b.png"]["rgba"] is None and got["b.png"]["error"]
    pixels = spark.createDataFrame([("k", 0, 0, 1, 2, 3, 255), ("k", 1, 1, 9, 8, 7, 6)], "k string, x int, y int, r int, g int, b int, a int")
    out = png.encode_images(png.images_from_pixels(pixels, "k", 2, 2), "k").first()
    back = png.decode(bytes(out["content"]))
    assert back[0, 0].tolist() == [1, 2, 3, 255] and back[1, 1].tolist() == [9, 8, 7, 6] and back[0, 1].tolist() == [0, 0, 0, 0]
    assert spark.range(1).select(png.data_uri_bytes(F.lit("data:image/png;base64,aGk=")).alias("b")).first()["b"] == b"hi"


def png_file(width, height, depth, color, lines, interlace=0, **more):
    part = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    head = part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace))
    return png.SIGNATURE + head + b"".join(part(k.encode(), v) for k, v in more.items()) + part(b"IDAT", zlib.compress(b"".join(b"\0" + line for line in lines))) + part(b"IEND", b"")


def test_png_depths():
    wide = np.arange(5 * 3 * 3).reshape(3, 5, 3) * 1400
    got = png.decode(png_file(5, 3, 16, 2, [row.astype(">u2").tobytes() for row in wide], tRNS=wide[1, 2].astype(">u2").tobytes()))
    assert (got[:, :, :3] == wide // 256).all() and got[1, 2, 3] == 0 and (got[:, :, 3] == 0).sum() == 1
    # Eleven pixels of one bit and five of two: the last byte is not full.
    assert png.decode(png_file(11, 1, 1, 0, [bytes([0b10110011, 0b01000000])]))[0, :, 0].tolist() == [255, 0, 255, 255, 0, 0, 255, 255, 0, 255, 0]
    assert png.decode(png_file(5, 1, 2, 0, [bytes([0b00011011, 0b10000000])]))[0, :, 1].tolist() == [0, 85, 170, 255, 170]
    palette = bytes(range(12))
    assert png.decode(png_file(3, 1, 4, 3, [bytes([0x31, 0x20])], PLTE=palette, tRNS=bytes([9, 8])))[0].tolist() == [[9, 10, 11, 255], [3, 4, 5, 8], [6, 7, 8, 255]]
    for color, depth in ((2, 4), (7, 8)):
        with pytest.raises(ValueError):
            png.decode(png_file(1, 1, depth, color, [b"\0" * 8]))
    with pytest.raises(ValueError):
        png.decode(png_file(9, 9, 8, 2, [b"\0" * 27]))


@pytest.mark.parametrize("width,height", [(1, 1), (3, 2), (8, 8), (13, 9)])
def test_interlaced_png(width, height):
    image = np.random.default_rng(width).integers(0, 256, (height, width, 4), dtype=np.uint8)
    starts = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    lines = [row.tobytes() for x, y, dx, dy in starts if x < width for row in image[y::dy, x::dx]]
    assert (png.decode(png_file(width, height, 8, 6, lines, 1)) == image).all()
