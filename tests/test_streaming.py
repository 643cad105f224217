import json

from geoview.streaming import label_feed, windowed_track_boxes


def test_windowed_boxes(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T00:00:{s:02d}", "track_id": t, "x1": s, "y1": s, "x2": s + 5, "y2": s + 5} for s, t in ((1, "a"), (3, "a"), (4, "b"), (12, "a"))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    feed = label_feed(spark, str(tmp_path / "in"), "ts timestamp, track_id string, x1 int, y1 int, x2 int, y2 int")
    out = windowed_track_boxes(feed, "ts", "10 seconds", "5 seconds", ["track_id"])
    run = out.writeStream.format("memory").queryName("boxes").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["track_id"], r["start"].second): (r["x1"], r["x2"], r["boxes"]) for r in spark.table("boxes").collect()}
    assert got == {("a", 0): (1, 8, 2), ("b", 0): (4, 9, 1), ("a", 10): (12, 17, 1)}
