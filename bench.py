"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each query has one warm-up and then ``BENCH_RUNS`` runs into a noop sink; its
figure is their median, and the metric is the sum of medians.  ``core_s`` is what
one core takes for a fixed loop, by which figures of different machines compare.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from geoview.queries import QUERIES

HEADLINE = [
    "track_enclosing_bbox", "frame_correction_lookup", "neighbour_window", "merged_track_bbox", "floor_lookup", "raycast_nearest",
    "world_to_pixel_persp", "pixel_integral", "auto_contrast", "laplacian_variance", "nms_greedy", "shot_pixel_sampling",
]


def core_seconds() -> float:
    start, x = time.perf_counter(), 1
    for i in range(5_000_000):
        x = (x * 31 + i) & 0xFFFFFFFF
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "core_s": core_seconds(), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
