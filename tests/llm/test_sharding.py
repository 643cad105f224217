from collections import Counter

import pytest
from pyspark.sql import functions as F

from geoview.llm.queries import QUERIES
from geoview.llm.sharding import feistel, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 50, 1000, 4097])
def test_feistel_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(feistel(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        other = [r[0] for r in spark.range(n).select(feistel(F.col("id"), n, 6).alias("p")).collect()]
        assert got != other and got != list(range(n))


def test_shards_are_even_and_gapless(spark, odd_docs, docs):
    for table in (docs, odd_docs.drop("shard", "slot", "row_number")):
        rows = shard_rows(table, 16, seed=1).collect()
        assert len(rows) == table.count()
        sizes = Counter(r["shard"] for r in rows)
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
        for s in sizes:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_order_depends_on_rows_alone(docs):
    place = lambda df: {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_rows(df, 16, seed=1).collect()}
    assert place(docs) == place(docs.repartition(7, "source"))


def test_clashing_names_and_empty_tables(odd_docs, no_docs):
    out = shard_rows(odd_docs, 4)
    assert {"shard", "shard_", "slot", "slot_", "row_number", "row_number_"} <= set(out.columns)
    assert set(r["shard"] for r in out.collect()) == {9}
    assert shard_rows(no_docs, 4).count() == 0


def test_query_is_native(spark, sf_dir):
    df = QUERIES["op1_sharding"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    row = df.filter("doc_id = 0").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id = 0").first()["text"]
    import zlib

    assert row["size"] == len(text.encode()) + 1 and row["text_crc32"] == zlib.crc32(text.encode()) and row["law"] == "rows"


def feistel_by_hand(number, n, seed):
    """The permutation in plain Python, with the hash of 64-bit numbers from its
    own library."""
    import math

    import xxhash

    def chained(*values):
        h = 42
        for v, size in values:
            h = xxhash.xxh64_intdigest(v.to_bytes(size, "little"), seed=h)
        return h - (1 << 64) if h >= 1 << 63 else h

    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    x = number
    while True:
        left, right = divmod(x, b)
        for i in range(4):
            left = (left + chained((right, 8), (2 * i, 4), (seed, 4)) % a) % a
            right = (right + chained((left, 8), (2 * i + 1, 4), (seed, 4)) % b) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [5, 77, 3000])
def test_feistel_by_hand(spark, n):
    got = [r[0] for r in spark.range(n).orderBy("id").select(feistel(F.col("id"), n, 3).alias("p")).collect()]
    assert got == [feistel_by_hand(i, n, 3) for i in range(n)]


def test_equal_rows_are_spread_over_buckets(spark, monkeypatch):
    from geoview.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = spark.range(6000).select(F.when(F.col("id") < 2000, 7).when(F.col("id") < 3000, 8).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 3000, "same").otherwise("other").alias("text"))

    def place(df):
        out = {}
        for r in shard_rows(df, 16, seed=1).collect():
            out.setdefault((r["doc_id"], r["text"]), []).append((r["shard"], r["slot"]))
        return {k: sorted(v) for k, v in out.items()}

    got = place(rows)
    assert sorted(x for v in got.values() for x in v) == sorted((s, i) for s in range(16) for i in range(375))
    assert got == place(rows.repartition(7, "text")) and len(got[(7, "same")]) == 2000
    plan = shard_rows(rows, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
