import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoview.llm import packing, token_files
from geoview.llm.queries import bpe_path
from geoview.llm.tokens import Encoder

ODD = ["a  b", " a", "a ", "", "x\n y", "it's 's", "é à  b", "<|endoftext|> a", "a\u00a0 b c", "日本 語", "a.. b!?! (c) 'll we'll x.y z'", "ǅ ß. ſ", None, "\n", "x \u200b y", " ", "foo.\nBar baz,\n", "A%%% b### C9", "a" * 300 + " b"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(bpe_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(docs, plain):
    texts = ODD + [r["text"] for r in docs.collect()]
    e = Encoder(bpe_path())
    for _ in range(2):  # the second time from the memo
        for t, raw in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == plain(t), t
    assert e.encode([]) == []


def test_encoder_forgets_and_stays_right(docs, plain, monkeypatch):
    monkeypatch.setattr("geoview.llm.tokens.MEMO_ENTRIES", 50)
    e = Encoder(bpe_path())
    for r in docs.limit(40).collect():
        assert np.frombuffer(e.encode([r["text"]])[0], "<u4").tolist() == plain(r["text"])


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_token_files_round_trip(spark, odd_docs, docs, plain, tmp_path):
    for n, table in enumerate((odd_docs.select("doc_id", "text", "score"), docs)):
        path = str(tmp_path / f"t{n}")
        token_files.write_token_files(table, path, bpe_path(), end_id=2)
        rows = token_files.read_token_files(spark, path).orderBy("start").collect()
        want = sorted((r for r in table.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
        at = 0
        for got, r in zip(rows, want, strict=True):
            ids = plain(r["text"]) + [2]
            assert (got["doc_id"], got["start"], got["n_tokens"], got["ids"]) == (r["doc_id"], at, len(ids), ids)
            at += len(ids)
        digests = {(r["start"]): r["ids_crc32"] for r in token_files.with_crc32(token_files.read_token_files(spark, path)).collect()}
        assert all(digests[r["start"]] == crc(r["ids"]) for r in rows)


def test_empty_token_files(spark, no_docs, tmp_path):
    token_files.write_token_files(no_docs, str(tmp_path / "e"), bpe_path(), end_id=2)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def check_pieces(pieces, docs, plain, capacity=2048):
    by_seq, by_doc = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] <= capacity
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], ids))
    for rows in by_seq.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= capacity
    seen = sorted(repr((d, sorted(x))) for d, x in by_doc.items() if len(x) == 1)
    assert seen or not pieces
    total = sum(p["length"] for p in pieces)
    assert total == sum(len(plain(r["text"])) + 1 for r in docs.collect())
    return total, len(by_seq)


def test_packing(odd_docs, docs, plain):
    check_pieces(packing.pack_documents(odd_docs, bpe_path(), 1, 2048).collect(), odd_docs, plain)
    pieces = packing.pack_documents(docs, bpe_path(), 1, 2048).collect()
    total, windows = check_pieces(pieces, docs, plain)
    assert windows <= total / 2048 * 1.02 + 2
    for r in docs.limit(20).collect():
        own = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == r["doc_id"])
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == plain(r["text"]) + [1]


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs, bpe_path(), 1, 2048).count() == 0


def test_differencing():
    assert sorted(s for s, _ in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert [s for s, _ in packing.difference([5, 5, 5, 5], 2)] == [10, 10]
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 100, 700):
        sizes = rng.integers(1, 513, n).tolist()
        windows = packing.pack(sizes, 2048)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)
        assert len(windows) <= -(-sum(sizes) // 2048) + 1 + n // 100
    assert len(packing.pack([2048] * 3, 2048)) == 3 and packing.pack([], 10) == []


def test_special_tokens_are_those_of_the_unchanged_library(spark, docs, tmp_path):
    plain = Tokenizer.from_file(bpe_path())
    ids = lambda text: plain.encode(text or "", add_special_tokens=False).ids
    end = "<|endoftext|>"
    texts = [*ODD, end, f"a{end}b", f"a {end} b", f"a {end}{end}, b", f"x\n{end}\ny", f"foo bar. {end}", f"{end}Foo 's {end[:-1]}"]
    assert any(50256 in ids(t) for t in texts)
    e = Encoder(bpe_path(), literal=False)
    for _ in range(2):  # the second time from the memo
        for t, raw in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == ids(t), t
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_token_files(table, str(tmp_path / "s"), bpe_path(), end_id=2)
    got = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, str(tmp_path / "s")).collect()}
    assert got == {i: ids(t) + [2] for i, t in enumerate(texts)}
    pieces = packing.pack_documents(table, bpe_path(), 1, 2048).collect()
    assert {p["doc_id"]: np.frombuffer(p["ids"], "<u4").tolist() for p in pieces} == {i: ids(t) + [1] for i, t in enumerate(texts)}


def test_a_hot_id_lies_in_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(4000).select(F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
        token_files.write_token_files(docs, str(tmp_path / "t"), bpe_path(), end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows) and len(rows) == 4000
    assert [r["start"] for r in rows[1:]] == np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()
    parts = spark.read.parquet(str(tmp_path / "t")).filter("doc_id = 5").select("part").distinct().count()
    assert parts > 1


def test_selective_reads_skip_pages(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some text of a document"), F.col("id").cast("string")).alias("text")).coalesce(1)
    at = str(tmp_path / "t")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_files.write_token_files(docs, at, bpe_path(), end_id=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    meta = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata
    columns = {meta.row_group(0).column(i).path_in_schema.split(".")[0]: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert meta.num_row_groups == 1 and all(c.has_column_index and c.has_offset_index for c in columns.values())
    assert columns["n_tokens"].total_compressed_size < columns["ids"].total_compressed_size / 5
    some = spark.read.parquet(at).filter("doc_id = 7777").select("doc_id", "n_tokens", "ids")
    assert [r["doc_id"] for r in some.collect()] == [7777]
    plan = some._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    scanned = leaves.apply(0).metrics().apply("numOutputRows").value()
    # One page of ids of 2,000 rows, not the row group's 20,000.
    assert 0 < scanned <= 4000
