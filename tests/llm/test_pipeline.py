import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from geoview.llm.common import written


def test_stages_keep_the_columns(spark, sf_dir, docs):
    table = docs.withColumns({"score": F.lit(1), "node": F.lit("n"), "leaks": F.lit(2.0)})
    before = table.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, table, sf_dir), name)
        assert out.columns == table.columns and 0 < out.count() <= before
        table, before = out, out.count()


def test_run(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have 11 labels of class 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r["doc_id"] for r in pieces}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [flat(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not [d for d in kept if any(f" {i} " in f" {flat(texts[d])} " for i in items)]
    assert len({flat(texts[d]) for d in kept}) == len(kept)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    bad = [d in kept for d, q in labels.items() if q == 0]
    assert np.mean(bad) < 0.3
    assert len(kept) >= 0.6 * len(texts)


def test_odd_documents(spark, sf_dir, odd_docs, no_docs):
    for table in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, table, sf_dir), name)
            assert out.columns == table.columns
        assert corpus_pipeline.pack(spark, table, sf_dir).count() >= table.count()
