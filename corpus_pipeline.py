"""A corpus pipeline: documents in, packed training sequences out.

Stages run in order, each over all that the one before kept, through a Parquet
table between them: quality classifier, language identification, near
duplicates, benchmark decontamination, packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoview.llm import decontam, langid, near_dup, packing, quality
from geoview.llm.common import free_name, held_out, written
from geoview.llm.queries import QUALITY_THRESHOLD, bpe_path

#: Below this score a text is about as near to three languages as to one, and its
#: language is taken as unknown; texts that mix two languages stay above it.
LANGUAGE_SCORE = 0.35


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~held_out(F.col("doc_id")))
    name = free_name(docs, "quality_score")
    return quality.score(docs, model, result=name).filter(F.col(name) >= QUALITY_THRESHOLD).drop(name)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, ~held_out(F.col("doc_id")))
    lang, score = free_name(docs, "found_lang"), free_name(docs, "found_score")
    found = langid.predict(docs, model, results=(lang, score))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= LANGUAGE_SCORE)).drop(lang, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = free_name(docs, "found_leaks")
    return decontam.with_leaks(docs, benchmark, result=name).filter(F.size(name) == 0).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(docs, bpe_path(), end_id=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", drop_low_quality),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: SQL expresses neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
