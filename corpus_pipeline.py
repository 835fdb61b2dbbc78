"""A corpus from raw documents to shards: quality, near duplicates, benchmark passages, mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but the last return the
columns of ``docs``. Columns of ``docs`` that are named as an operator's results keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chobo.llm import _names
from chobo.llm._store import drop, scratch, shared_dir, stage
from chobo.llm.decontam import contamination
from chobo.llm.mixing import mix_sources
from chobo.llm.near_dup import drop_near_duplicates
from chobo.llm.quality_classifier import score, train
from chobo.llm.sharding import shard_documents


def _set_aside(docs: DataFrame, *results: str) -> tuple[DataFrame, list]:
    """docs without columns of these names, and what selects its columns again."""
    moved, taken = {}, {*docs.columns, *results}
    for c in docs.columns:
        if c in results:
            name = c
            while name in taken:
                name = f"own_{name}"
            taken.add(name)
            moved[c] = name
    return docs.withColumnsRenamed(moved), [_names.col(moved.get(c, c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels outside the held-out quarter."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = train(docs, labels)
    docs, back = _set_aside(docs, "score", "predicted")
    return score(docs, model).filter("predicted = 1").select(*back)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, and one row of it."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth."""
    docs, back = _set_aside(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("not contaminated").select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in its order. A document that the mix takes twice is in it twice."""
    docs, back = _set_aside(docs, "mix_round", "mix_time")
    return mix_sources(docs)[0].select(*back)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of the mix with their shards: n_bytes, shard, depth, shard_bytes, shard_docs, over_limit."""
    return shard_documents(docs)[0]


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The classifier's floating-point updates are not SQL; tests/llm/test_pipeline.py holds each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what nothing reads any more is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for k, (_, apply) in enumerate(STAGES):
        with scratch(spark):
            docs = stage(apply(spark, docs, sf_dir), folder, f"stage-{k}")
        if k:
            drop(spark, folder, f"stage-{k - 1}")
    return docs
