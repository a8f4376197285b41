"""A training corpus from ``documents`` in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame.  ``run`` applies them in order, each result written as Parquet and read again.
All stages but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsight.llm import jaccard_join, mixing, packing, quality_classifier, store, toxicity
from veilsight.llm.training import fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window is toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, keep=fold("doc_id", 5) != 0))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the quality threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, labels, keep=fold("doc_id", 4) != 2))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's bin and place; copies of one text never share a bin."""
    return packing.pack(docs.select("doc_id", mixing.n_words("text").alias("size"), "source", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("cluster")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", one_of_each_class),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_bins),
]

#: SQL can't express trained networks; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
