"""A corpus pipeline of five stages over `documents`.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
Stages but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberplan.llm import budget, cotrain, jaccard, packing, templates
from emberplan.llm.common import BROADCAST_ENTRIES, collect_garbage, delete, materialise, work_dir
from emberplan.llm.queries import LEVELS, WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_clean_heaps(stage):
    """The stage, begun after executors have given back what the one before filled with garbage."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_clean_heaps
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Null and empty texts are scored like any others, repeated rows alike. Without labels of both
    classes all stay. An empty table stays empty.
    """
    model = cotrain.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.classify(docs.select(COLUMNS), model, only_kept=True).select(COLUMNS)


@in_clean_heaps
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of recurring templates; n_chars is counted again.

    Every row stays, those with null and empty texts and repeated ones too.
    """
    out = templates.drop_templates(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@in_clean_heaps
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the least key, a hash of id and text.

    Keys to remove go to the tasks if they are few enough, so that texts needn't be shuffled.
    Rows of one id and text are one document, of which one row stays; an id that has several
    texts is several documents, and a missing id is one like any other. Texts without a word have
    no copies but rows of their own id.
    """
    docs = docs.select(COLUMNS).withColumn("__key", F.xxhash64("doc_id", "text"))
    groups = jaccard.similarity_components(docs, "__key").groupBy(F.col("doc_id").alias("key"))
    groups = materialise(groups.agg(F.min("component_id").alias("component"), F.count("*").alias("rows")), "groups")

    def keyed(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= BROADCAST_ENTRIES else keys

    gone = groups.where("key <> component").select(F.col("key").alias("__key"))
    out = docs.join(keyed(gone), "__key", "left_anti")
    again = groups.where("key = component and rows > 1").select(F.col("key").alias("__key"))
    if not again.isEmpty():
        again = keyed(again)
        out = out.join(again, "__key", "left_anti").unionByName(out.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return out.select(COLUMNS)


@in_clean_heaps
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that target weights by domain, language and source pay for, once each.

    Null names are names of their own. Rows without a word cost nothing; equal rows come or stay
    away together. An empty table stays empty.
    """
    return budget.mix(docs.select(COLUMNS), LEVELS, WEIGHTS, fraction=0.8, max_epochs=1).select(COLUMNS)


@in_clean_heaps
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    Null texts have their end id only; repeated rows are documents of their own.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mix_sources),
    ("packing", pack_windows),
]

#: Trained scores, hashed orders and a tokenizer are not to be had in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = work_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            delete(spark, f"{base}/{i - 1}")
    return docs
