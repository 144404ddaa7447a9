"""From raw documents to a training mixture: five stages, each written as Parquet and read again as the next one's input.

Rows may repeat, texts may be NULL (empty) and the table may have further columns; they are carried along. Documents without a
doc_id leave with the exact duplicates. An empty table stays empty, but the quality model needs labelled documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalrates.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from vitalrates.llm.queries import MAX_EPOCHS, SEED, WEIGHTS
from vitalrates.session import ensure_checkpoint_dir

ORACLE_SQL = None  # the stages fit models, join on similarity and tile strings


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is listed, with all their columns."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model does not reject; the model is fitted on the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_documents(docs, quality.fit_quality(docs, labels), threshold=0.3)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id; rows that repeat a doc_id and its text become one.

    Rows of one doc_id with different texts are judged one by one: they are told apart by the text's hash.
    """
    key = ["__id", "__sha"]
    kept = exact_dedup.exact_duplicates(docs, keep="largest").where("kept")
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__sha": F.sha2(text, 256)})
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets the one with the smallest doc_id."""
    groups = ngram_join.similar_documents(docs)
    return only(docs, groups.where(F.col("doc_id") == F.col("component_id")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their domain, whole epochs, tokens of the last epoch and tokens taken."""
    chosen = mixing.mixture(docs, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED)
    new = {c: f"mix_{c}" for c in ("domain", "n_tokens", "epochs", "part", "taken")}
    picked = chosen.select("doc_id", *[F.col(c).alias(n) for c, n in new.items()]).dropDuplicates(["doc_id"])
    return docs.drop(*new.values()).join(picked, "doc_id")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", to_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what they write lies in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
