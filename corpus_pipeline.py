"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from globmill.llm import _common, bpe, minhash, mixing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the documents given."""
    net = toxicity.learned(docs, _common.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), net) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one with the least doc_id; five words, similarity 0.8.

    The decision is made for each row, by a hash of all its columns. A null doc_id comes after all others; rows of one
    doc_id are ordered by their hash. Rows alike in every column are one row. Texts without words are alone, so those
    rows stay. Among n rows, two different ones share a hash with probability n^2 / 2^64.
    """
    _common.small_batches(spark)
    # the hash passes over nulls, so it has to be told where they are; without a sign, differences of keys don't overflow
    own = F.xxhash64(*[F.col(k) for k in docs.columns], *[F.col(k).isNull() for k in docs.columns])
    rows = docs.withColumn("_row", F.shiftrightunsigned(own, 1))
    groups = minhash.near_duplicates(rows, "_row").select(F.col("key").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = rows.select("doc_id", "_row").distinct().join(groups, "_row").groupBy("component_id").agg(F.min(order).alias("_first"))
    return rows.dropDuplicates(["_row"]).join(first.select("_first._row"), "_row", "left_semi").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in angle brackets; n_chars follows the text."""
    _common.small_batches(spark)
    names = docs.columns
    out = docs.withColumn("text", pii.redact(F.col("text"), pii.learned(docs)))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast("long")).select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    _common.small_batches(spark)
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids of each document copy (little-endian unsigned 32-bit)."""
    out = bpe.encode_documents(docs.select("doc_id", "source", "text"), bpe.vocabulary(spark))
    return out.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can't express the classifier, the field or the merges; tests hold each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages store and their outputs are deleted as soon as the next one is written, the last one when the session ends."""
    docs, path = _common.table(spark, sf_dir, "documents"), None
    folder = f"{_common.shared_dir(spark)}/pipeline-{os.getpid()}-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        before, path = path, f"{folder}/{k}-{name}"
        with _common.tidy(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _common.delete(spark, before)
        docs = spark.read.parquet(path)
    _common.delete_at_end(spark, folder)
    return docs
