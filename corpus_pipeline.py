"""From raw documents to packed training windows: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessgraph.llm import jaccard, packing, quality_classifier, quality_rules, secrets
from tessgraph.llm.common import remove, shared_folder, table

#: Word shingles and percent of similarity at which documents are near-duplicates.
SHINGLE, SIMILAR = 5, 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_rows(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one with the smallest doc_id. Rows are told apart by all their columns:
    an id may be null or stand for several texts, and only rows equal in every column count as one."""
    row = "_row"
    while any(c.lower() == row for c in docs.columns):
        row += "_"
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns]))
    group = jaccard.groups(keyed.select(F.col(row).alias("doc_id"), "text"), SHINGLE, SIMILAR).select(F.col("doc_id").alias(row), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    first = keyed.select(row, "doc_id").distinct().join(group, row).groupBy("component_id").agg(F.min_by(row, order).alias(row))
    return keyed.join(first.select(row), row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("jaccard_join", near_duplicates), ("secret_scan", hide_secrets), ("packing", pack)]
#: The trained models and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result written under the session's shared checkpoint folder."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
