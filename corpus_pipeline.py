"""A training corpus from documents in stages, each on all that its predecessor kept. Every stage but the last returns the
columns of documents; the last returns the packed pieces with their ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontamination, line_dedup, ngram_join, packing, quality
from tapeloom.llm.common import materialize, table, unused


def rows_of(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a table with a key of each row's own, and the key's name: a doc_id may be null, repeated or used by several texts."""
    key = unused(docs, "_row")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id())), key


def aside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs alone; columns that have names which the stage gives to its own go round it."""
    round_ = {c: unused(docs, f"_{c}") for c in docs.columns if c.lower() in names}
    return stage(docs.withColumnsRenamed(round_)).drop(*names).withColumnsRenamed({new: old for old, new in round_.items()}).select(docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows of docs; every row is scored, null and
    empty texts by the bias alone, repeated rows alike. Without labels of both kinds the bias is 0 and all rows stay."""
    weights = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return aside(docs, ("score", "predicted"), lambda rows: quality.score(rows, weights).where("predicted = 1"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them hold; n_chars follows. Documents that lose all lines stay, empty. Null
    texts stay null, rows without doc_id lose nothing, rows that repeat a doc_id count as one."""
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return aside(docs, ("n_lines", "n_dropped"), lambda rows: line_dedup.dedup_lines(rows).withColumn("n_chars", size))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id, one of them if several have it; a row without doc_id
    only if no row of its group has one. Rows that repeat a doc_id are told apart by their texts: copies are a group like
    any other, different texts are not. Rows without words are no duplicates and stay all, null texts too."""
    rows, key = rows_of(docs)
    found = ngram_join.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))
    kept = found.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{key}").alias(key))
    return rows.join(kept, key, "left_semi").select(docs.columns)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item. Each row is judged by its own text, with or without a doc_id and whatever other
    rows have its doc_id. Null or empty texts contain nothing and stay."""
    rows, key = rows_of(docs)
    leaks = decontamination.contained(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(leaks.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with their ids; a document's first line is its prompt and bears no loss."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), loss=packing.loss_limit(docs), share=packing.loss_share(F.col("text")), release=True)


STAGES = [
    ("quality classifier", good),
    ("line dedup", lines),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", unseen),
    ("packing", packed),
]
#: SQL can neither train the classifier nor encode with a tokenizer; tests/llm holds the near-duplicate stage against brute
#: force, the classifier and line dedup by their operators' own tests, and all stages on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
