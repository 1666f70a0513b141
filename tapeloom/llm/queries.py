"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, embedding_dedup, hard_negatives, html_text, line_dedup, ngram_join, packing, pii, quality, sharding, suffix_dedup, token_store
from .common import table, work_dir


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", sharding.names()).select("doc_id", "slot", "shard")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", line_dedup.sha256_text(F.col("text")).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), loss=packing.loss_limit(docs), ids=False, share=packing.loss_share(F.col("text"))).drop("ids")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeats")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.spans(table(spark, sf_dir, "documents")))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read(spark, folder, ids=False)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), hard_negatives.relabelled())


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_ngram_join, op3_sharding, op4_line_dedup, op5_packing, op6_suffix_dedup, op7_quality, op8_pii, op9_token_store, op10_embedding_dedup, op11_hard_negatives, op12_html_text, op13_collocations)}
ORACLES = {"op1_decontamination": decontamination.ORACLE, "op2_ngram_join": ngram_join.ORACLE, "op10_embedding_dedup": embedding_dedup.ORACLE, "op3_sharding": sharding.oracle(), "op4_line_dedup": line_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE}
