"""Documents to packed training sequences: toxicity, line dedup, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns of documents.
ORACLE_SQL is None: SQL can't express the stages. tests/llm holds each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlore.llm.common import Scratch, fresh, read
from meshlore.llm.decontaminate import leaks
from meshlore.llm.line_dedup import drop_repeated_lines
from meshlore.llm.near_copies import kept_rows
from meshlore.llm.packing import pack
from meshlore.llm.toxicity import THRESHOLD, toxicity_scores


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold; the model is learned from the labels that the input has. Null texts count as empty and stay."""
    (into,) = fresh(docs, "toxicity")
    return toxicity_scores(spark, docs, read(spark, sf_dir, "labels"), into=into).filter(F.col(into) < THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that an earlier document (or place) had; rows all stay, n_chars follows the text."""
    return _same_columns(drop_repeated_lines(spark, docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more, that of the smallest id; rows without an id stay, repeated rows are one."""
    id_, key, own = fresh(docs, "kept_id", "kept_key", "own_key")
    kept = kept_rows(spark, docs).select(F.col("doc_id").alias(id_), F.col("key").alias(key))
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn(own, F.xxhash64("text"))
    named = named.join(kept, (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(key)), "left_semi").dropDuplicates(["doc_id", own]).drop(own)
    return named.union(docs.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, judged by their texts, so that rows without an id and rows that share one are judged too."""
    leak, own = fresh(docs, "leak", "own_key")
    found = leaks(spark, docs.select(F.xxhash64("text").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(leak)).distinct()
    return docs.withColumn(own, F.xxhash64("text")).join(found, F.col(own) == F.col(leak), "left_anti").drop(own)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences (packing.PIECES); null texts are empty, repeated rows are packed each."""
    return pack(spark, docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each one's result written to the shared folder and read again."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
