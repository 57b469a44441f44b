"""Corpus preparation: language, repeated lines, near-duplicates, benchmark passages, packing; one stored table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm.common import forget_since, kept, made_so_far
from cataloom.llm.copies import one_of_each
from cataloom.llm.decontaminate import contaminated
from cataloom.llm.langid import keep_identified, train
from cataloom.llm.lines import dedup_lines
from cataloom.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without text, or of ambiguous language go."""
    return keep_identified(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them the documents of which no word is left; n_chars follows the text."""
    cleaned = dedup_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cleaned.where(left).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) the row with the smallest id stays."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go. The text alone decides, whatever the id; equal texts go together."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    rows = docs.withColumn("__text", F.md5("text"))
    found = kept(contaminated(rows, benchmark, literal=True, id_col="__text").select("__text").distinct(), "leaks")
    return rows.join(found, "__text", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence."""
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate), ("packing", packing)]
ORACLE_SQL = None  # hashes, classifiers and token ids are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stored before the next one reads it; what a stage needed on its way is removed."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        begun = made_so_far()
        docs = kept(stage(spark, docs, sf_dir), name)
        forget_since(spark, begun, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
