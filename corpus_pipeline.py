"""A training corpus from `documents`: stages applied one after the other, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, line_dedup, packing, set_join
from tidemark.llm.common import new_path
from tidemark.llm.queries import read, tokenizer_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told: no letters, or unlike every language of the corpus."""
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the last one only; documents that had text and lose all of it go."""
    kept = line_dedup.drop_repeated_lines(docs, prefix="__")
    kept = kept.filter((F.col("__n_dropped") == 0) | (F.col("__kept_text") != ""))
    new = {"text": F.col("__kept_text"), "n_chars": F.length("__kept_text").cast("long")}
    return kept.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays: the one with the smallest id."""
    return set_join.keep_one(docs)


def drop_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go; the others stay as they are."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, in sequences of power-of-two length."""
    return packing.pack_power_of_two(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", identify_languages), ("line_dedup", dedup_lines), ("set_join", drop_near_copies), ("decontaminate", drop_test_passages), ("pack", pack)]

#: Tokens, Bayesian scores and set joins are beyond SQL: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
