"""A training corpus from raw documents: five stages, each a written table.

Every stage works on all rows that the one before it kept. All but the last return the
columns of ``documents``; the last returns packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmill.llm import contamination, language, ngram_join, packing, substring
from labelmill.llm.steps import saved

#: Letters below which the absence of known n-grams says nothing.
SHORT = 40
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null or blank texts, texts without letters, and
    texts of SHORT letters or more without evidence for any learned language. Where no
    n-gram was learned (no labels, or too few), all texts with letters stay."""
    filters = language.learn(docs.filter(~language.held_out()))
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    unjudged = (letters > 0) & (letters < (SHORT if filters.cells.any() else 1 << 31))
    return language.identify(docs, filters).filter(F.col("lang_evidence") | unjudged).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group, that with the smallest id; rows without words stay."""
    return ngram_join.one_per_component(docs).select(*_columns(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that occur earlier. Documents of which nothing is left go; the others
    keep their text as it was unless words were removed."""
    cut = substring.deduplicate(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = cut.filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0)).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.decontaminate(docs, items).filter(~F.col("contaminated")).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("bin_packing", pack),
]

#: Language filters, components and packing have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
