"""Continuing an interrupted run: the written results are the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def remaining(rows: DataFrame, done: DataFrame, key: str = "row_index", retry_failed: bool = False) -> DataFrame:
    """Rows without a result; failed rows count as done unless they are to be retried."""
    if retry_failed:
        done = done.filter("success")
    return rows.join(done.select(key), key, "left_anti")


def merge_results(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def enrich_original(rows: DataFrame, results: DataFrame, key: str = "row_index") -> DataFrame:
    return rows.join(results, key, "left")


def resume_state(rows: DataFrame, done: DataFrame, key: str = "row_index") -> DataFrame:
    """completed, total and remaining counts in one row, and whether anything is to do."""
    marks = done.select(key).distinct().withColumn("_done", F.lit(1))
    out = rows.select(key).join(marks, key, "left").agg(
        F.count("_done").alias("completed"), F.count("*").alias("total")
    )
    left = F.col("total") - F.col("completed")
    state = F.when(F.col("completed") == 0, "new").when(left == 0, "complete").otherwise("partial")
    return out.withColumn("remaining", left).withColumn("state", state)
