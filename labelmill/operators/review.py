"""Manual review: verdicts joined to records, the open queue and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelmill.operators.run_stats import ratio


def apply_verdicts(records: DataFrame, verdicts: DataFrame, key: str = "row_index") -> DataFrame:
    """Add a nullable ``verdict``; records without one stay pending."""
    return records.join(verdicts.select(key, "verdict"), key, "left")


def pending(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter(F.col("verdict").isNull())


def verification_summary(reviewed: DataFrame) -> DataFrame:
    right = F.count_if(F.col("verdict"))
    return reviewed.agg(
        F.count("verdict").alias("verified"), F.count("*").alias("total"), right.alias("correct"),
        (ratio(right, F.count("verdict")) * 100).alias("accuracy"),
    )
