"""Text quality figures before and after cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelmill.functions.text import SPACE, WORD, word_count
from labelmill.operators.run_stats import ratio


def _figures(c: Column, prefix: str = "") -> list[Column]:
    """The profile of one text column as aggregates; null and '' count as empty."""
    valid = F.length(c) > 0
    n = F.count_if(valid)
    special = F.length(F.regexp_replace(c, f"[{WORD}{SPACE}]+", ""))
    mean = lambda x: ratio(F.sum(F.when(valid, x)), n)
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    cols = {
        "total_items": F.count("*"),
        "valid_items": n,
        "empty_items": F.count("*") - n,
        "avg_length": mean(F.length(c)),
        "avg_words": mean(word_count(c)),
        "avg_special_chars": mean(special),
        "items_with_urls": F.count_if(valid & F.rlike(c, F.lit(f"https?://[^{SPACE}]"))),
        "min_length": zero(F.min(F.when(valid, F.length(c)))),
        "max_length": zero(F.max(F.when(valid, F.length(c)))),
    }
    return [x.alias(prefix + k) for k, x in cols.items()]


def quality_profile(df: DataFrame, text: str) -> DataFrame:
    return df.agg(*_figures(F.col(text)))


def before_after(df: DataFrame, before: str, after: str) -> DataFrame:
    """Both profiles in one pass, and what changed."""
    out = df.agg(*_figures(F.col(before), "before_"), *_figures(F.col(after), "after_"))
    for k in ("avg_length", "avg_special_chars"):
        b = F.col(f"before_{k}")
        out = out.withColumn(f"{k}_change", F.when(b > 0, (F.col(f"after_{k}") - b) / F.nullif(b, F.lit(0.0)) * 100))
    return out.withColumn("urls_removed", F.col("before_items_with_urls") - F.col("after_items_with_urls")).withColumn(
        "empty_change", F.col("after_empty_items") - F.col("before_empty_items")
    )
