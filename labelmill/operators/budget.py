"""Token counts and budget figures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from labelmill.functions.templates import nested_get, plain
from labelmill.functions.text import word_count
from labelmill.operators.quantiles import linear_from_counts, moments_from_counts, value_counts

# Percentiles reported, and the words-to-tokens factor.
TEXT_POINTS = [5, 10, 25, 50, 75, 90, 95, 99]
FIELD_POINTS = [25, 50, 75, 90, 95]
TOKENS_PER_WORD = 1.3
LARGE_REQUESTS = [1000, 2000, 4000]


def estimated_tokens(c: Column) -> Column:
    """Words times 1.3, cut to a whole number."""
    return F.floor(word_count(c) * F.lit(TOKENS_PER_WORD))


def user_prompt(template: str, field: str, text: Column) -> Column:
    """The template with its text slot filled, or followed by the text if it has none."""
    for slot in ("{text}", "{" + field + "}"):
        if slot in template:
            head, *rest = template.split(slot)
            parts = [F.lit(head)]
            for r in rest:
                parts += [text, F.lit(r)]
            return F.concat(*parts)
    return F.concat(F.lit(template + " "), text)


def template_tokens(template: str, field: str) -> int:
    """Words left in the template when its slot is taken out."""
    return len(template.replace("{text}", "").replace("{" + field + "}", "").split())


def count_tokens(df: DataFrame, field: str, system: str, template: str, tokenizer=None) -> DataFrame:
    """Add text_tokens, request_tokens and text_missing.

    ``tokenizer`` is a picklable function from a string to a token count. It replaces
    the word estimate and runs on Arrow batches.
    """
    value = nested_get(df.schema, field)
    text = F.coalesce(value.cast("string"), F.lit(""))
    out = df.withColumn("_text", text).withColumn("text_missing", value.isNull())
    request = F.concat(F.lit(system + " "), user_prompt(template, field, F.col("_text")))
    if tokenizer is None:
        out = out.withColumn("text_tokens", estimated_tokens(F.col("_text"))).withColumn("request_tokens", estimated_tokens(request))
    else:
        @F.pandas_udf("long")
        def count(s: pd.Series) -> pd.Series:
            return s.map(tokenizer).astype("int64")

        head = F.lit(tokenizer(system)).cast("long")
        out = out.withColumn("text_tokens", count(F.col("_text"))).withColumn(
            "request_tokens", head + count(user_prompt(template, field, F.col("_text")))
        )
    return out.drop("_text")


def _stats(counts: DataFrame, points: list[int]) -> DataFrame:
    """All figures from the counts per distinct value, so texts are read once."""
    p = linear_from_counts(counts, {f"p{i}": i / 100 for i in points})
    return moments_from_counts(counts).join(F.broadcast(p), "grp").withColumnRenamed("grp", "field")  # one row per field


def token_stats(counted: DataFrame) -> DataFrame:
    """Mean, spread, percentiles and quartile range of text and request tokens."""
    both = counted.select(F.explode(F.create_map(
        F.lit("text"), F.col("text_tokens"), F.lit("request"), F.col("request_tokens")
    )).alias("field", "tokens"))
    out = _stats(value_counts(both, F.col("tokens"), F.col("field")), TEXT_POINTS)
    return out.drop("rows", "sum").withColumn("iqr", F.col("p75") - F.col("p25"))


def field_stats(df: DataFrame, fields: list[str]) -> DataFrame:
    """Word counts of further fields; empty ones are counted but left out of the figures."""
    def words_of(name: str) -> Column:
        parts = name.split(".")
        dtype = df.schema
        for p in parts:
            dtype = dtype[p].dataType
        return word_count(F.coalesce(plain(F.col(name), dtype), F.lit(""))).cast("long")

    pairs = [x for f in fields for x in (F.lit(f), words_of(f))]
    long = df.select(F.explode(F.create_map(*pairs)).alias("field", "tokens"))
    counts = value_counts(long, F.col("tokens"), F.col("field"))
    sizes = counts.groupBy("grp").agg(F.sum("n").alias("total")).withColumnRenamed("grp", "field")
    stats = _stats(counts.filter("v > 0"), FIELD_POINTS).drop("sum").withColumnRenamed("rows", "valid")
    return stats.join(F.broadcast(sizes), "field")  # one row per field


def budget_summary(counted: DataFrame) -> DataFrame:
    r = F.col("request_tokens")
    return counted.agg(
        F.sum(r).alias("total_tokens"),
        F.avg(r).alias("avg_tokens"),
        *[F.count_if(r > n).alias(f"above_{n}") for n in LARGE_REQUESTS],
        F.count_if(F.col("text_missing")).alias("missing_text"),
    )


def message_tokens(text: Column, tool_calls: Column | None = None) -> Column:
    """A quarter of the bytes, plus 10 per message and 20 per tool call."""
    quarter = lambda c: F.floor(F.coalesce(F.octet_length(c), F.lit(0)) / 4)
    out = quarter(text) + 10
    if tool_calls is not None:
        one = lambda t: quarter(t["function"]["name"]) + quarter(t["function"]["arguments"]) + 20
        out = out + F.aggregate(F.coalesce(tool_calls, F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")), F.lit(0).cast("long"), lambda acc, t: acc + one(t))
    return out


def conversation_tokens(messages: DataFrame, conv: str = "conv_id", text: str = "text") -> DataFrame:
    return messages.groupBy(conv).agg(F.sum(message_tokens(F.col(text))).alias("estimated_tokens"), F.count("*").alias("messages"))
