"""Statistics of a finished run, from the canonical result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelmill.operators.quantiles import floor_percentiles, linear_percentiles, moments, value_counts
from labelmill.operators.sections import section_rows

TIME = "response_time_ms"

# Time classes, upper bound exclusive in milliseconds.
TIME_BUCKETS = [
    (100, "< 100ms"),
    (500, "100-500ms"),
    (1000, "500ms-1s"),
    (5000, "1-5s"),
    (15000, "5-15s"),
]
LAST_BUCKET = "> 15s"

# Grades by success rate (at least) and by mean time (below, in ms).
RATE_GRADES = [(95, "EXCELLENT"), (90, "GOOD"), (80, "ACCEPTABLE")]
RATE_FLOOR = "NEEDS IMPROVEMENT"
SPEED_GRADES = [(1000, "FAST"), (5000, "GOOD"), (15000, "MODERATE")]
SPEED_FLOOR = "SLOW"

PERCENTILES = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))


def mean_ms(total: Column, n: Column) -> Column:
    """Mean time cut to whole nanoseconds, in milliseconds."""
    size = F.nullif(n, F.lit(0))
    whole = F.floor(total / size)
    nanos = whole * 1000000 + F.floor(((total - whole * n) * 1000000) / size)
    return F.coalesce(nanos / F.lit(1e6), F.lit(0.0))


def _totals() -> dict[str, Column]:
    """Aggregates over result rows that several reports need."""
    ok, n = F.count_if(F.col("success")), F.count("*")
    per_s = ratio(n, F.sum(TIME) / 1000.0)
    return {
        "total": n,
        "success": ok,
        "failed": n - ok,
        "success_rate": ratio(ok, n) * 100,
        "total_time_ms": F.coalesce(F.sum(TIME), F.lit(0)),
        "per_second": per_s,
        "per_minute": per_s * 60,
        "per_hour": per_s * 3600,
        "avg_ms": mean_ms(F.sum(TIME), n),
    }


def totals(results: DataFrame, *names: str) -> DataFrame:
    """The named totals in one pass and one row."""
    have = _totals()
    return results.agg(*[have[k].alias(k) for k in names or have])


def overview(results: DataFrame) -> DataFrame:
    return totals(results, "total", "success", "failed", "success_rate", "total_time_ms")


def time_stats(results: DataFrame) -> DataFrame:
    """Mean, extremes, spread and percentiles over all rows, failed ones included.

    Everything comes from the counts per distinct time, so results are read once.
    """
    counts = value_counts(results, F.col(TIME))
    m = counts.agg(*moments()).select(F.struct("*").alias("m"))
    p = floor_percentiles(counts, PERCENTILES)
    return p.withColumn("m", m.scalar()).select(
        mean_ms(F.col("m.sum"), F.col("m.rows")).alias("avg_ms"), F.col("m.min").alias("min_ms"), F.col("m.max").alias("max_ms"),
        F.col("p50").alias("median_ms"), F.col("p95").alias("p95_ms"), F.col("p99").alias("p99_ms"), F.col("m.std").alias("std_ms"),
    )


def time_percentiles(results: DataFrame) -> DataFrame:
    return floor_percentiles(value_counts(results, F.col(TIME)), PERCENTILES)


def time_buckets(results: DataFrame) -> DataFrame:
    out = F.lit(LAST_BUCKET)
    for bound, name in reversed(TIME_BUCKETS):
        out = F.when(F.col(TIME) < bound, name).otherwise(out)
    return results.groupBy(out.alias("bucket")).agg(F.count("*").alias("items"))


def throughput(results: DataFrame) -> DataFrame:
    """Rows per second of summed response time, not of wall time."""
    return totals(results, "per_second", "per_minute", "per_hour")


def class_distribution(results: DataFrame) -> DataFrame:
    """Answers of successful rows; the share is of all rows."""
    counts = results.filter("success").groupBy(F.col("final_answer").alias("class")).agg(F.count("*").alias("items"))
    total = results.agg(F.count("*"))  # from file footers; a sum over all classes would rescan
    return counts.select("class", "items", (ratio(F.col("items"), total.scalar()) * 100).alias("percentage"))


def error_class(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(F.contains(low, F.lit("timeout")), "timeout")
        .when(F.contains(low, F.lit("connection")), "connection")
        .when(F.contains(low, F.lit("parse")), "parsing")
        .otherwise("other")
    )


def error_distribution(results: DataFrame) -> DataFrame:
    counts = results.filter(~F.col("success")).groupBy(error_class(F.col("error")).alias("error_class")).agg(F.count("*").alias("items"))
    total = counts.agg(F.sum("items"))
    return counts.select("error_class", "items", (ratio(F.col("items"), total.scalar()) * 100).alias("percentage"))


def _grade(value: Column, steps: list[tuple[int, str]], floor: str, at_least: bool) -> Column:
    out = F.lit(floor)
    for bound, name in reversed(steps):
        out = F.when(value >= bound if at_least else value < bound, name).otherwise(out)
    return out


def status_grade(results: DataFrame) -> DataFrame:
    stats = totals(results, "success_rate", "avg_ms")
    return stats.select(
        "success_rate",
        "avg_ms",
        _grade(F.col("success_rate"), RATE_GRADES, RATE_FLOOR, True).alias("status"),
        _grade(F.col("avg_ms"), SPEED_GRADES, SPEED_FLOOR, False).alias("performance"),
    )


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both runs and their difference (second minus first) in one row; one pass each."""
    cols = ["success", TIME]
    both = first.select(F.lit(1).alias("run"), *cols).unionByName(second.select(F.lit(2).alias("run"), *cols))
    here = lambda i: F.col("run") == i
    aggs = []
    for i in (1, 2):
        n, ok = F.count_if(here(i)), F.count_if(here(i) & F.col("success"))
        time = F.coalesce(F.sum(F.when(here(i), F.col(TIME))), F.lit(0))
        aggs += [
            n.alias(f"total_{i}"), ok.alias(f"success_{i}"), (n - ok).alias(f"failed_{i}"),
            (ratio(ok, n) * 100).alias(f"success_rate_{i}"), mean_ms(time, n).alias(f"avg_ms_{i}"),
        ]
    out = both.agg(*aggs)
    for k in ("total", "success_rate", "avg_ms"):
        out = out.withColumn(f"{k}_diff", F.col(f"{k}_2") - F.col(f"{k}_1"))
    return out


def comparison_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """The comparison as (section, item, metric, value) rows."""
    return section_rows(compare_runs(first, second), "comparison")


def dataset_profile(df: DataFrame, text: str, label: str) -> DataFrame:
    """Rows, distinct labels and text length figures in one row."""
    size = F.length(F.col(text))
    median = median_of(df, size)
    label_count = df.groupBy(label).agg(F.lit(1)).filter(F.col(label).isNotNull()).agg(F.count("*"))
    return df.agg(
        F.count("*").alias("rows"), F.avg(size).alias("mean_length"),
        F.min(size).cast("long").alias("min_length"), F.max(size).cast("long").alias("max_length"),
    ).withColumn("labels", label_count.scalar()).withColumn("median_length", median.scalar())


def median_of(df: DataFrame, value: Column) -> DataFrame:
    return linear_percentiles(df, value, {"m": 0.5}).select("m")


def label_counts(df: DataFrame, label: str, top: int | None = 10) -> DataFrame:
    """The ``top`` most frequent labels with their share (None: all); ties in label order."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("items"))
    total = df.agg(F.count("*"))
    share = ratio(F.col("items"), total.scalar()) * 100
    ranked = counts.orderBy(F.desc("items"), "label")
    return (ranked if top is None else ranked.limit(top)).select("label", "items", share.alias("percentage"))


def most_frequent(df: DataFrame, value: str) -> DataFrame:
    """The most frequent value and its count; a tie goes to the smaller value."""
    counts = df.groupBy(value).agg(F.count("*").alias("items"))
    best = F.min(F.struct((-F.col("items")).alias("neg"), F.col(value).alias("value")))
    return counts.agg(best.alias("b")).select("b.value", (-F.col("b.neg")).alias("items"))


def distinct_in_order(items: Column) -> Column:
    return F.array_distinct(items)
