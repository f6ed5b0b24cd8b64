"""Reports as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from labelmill.operators import consensus, metrics, run_stats
from labelmill.operators.sections import all_sections

# Names of the long-format report rows.
SUMMARY_METRICS = ["accuracy", "balanced_accuracy", "macro_f1", "micro_f1", "weighted_f1", "kappa", "mcc", "success_rate"]
CLASS_METRICS = [("precision", "precision"), ("recall", "recall"), ("f1_score", "f1"), ("specificity", "specificity")]
CLASS_COLUMNS = ["precision", "recall", "f1", "specificity", "npv", "jaccard"]


def _overall(results: DataFrame) -> DataFrame:
    """Summary metrics, totals and throughput side by side in one row."""
    s = metrics.report_summary(results)
    o = run_stats.totals(results, "total", "success", "failed", "success_rate", "per_second").select(F.struct("*").alias("o"))
    return s.withColumn("o", o.scalar()).select("*", "o.*").drop("o").withColumnRenamed("per_second", "throughput_per_second")


def report_long(results: DataFrame) -> DataFrame:
    """metric, value, class, type: summary, performance and per-class rows."""
    none = F.lit(None).cast("string")
    row = lambda m, v, c, t: F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), c.alias("class"), F.lit(t).alias("type"))
    top = [row(m, F.col(m), none, "summary") for m in SUMMARY_METRICS]
    top.append(row("throughput_per_second", F.col("throughput_per_second"), none, "performance"))
    head = _overall(results).select(F.explode(F.array(*top)).alias("r")).select("r.*")
    cls = F.array(*[row(m, F.coalesce(F.col(c), F.lit(0.0)) * 100, F.col("class"), "per_class") for m, c in CLASS_METRICS])
    body = metrics.report_per_class(results).filter("precision is not null").select(F.explode(cls).alias("r")).select("r.*")
    return head.unionByName(body)


def summary_section(results: DataFrame) -> DataFrame:
    """section, metric, value: formatted text."""
    t = run_stats.time_stats(results).select(F.struct("avg_ms", "p95_ms").alias("t"))
    one = _overall(results).withColumn("t", t.scalar())
    pct = lambda c: F.format_string("%.2f%%", F.col(c))
    four = lambda c: F.format_string("%.4f", F.col(c))
    rows = [
        ("Summary", "Total Items", F.col("total").cast("string")),
        ("Summary", "Success Rate", pct("success_rate")),
        ("Summary", "Accuracy", pct("accuracy")),
        ("Summary", "Balanced Accuracy", pct("balanced_accuracy")),
        ("Summary", "Macro F1", pct("macro_f1")),
        ("Summary", "Micro F1", pct("micro_f1")),
        ("Summary", "Weighted F1", pct("weighted_f1")),
        ("Summary", "Cohen's Kappa", four("kappa")),
        ("Summary", "MCC", four("mcc")),
        ("Performance", "Throughput Per Second", F.format_string("%.2f", F.col("throughput_per_second"))),
        ("Performance", "Average Response Time", F.format_string("%.3fms", F.col("t.avg_ms"))),
        ("Performance", "P95 Response Time", F.format_string("%.3fms", F.col("t.p95_ms").cast("double"))),
    ]
    packed = F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("metric"), v.alias("value")) for a, b, v in rows])
    return one.select(F.explode(packed).alias("r")).select("r.*")


def _class_table(results: DataFrame) -> DataFrame:
    """Predicted classes with their figures as fractions (0 if undefined) and how often
    they were predicted. Classes are listed even when no truth is available."""
    dist = run_stats.class_distribution(results).select("class", F.col("items").alias("support"))
    per = metrics.report_per_class(results).select("class", *CLASS_COLUMNS)
    return dist.join(per, "class", "left").select("class", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in CLASS_COLUMNS], "support")


def class_section(results: DataFrame) -> DataFrame:
    pct = [F.format_string("%.2f%%", F.col(c) * 100).alias(c) for c in CLASS_COLUMNS]
    return _class_table(results).select("class", *pct, F.col("support").cast("string").alias("support"))


def write_report_csv(results: DataFrame, path: str) -> None:
    summary_section(results).coalesce(1).write.option("header", True).csv(f"{path}/summary")
    class_section(results).coalesce(1).write.option("header", True).csv(f"{path}/per_class")


def summary_sheet(results: DataFrame) -> DataFrame:
    """metric, value as numbers."""
    names = {
        "total": "Total Items", "success_rate": "Success Rate", "accuracy": "Accuracy", "balanced_accuracy": "Balanced Accuracy",
        "macro_f1": "Macro F1", "micro_f1": "Micro F1", "weighted_f1": "Weighted F1", "kappa": "Cohen's Kappa", "mcc": "MCC",
        "throughput_per_second": "Throughput/sec",
    }
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for c, n in names.items()])
    return _overall(results).select(F.explode(rows).alias("r")).select("r.*")


def per_class_sheet(results: DataFrame) -> DataFrame:
    return _class_table(results)


def confusion_sheet(results: DataFrame, classes: list[str] | None = None, most: int = metrics.MOST_CLASSES) -> DataFrame:
    """Classes as rows and columns: those given, or the label set of at most ``most``. Open
    answers have no such sheet; ``metrics.confusion_sparse`` has a row per cell that occurs."""
    cells = metrics.confusion_counts(metrics.report_pairs(results))
    return metrics.confusion_wide(cells, metrics._class_list(cells, most) if classes is None else classes)


def report_tables(results: DataFrame) -> dict[str, tuple[DataFrame, str | None]]:
    """The small tables of a report by name, each with the column that names its rows."""
    tables: dict[str, tuple[DataFrame, str | None]] = {
        "overview": (run_stats.overview(results), None),
        "times": (run_stats.time_stats(results), None),
        "time_buckets": (run_stats.time_buckets(results), "bucket"),
        "throughput": (run_stats.throughput(results), None),
        "summary": (metrics.report_summary(results), None),
        "per_class": (_class_table(results).orderBy("class"), "class"),
        "classes": (run_stats.class_distribution(results).orderBy("class"), "class"),
        "errors": (run_stats.error_distribution(results).orderBy("error_class"), "error_class"),
        "grade": (run_stats.status_grade(results), None),
    }
    if "consensus" in results.columns:
        tables["consensus"] = (consensus.consensus_stats(results), None)
    return tables


def report_rows(results: DataFrame) -> DataFrame:
    """The whole report as (section, item, metric, value) rows; ``sections.as_text`` makes
    a document of it."""
    return all_sections(report_tables(results))


def report_stats(results: DataFrame) -> dict:
    """All statistics of a run as plain values: each is a one-row or one-row-per-class table."""
    out = {}
    for name, (df, item) in report_tables(results).items():
        found = [r.asDict(True) for r in df.collect()]
        out[name] = found if item else (found or [{}])[0]
    return out


def render_json(stats: dict) -> str:
    return json.dumps(stats, indent=2, sort_keys=True, default=str)
