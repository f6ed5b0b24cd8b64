"""Result tables on disk. Every writer is a distributed write of a projection."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from labelmill.operators import consensus, metrics, run_stats
from labelmill.schema import RESULT_COLUMNS

KEY = "row_index"
FORMATS = ["json", "csv", "parquet"]


def _parts(with_truth: bool, with_thinking: bool, with_raw: bool = True) -> list[tuple[str, str]]:
    """(result column, name on disk) in file order."""
    out = [("raw_response", "raw_response")] if with_raw else []
    if with_thinking:
        out.append(("thinking_content", "thinking_content"))
    out += [("response_time_ms", "response_time"), ("success", "inference_success"), ("final_answer", "final_answer")]
    if with_truth:
        out.append(("ground_truth", "ground_truth"))
    return out


def _originals(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESULT_COLUMNS]


def _flat(df: DataFrame, name: str):
    """A column as text; nested values as JSON."""
    nested = isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType))
    return (F.to_json(F.col(name)) if nested else F.col(name).cast("string")).alias(name)


def csv_projection(results: DataFrame, with_truth: bool = False, with_thinking: bool = False, with_raw: bool = True) -> DataFrame:
    """Sorted original columns, then the result columns."""
    parts = [F.col(a).alias(b) for a, b in _parts(with_truth, with_thinking, with_raw)]
    return results.select(*[_flat(results, c) for c in sorted(_originals(results))], *parts)


def write_csv(results: DataFrame, path: str, **options) -> None:
    writer = csv_projection(results, **options).write.option("header", True).option("escape", "\"").option("quoteAll", True)
    # The writer would otherwise trim cell contents.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def json_projection(results: DataFrame, with_truth: bool = False) -> DataFrame:
    """Result fields, then original columns; an original named like a field on disk gets
    the prefix ``orig_`` instead of overwriting it."""
    names = {"row_index": "index", "success": "inference_success", "response_time_ms": "response_time"}
    fields = [c for c in RESULT_COLUMNS if c in results.columns and (with_truth or c != "ground_truth")]
    taken = {names.get(c, c) for c in RESULT_COLUMNS}
    own = [F.col(c).alias(names.get(c, c)) for c in fields]
    return results.select(*own, *[F.col(c).alias(f"orig_{c}" if c in taken else c) for c in _originals(results)])


def run_summary(results: DataFrame, metric: str | None = None, classes: list[str] | None = None, average: str = "", repeat: int = 1) -> DataFrame:
    """Totals, the live metric and voting figures of a run, in one row."""
    out = run_stats.overview(results).select("total", "success", "failed")
    if metric:
        m = metrics.live_metric(results, metric, classes or metrics.live_classes(None, None), average)
        out = out.withColumn("live_metrics", m.select(F.struct("metric_name", "metric_value")).scalar())
    if repeat > 1:
        s = consensus.consensus_summary(results, repeat)
        out = out.withColumn("consensus_stats", s.select(F.struct("*")).scalar())
    return out


def write_json(results: DataFrame, path: str, with_truth: bool = False, **summary) -> None:
    """JSON Lines under ``results``, the summary row under ``summary``."""
    json_projection(results, with_truth).write.json(f"{path}/results")
    run_summary(results, **summary).write.json(f"{path}/summary")


def enriched(original: DataFrame, results: DataFrame, with_truth: bool = False, with_thinking: bool = False, cut_unprocessed: bool = False) -> DataFrame:
    """The input's own columns and types plus the result columns.

    Rows without a result get null texts, time 0 and success false. ``cut_unprocessed``
    leaves out rows past the largest processed position; by default every row is kept.
    """
    parts = _parts(with_truth, with_thinking)
    slim = results.select(KEY, *[F.col(a).alias(f"_r_{b}") for a, b in parts])
    filler = {"response_time": F.lit(0), "inference_success": F.lit(False)}
    value = lambda b: (F.coalesce(f"_r_{b}", filler[b]) if b in filler else F.col(f"_r_{b}")).alias(b)
    if cut_unprocessed:
        original = original.filter(F.col(KEY) <= results.agg(F.max(KEY)).scalar())
    joined = original.join(slim, KEY, "left")
    return joined.select(*[c for c in original.columns], *[value(b) for _, b in parts])


def write_parquet_enriched(original: DataFrame, results: DataFrame, path: str, **options) -> None:
    enriched(original, results, **options).drop(KEY).write.parquet(path)


def flat_parquet(results: DataFrame, with_truth: bool = False, with_thinking: bool = False) -> DataFrame:
    """index, result columns, and every original column as text."""
    parts = [F.col(a).alias(b) for a, b in _parts(False, with_thinking)]
    truth = [F.col("ground_truth")] if with_truth else []
    return results.select(F.col(KEY).alias("index"), *parts, *truth, *[_flat(results, c) for c in _originals(results)])


def write_parquet_new(results: DataFrame, path: str, **options) -> None:
    if results.isEmpty():
        raise ValueError("no results to save")
    flat_parquet(results, **options).write.parquet(path)


def run_path(directory: str, now: datetime.datetime | None = None) -> str:
    return f"{directory.rstrip('/')}/results_{(now or datetime.datetime.now()):%Y%m%d_%H%M%S}"


def write_results(results: DataFrame, directory: str, fmt: str, original: DataFrame | None = None, **options) -> str:
    """Write in the named format below a time-stamped folder; the folder is returned."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported output format: {fmt}")
    path = run_path(directory)
    if fmt == "json":
        write_json(results, path, **options)
    elif fmt == "csv":
        write_csv(results, path, **options)
    elif original is not None:
        write_parquet_enriched(original, results, path, **options)
    else:
        write_parquet_new(results, path, **options)
    return path
