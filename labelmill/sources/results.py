"""Saved runs, whatever sink wrote them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labelmill.schema import RESULT


def canonical(df: DataFrame, time_unit: str = "ms") -> DataFrame:
    """Rename the older field names and bring times to milliseconds.

    Columns that are not result fields stay as they are.
    """
    out = df
    renames = {"index": "row_index", "inference_success": "success", "response_time": "response_time_ms"}
    for old, new in renames.items():
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    if "response_time_ms" in out.columns:
        t = F.col("response_time_ms").cast("long")
        out = out.withColumn("response_time_ms", F.floor(t / 1000000) if time_unit == "ns" else t)
    simple = {f.name: f.dataType for f in RESULT if f.name in out.columns and f.dataType.typeName() in ("string", "long", "boolean")}
    return out.withColumns({n: F.col(n).cast(t) for n, t in simple.items()}) if simple else out


def load_results(spark: SparkSession, path: str, time_unit: str = "ms", lines: bool = False) -> DataFrame:
    """An object with ``results``, a bare array, or JSON Lines."""
    raw = spark.read.option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    kind = raw.schema["results"].dataType if "results" in raw.columns else None
    if not lines and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        raw = raw.select(F.inline("results"))
    return canonical(raw, time_unit)
