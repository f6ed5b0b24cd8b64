"""Any small table as (section, item, metric, value) rows, and such rows as text.

Reports are built from these rows, so their labels are the column names of the tables.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F


def _as_text(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        return F.format_string("%.6f", c.cast("double"))
    return F.to_json(c) if kind.startswith(("struct", "map", "array")) else c.cast("string")


def section_rows(df: DataFrame, section: str, item: str | None = None) -> DataFrame:
    """One row per figure; ``item`` is the column that tells the table's rows apart.

    Doubles get six decimals, nested values are JSON, a missing figure is null.
    """
    cells = [F.struct(F.lit(n).alias("metric"), F.when(F.col(f"`{n}`").isNotNull(), _as_text(n, t)).alias("value")) for n, t in df.dtypes if n != item]
    name = F.col(f"`{item}`").cast("string") if item else F.lit("")
    return df.select(F.lit(section).alias("section"), name.alias("item"), F.explode(F.array(*cells)).alias("c")).select("section", "item", "c.*")


def all_sections(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [section_rows(df, name, item) for name, (df, item) in tables.items()])


def as_text(rows: DataFrame, title: str) -> str:
    """The rows as a document, in their order. They are collected: one row per figure of
    tables that have a row per statistic or per class."""
    found = rows.select("section", "item", "metric", F.coalesce("value", F.lit("-")).alias("value")).collect()
    blocks = [f"# {title}"]
    for (section, item), figures in groupby(found, lambda r: (r.section, r.item)):
        head = " / ".join(x.replace("_", " ") for x in (section, item) if x)
        blocks.append("\n".join([f"## {head}"] + [f"{r.metric.replace('_', ' ')} = {r.value}" for r in figures]))
    return "\n\n".join(blocks) + "\n"
