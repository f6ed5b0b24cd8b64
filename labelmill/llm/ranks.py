"""Gapless positions inside groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_positions(df: DataFrame, group: list[str], key: list[str], name: str, blocks: int) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each group, in no particular order.

    A group is dealt into ``blocks`` parts by the hash of ``key``; rows are numbered inside
    a part, and a part begins where the counts of the parts before it end. Rows that are
    equal in ``key`` are numbered in any order.
    """
    part: Column = F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")
    dealt = df.withColumn("_part", part)
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    numbered = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*key)))
    return numbered.join(begin, [*group, "_part"]).withColumn(name, (F.col("_begin") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_begin")


def position_blocks(rows: int, per_block: int = 50_000) -> int:
    return max(8, -(-rows // per_block))
