"""Significance tests over runs: each is a few aggregates and one row of arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelmill.functions import special
from labelmill.session import materialize


def chi_square(cells: DataFrame, row: str = "actual", column: str = "predicted") -> DataFrame:
    """Independence of two labels, from counts (row, column, n) of the cells that occur.

    With n cells, r and c totals and N pairs the statistic is N * (sum n^2 / (r c) - 1), so
    cells without pairs need no rows. One row: pairs, degrees, statistic, p_value, cramers_v.
    """
    r = cells.groupBy(row).agg(F.sum("n").alias("r"))
    c = cells.groupBy(column).agg(F.sum("n").alias("c"))
    n = F.col("n").cast("double")
    total = cells.join(r, row).join(c, column).agg(F.sum(n * n / F.col("r") / F.col("c")).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    sizes = total.withColumn("rows", r.agg(F.count("*")).scalar()).withColumn("columns", c.agg(F.count("*")).scalar())
    statistic = F.greatest(F.lit(0.0), F.coalesce(F.col("pairs") * (F.col("s") - 1), F.lit(0.0)))
    out = sizes.select("pairs", F.greatest(F.lit(0), (F.col("rows") - 1) * (F.col("columns") - 1)).alias("degrees"), statistic.alias("statistic"), F.least("rows", "columns").alias("k"))
    v = F.when(F.col("k") > 1, F.sqrt(F.col("statistic") / F.col("pairs") / (F.col("k") - 1))).otherwise(0.0)
    return out.select("pairs", "degrees", "statistic", special.chi_square_tail(F.col("statistic"), F.col("degrees")).alias("p_value"), v.alias("cramers_v"))


def mcnemar(one: DataFrame, two: DataFrame, key: str = "row_index") -> DataFrame:
    """Whether two runs over the same rows are right equally often.

    Rows that both runs answered and that have a truth count. One row: pairs, only_first and
    only_second (right in one run alone), the statistic with continuity correction, its p_value,
    and the exact p-value of the binomial test on the rows in which the runs differ.
    """
    right = lambda df, name: df.filter(F.col("success") & (F.coalesce("ground_truth", F.lit("")) != "")).select(key, (F.col("ground_truth") == F.coalesce("final_answer", F.lit(""))).alias(name))
    both = right(one, "a").join(right(two, "b"), key)
    counts = both.agg(F.count("*").alias("pairs"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(~F.col("a") & F.col("b")).alias("only_second"))
    b, c = F.col("only_first"), F.col("only_second")
    gap = F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double")
    out = counts.withColumn("statistic", F.when(b + c > 0, gap * gap / (b + c)).otherwise(0.0))
    exact = F.when(b + c > 0, special.binomial_two_sided(F.least(b, c), b + c, F.lit(0.5))).otherwise(1.0)
    return out.withColumn("p_value", special.chi_square_tail(F.col("statistic"), F.lit(1))).withColumn("exact_p_value", exact)


def binomial(df: DataFrame, hit: Column, chance: float) -> DataFrame:
    """Whether ``hit`` holds as often as ``chance`` says: exact tails and twice the smaller one.
    Rows where it is null don't count."""
    counts = df.agg(F.count(hit).alias("trials"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"))
    k, n, p = F.col("hits"), F.col("trials"), F.lit(float(chance))
    return counts.select(
        "trials", "hits", F.when(n > 0, k / n).otherwise(0.0).alias("share"), special.binomial_at_most(k, n, p).alias("p_at_most"),
        (1 - special.binomial_at_most(k - 1, n, p)).alias("p_at_least"), special.binomial_two_sided(k, n, p).alias("p_value"),
    )


def kolmogorov_smirnov(df: DataFrame, value: Column, second: Column) -> DataFrame:
    """Largest difference between the distributions of a value in two samples.

    ``second`` tells the samples apart; nulls don't count. Rows become counts per distinct
    value; these are dealt into ranges, a range's running counts start from the totals of those
    before, and no task holds more than a range. One row: first_n, second_n, statistic, p_value.
    """
    rows = df.select(value.alias("v"), second.cast("int").alias("g")).dropna()
    counts = rows.groupBy("v").agg(F.sum(1 - F.col("g")).alias("a"), F.sum("g").alias("b"))
    dealt = materialize(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "value-ranges")
    parts = dealt.groupBy("part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = parts.select("part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(n) for c, n in (("pa", "before_a"), ("pb", "before_b"))])
    upto = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.join(starts, "part").select((F.sum("a").over(upto) + F.col("before_a")).alias("fa"), (F.sum("b").over(upto) + F.col("before_b")).alias("fb"))
    n, m = F.col("n"), F.col("m")
    totals = dealt.agg(F.struct(F.sum("a").alias("n"), F.sum("b").alias("m")).alias("t"))
    gap = F.abs(F.col("fa") / F.col("t.n") - F.col("fb") / F.col("t.m"))
    out = run.withColumn("t", totals.scalar()).agg(F.max("t.n").alias("n"), F.max("t.m").alias("m"), F.max(F.when((F.col("t.n") > 0) & (F.col("t.m") > 0), gap)).alias("statistic"))
    root = F.sqrt(n * m / (n + m))
    p = F.when(F.col("statistic").isNotNull(), special.kolmogorov_tail((root + 0.12 + 0.11 / root) * F.col("statistic")))
    return out.select(F.coalesce(n, F.lit(0)).alias("first_n"), F.coalesce(m, F.lit(0)).alias("second_n"), "statistic", p.alias("p_value"))
