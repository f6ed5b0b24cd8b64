"""Tail probabilities against tables, and tests on small samples worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from labelmill.functions import special
from labelmill.operators import significance


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_chi_square_table(spark):
    # Upper 5 % and 1 % points of the chi-square table.
    points = [(3.841, 1, 0.05), (6.635, 1, 0.01), (5.991, 2, 0.05), (18.307, 10, 0.05), (43.773, 30, 0.05), (124.342, 100, 0.05), (1074.679, 1000, 0.05)]
    df = spark.createDataFrame(points, "x double, k int, p double").withColumn("got", special.chi_square_tail(F.col("x"), F.col("k")))
    for r in df.collect():
        assert r.got == pytest.approx(r.p, abs=2e-5)
    assert value(spark, special.chi_square_tail(F.lit(0.0), F.lit(3))) == 1.0 and value(spark, special.chi_square_tail(F.lit(5.0), F.lit(0))) == 1.0


def test_binomial_tails(spark):
    cases = [(k, n, p) for n in (1, 7, 40, 900) for p in (0.05, 0.5, 0.93) for k in sorted({0, 1, n // 3, n // 2, n - 1, n})]
    df = spark.createDataFrame(cases, "k int, n int, p double").withColumn("got", special.binomial_at_most(F.col("k"), F.col("n"), F.col("p")))
    for r in df.collect():
        want = math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(r.p) + (r.n - i) * math.log(1 - r.p)) for i in range(r.k + 1))
        assert r.got == pytest.approx(want, abs=1e-9)


def test_large_arguments(spark):
    """Half of a symmetric distribution, and a gamma tail near its mean, for a million."""
    n = 1_000_001
    assert value(spark, special.binomial_at_most(F.lit(n // 2), F.lit(n), F.lit(0.5))) == pytest.approx(0.5, abs=1e-6)
    assert value(spark, special.chi_square_tail(F.lit(1e6), F.lit(1_000_000))) == pytest.approx(0.5, abs=1e-3)


def test_kolmogorov_smirnov_equals_the_sorted_samples(spark):
    rng = random.Random(3)
    rows = [(rng.choice([rng.gauss(0, 1), 0.0, 2.0]), i % 3 == 0) for i in range(500)] + [(None, True), (1.0, None)]
    r = significance.kolmogorov_smirnov(spark.createDataFrame(rows, "x double, g boolean"), F.col("x"), F.col("g")).first()
    a, b = ([x for x, g in rows if x is not None and g is s] for s in (False, True))
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})
    assert (r.first_n, r.second_n) == (len(a), len(b)) and r.statistic == pytest.approx(want) and 0 < r.p_value <= 1
    # Fixed value: the upper 5 % point of the limiting distribution.
    assert value(spark, special.kolmogorov_tail(F.lit(1.3581))) == pytest.approx(0.05, abs=1e-4)
    one = significance.kolmogorov_smirnov(spark.createDataFrame([(1.0, True)], "x double, g boolean"), F.col("x"), F.col("g")).first()
    assert one.statistic is None and one.p_value is None


def test_runs_that_differ_in_ten_rows(spark):
    rows = spark.range(100).select(F.col("id").alias("row_index"), F.lit(True).alias("success"), F.lit("y").alias("ground_truth"), F.lit("y").alias("final_answer"))
    other = rows.withColumn("final_answer", F.when(F.col("row_index") < 9, "n").otherwise("y"))
    rows = rows.withColumn("final_answer", F.when(F.col("row_index") == 50, "n").otherwise("y"))
    r = significance.mcnemar(rows, other).first()
    assert (r.pairs, r.only_first, r.only_second) == (100, 9, 1) and r.statistic == pytest.approx(4.9) and r.exact_p_value == pytest.approx(22 / 1024)
    none = significance.mcnemar(rows, rows).first()
    assert (none.statistic, none.p_value, none.exact_p_value) == (0.0, 1.0, 1.0)
    empty = significance.binomial(rows.limit(0), F.col("success"), 0.5).first()
    assert empty.trials == 0 and empty.p_value == 1.0
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "actual string, predicted string, n long")
    c = significance.chi_square(cells).first()
    assert (c.pairs, c.degrees, c.cramers_v) == (20, 1, pytest.approx(1.0)) and c.statistic == pytest.approx(20)
    assert significance.chi_square(cells.limit(0)).first().p_value == 1.0
