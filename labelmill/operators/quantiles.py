"""Exact order statistics without sorting the rows on one machine.

Rows are first reduced to counts per distinct value, which also removes any skew. Ranks
are then found by radix selection: values get order-preserving integer keys, and the digits
of the wanted value's key are found one by one, from the highest. Each step adds up counts
by the next digit (at most 65,536 of them) behind the digits known so far, so neither the
spread of the values nor an outlier changes what a step has to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from labelmill.session import materialize

#: Bits of a key, and of one of its digits.
KEY_BITS, DIGIT_BITS = 64, 16
#: Distinct values that are ranked in one step: no more than a digit has.
FEW = 1 << DIGIT_BITS


def value_counts(df: DataFrame, value: Column, group: Column | None = None) -> DataFrame:
    """grp, v, n: how often each non-null value occurs in each group.

    The counts are written out: everything below reads them several times, and the rows
    they come from must be read only once.
    """
    g = F.lit("all") if group is None else group
    pairs = df.select(g.alias("grp"), value.alias("v")).filter(F.col("v").isNotNull() & F.col("grp").isNotNull())
    return materialize(pairs.groupBy("grp", "v").agg(F.count("*").alias("n")), "counts")


def sort_key(counts: DataFrame) -> Column:
    """A long that never falls where v rises. Whole numbers are their own key; others go by
    sign and logarithm, where close values may share one. NaN is above infinity."""
    v = F.col("v")
    if isinstance(counts.schema["v"].dataType, T.IntegralType):
        return v.cast("long")
    x = v.cast("double")
    size = F.abs(x)
    known = F.when((size == 0) | F.isnan(x), F.lit(1.0)).when(size == float("inf"), F.lit(1.0)).otherwise(size)
    place = F.lit(1 << 51) + F.round(F.log2(known) * F.lit(float(1 << 40))).cast("long")
    place = F.when(size == float("inf"), F.lit(1 << 60)).otherwise(place)
    return F.when(F.isnan(x), F.lit(1 << 61)).when(size == 0, F.lit(0).cast("long")).when(x < 0, -place).otherwise(place)


def _narrowed(placed: DataFrame, wanted: DataFrame, prefix: Column, part: list[Column]) -> DataFrame:
    """Wanted ranks (grp, known, picks), each moved into the part of its prefix that holds it.

    Only values with a wanted prefix are read; their counts are added up by ``part``, and the
    running counts of one prefix tell where a rank falls. A pick's rank is then counted from
    the start of that part.
    """
    inside = placed.withColumn("known", prefix).join(F.broadcast(wanted), ["grp", "known"])
    sums = inside.groupBy("grp", "known", *part).agg(F.sum("n").alias("n"), F.any_value("picks").alias("picks"))
    keys = [c for c in sums.columns if c not in ("grp", "known", "n", "picks")]
    running = F.sum("n").over(Window.partitionBy("grp", "known").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("upto") - F.col("n")
    hit = sums.withColumn("upto", running).select("grp", "known", *keys, before.alias("before"), "upto", F.explode("picks").alias("p"))
    return hit.filter((F.col("p.rank") >= F.col("before")) & (F.col("p.rank") < F.col("upto")))


def pick_ranks(counts: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """grp, pick, v, total: the value at each 0-based rank of the sorted rows.

    ``ranks`` are expressions over ``total``, the group's number of rows. Groups are named by
    the caller (one, or one per listed field), so the wanted ranks are a handful of rows: they
    are broadcast, and only counts that can hold one are grouped.
    """
    placed = counts.withColumn("key", sort_key(counts))
    values, least, most = placed.agg(F.count("*"), F.min("key"), F.max("key")).first()
    # Digits that all keys share need no step, and few values need none but the last.
    open_bits = 0 if values <= FEW else KEY_BITS if least < 0 <= most else (least ^ most).bit_length()
    above = -(-open_bits // DIGIT_BITS) * DIGIT_BITS
    shared = 0 if not open_bits or above == KEY_BITS else least >> above
    each = F.array(*[F.struct(F.lit(k).alias("pick"), r.cast("long").alias("rank"), F.col("total").alias("total")) for k, r in ranks.items()])
    prefix = F.lit(shared).cast("long")
    wanted = counts.groupBy("grp").agg(F.sum("n").alias("total")).select("grp", prefix.alias("known"), each.alias("picks"))
    moved = F.struct("p.pick", (F.col("p.rank") - F.col("before")).alias("rank"), "p.total")
    for low in range(above - DIGIT_BITS, -1, -DIGIT_BITS):
        longer = F.expr(f"shiftright(key, {low})")
        wanted = _narrowed(placed, wanted, prefix, [longer.alias("next")]).groupBy("grp", F.col("next").alias("known")).agg(F.collect_list(moved).alias("picks"))
        prefix = longer
    return _narrowed(placed, wanted, prefix, [F.col("v")]).select("grp", "p.pick", "v", "p.total")


def floor_rank(p: float) -> Column:
    """Rank floor(p * n), computed in double arithmetic."""
    return F.floor(F.col("total").cast("double") * F.lit(p))


def floor_percentiles(counts: DataFrame, points: dict[str, float]) -> DataFrame:
    """One row from the counts of one group; a column per point with sorted[floor(p * n)]."""
    picked = pick_ranks(counts, {k: floor_rank(p) for k, p in points.items()})
    return picked.agg(*[F.max(F.when(F.col("pick") == k, F.col("v"))).alias(k) for k in points])


def linear_from_counts(counts: DataFrame, points: dict[str, float]) -> DataFrame:
    """Per group, percentiles with linear interpolation between neighbouring ranks."""
    at = lambda p: (F.col("total") - 1).cast("double") * F.lit(p)
    ranks: dict[str, Column] = {}
    for k, p in points.items():
        ranks[k + "|lo"] = F.floor(at(p))
        ranks[k + "|hi"] = F.ceil(at(p))
    got = pick_ranks(counts, ranks)
    values = [F.max(F.when(F.col("pick") == k, F.col("v"))).cast("double").alias(k) for k in ranks]
    out = got.groupBy("grp").agg(F.max("total").alias("total"), *values)
    for k, p in points.items():
        lo, hi = F.col(f"`{k}|lo`"), F.col(f"`{k}|hi`")
        out = out.withColumn(k, lo + (hi - lo) * (at(p) - F.floor(at(p))))
    return out.select("grp", *points)


def linear_percentiles(df: DataFrame, value: Column, points: dict[str, float], group: Column | None = None) -> DataFrame:
    return linear_from_counts(value_counts(df, value, group), points)


def moments_from_counts(counts: DataFrame) -> DataFrame:
    """Per group: mean, population deviation, min, max and number of rows."""
    return counts.groupBy("grp").agg(*moments())


def moments() -> list[Column]:
    """Aggregates over (v, n) rows: mean, std, min, max, rows, sum."""
    n, v = F.col("n"), F.col("v").cast("double")
    total = F.sum(n)
    mean = F.sum(v * n) / F.nullif(total, F.lit(0))
    var = F.greatest(F.sum(v * v * n) / F.nullif(total, F.lit(0)) - mean * mean, F.lit(0.0))
    return [
        mean.alias("mean"), F.sqrt(var).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), total.alias("rows"),
        F.sum(F.col("v") * n).alias("sum"),
    ]
