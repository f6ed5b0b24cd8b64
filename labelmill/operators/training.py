"""Preparing labelled rows for training.

Random choices are made by the order of md5(seed:key), so they repeat on any cluster
and any partitioning. Taking the k smallest hashes of a group never sorts the group:
counts per hash prefix give the prefix at which the quota is reached, all rows before
it are kept by a filter, and only the rows of that one prefix are ranked.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelmill.functions.parsing import map_answer
from labelmill.functions.templates import plain
from labelmill.operators.run_stats import ratio
from labelmill.session import materialize

PREFIX_DIGITS = 4


def prepare_labels(df: DataFrame, text: str, label: str, mapping: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Keep text and label, drop rows missing either, map labels (unmapped ones stay)."""
    out = df.select(*(keep or []), text, F.col(label).cast("string").alias(label)).dropna(subset=[text, label])
    return out.withColumn(label, map_answer(F.col(label), mapping or {}))


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def mark_smallest(df: DataFrame, key: str, quotas: DataFrame, group: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``picked``: is the row among the quota smallest hashes of its group?

    ``quotas`` has (group, quota), or one row with quota when there is no group.
    """
    rows = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, PREFIX_DIGITS))
    g = group or "_g"
    if group is None:
        rows = rows.withColumn(g, F.lit(0))
    hist = rows.groupBy(g, "_b").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(g).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    hist = hist.withColumn("_before", upto - F.col("_n"))
    if group is None:
        hist = hist.withColumn("_q", quotas.select("quota").scalar())
    else:
        hist = hist.join(quotas.select(g, F.col("quota").alias("_q")), g)
    at_cut = (F.col("_before") < F.col("_q")) & (F.col("_before") + F.col("_n") > F.col("_q"))
    # Prefixes below _cut are kept whole, the one at _cut up to _need rows.
    after = F.min(F.when(F.col("_before") >= F.col("_q"), F.col("_b")))
    cuts = hist.groupBy(g).agg(
        F.max(F.when(at_cut, F.col("_b"))).alias("_edge"),
        F.max(F.when(at_cut, F.col("_q") - F.col("_before"))).alias("_need"),
        F.coalesce(after, F.lit("~")).alias("_stop"),
    )
    # One row per group. Written out, its size is known, so Spark broadcasts it below
    # the broadcast limit without shuffling the rows, and shuffles only beyond it.
    cuts = materialize(cuts, "quota")
    if group is None:
        rows = rows.withColumn("_c", cuts.select(F.struct("_edge", "_need", "_stop")).scalar()).select("*", "_c.*")
    else:
        rows = rows.join(cuts, g)
    edge = F.coalesce(F.col("_b") == F.col("_edge"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(g, "_b").orderBy("_h", key))
    inner = rows.filter(~edge).withColumn("picked", F.col("_b") < F.coalesce("_edge", "_stop"))
    border = rows.filter(edge).withColumn("picked", rank <= F.col("_need"))
    return inner.unionByName(border).select(*df.columns, "picked")


def _take(df: DataFrame, key: str, quotas: DataFrame, group: str | None, seed: int) -> DataFrame:
    return mark_smallest(df, key, quotas, group, seed).filter("picked").drop("picked")


def _one_quota(df: DataFrame, n: Column) -> DataFrame:
    return df.agg(n.alias("quota"))


def sample_random(df: DataFrame, key: str, max_examples: int, seed: int = 42) -> DataFrame:
    return _take(df, key, _one_quota(df, F.lit(max_examples)), None, seed)


def sample_balanced(df: DataFrame, key: str, label: str, max_examples: int, seed: int = 42) -> DataFrame:
    """The same number per label, at most ``max_examples`` in all; small inputs stay whole.

    Only when there are more labels than examples does the share of one row per label
    exceed the total; the second pick then cuts to it.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.count("*").alias("labels"), F.sum("n").alias("rows")).alias("t"))
    share = F.greatest(F.lit(1), F.floor(F.lit(max_examples) / F.col("t.labels")))
    quotas = counts.withColumn("t", totals.scalar()).select(
        label, F.when(F.col("t.rows") <= max_examples, F.col("n")).otherwise(share).alias("quota")
    )
    # Written out, since it is counted and may be picked from again; it is at most as long
    # as the sample or the label list.
    first = materialize(_take(df, key, quotas, label, seed), "balanced")
    return first if first.count() <= max_examples else sample_random(first, key, max_examples, seed)


def sample_proportional(df: DataFrame, key: str, label: str, max_examples: int, seed: int = 42) -> DataFrame:
    """Each label by its share, at least one; small inputs stay whole."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    rows = counts.agg(F.sum("n"))
    part = F.floor(F.lit(max_examples) * (F.col("n") / F.col("rows").cast("double")))
    quotas = counts.withColumn("rows", rows.scalar()).select(
        label, F.when(F.col("rows") <= max_examples, F.col("n")).otherwise(F.greatest(F.lit(1), part)).alias("quota")
    )
    return _take(df, key, quotas, label, seed)


def train_eval_split(df: DataFrame, key: str, eval_share: float, seed: int = 42) -> DataFrame:
    """Add ``split``: exactly floor(rows x share) rows are eval, the others train."""
    quota = _one_quota(df, F.floor(F.count("*") * F.lit(eval_share)))
    out = mark_smallest(df, key, quota, None, seed)
    return out.withColumn("split", F.when(F.col("picked"), "eval").otherwise("train")).drop("picked")


def class_weights(df: DataFrame, label: str, weights: str | list[float] | dict[str, float] | None = "balanced") -> DataFrame:
    """label, items, percentage, weight: none, balanced, by sorted position, or by name."""
    counts = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("items"))
    totals = counts.agg(F.struct(F.count("*").alias("labels"), F.sum("items").alias("rows")).alias("t"))
    out = counts.withColumn("t", totals.scalar())
    if weights is None or weights == "none":
        w = F.lit(1.0)
    elif weights == "balanced":
        w = F.col("t.rows").cast("double") / (F.col("t.labels") * F.col("items"))
    else:
        names = sorted(r["label"] for r in counts.select("label").collect())  # the label set
        if isinstance(weights, list):
            if len(weights) != len(names):
                raise ValueError(f"{len(weights)} weights given for {len(names)} classes")
            weights = dict(zip(names, weights))
        elif not isinstance(weights, dict):
            raise ValueError(f"unsupported class weights: {weights!r}")
        lacking = [n for n in names if n not in weights]
        if lacking:
            raise ValueError(f"no weight for class {lacking[0]!r}")
        w = map_answer(F.col("label"), {k: str(v) for k, v in weights.items()}).cast("double")
    share = ratio(F.col("items"), F.col("t.rows")) * 100
    return out.select("label", "items", share.alias("percentage"), w.alias("weight"))


def fill_slots(template: str, slots: dict[str, Column]) -> Column:
    """A template with named slots as one concat."""
    parts, rest = [], template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in slots if "{" + k + "}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        pos, name = at
        if pos:
            parts.append(F.lit(rest[:pos]))
        parts.append(slots[name])
        rest = rest[pos + len(name) + 2:]
    return F.concat(*parts) if parts else F.lit("")


def instruction_pairs(df: DataFrame, template: str, text: str, label: str) -> DataFrame:
    as_text = lambda c: plain(F.col(c), df.schema[c].dataType)
    return df.withColumn("instruction", fill_slots(template, {"text": as_text(text), "control": as_text(label)})).withColumn(
        "output", as_text(label)
    )


def chat_text(pairs: DataFrame) -> DataFrame:
    """A user turn and an assistant turn in ChatML markers."""
    return pairs.withColumn("chat", F.concat(
        F.lit("<|im_start|>user\n"), F.col("instruction"), F.lit("<|im_end|>\n<|im_start|>assistant\n"),
        F.col("output"), F.lit("<|im_end|>"),
    ))


def training_metadata(df: DataFrame, split: str, label: str, settings: dict | None = None) -> DataFrame:
    """One row of counts, label distribution and settings, the latter two as JSON."""
    by_label = df.groupBy(F.col(label).cast("string").alias("label")).agg(
        F.count("*").alias("n"), F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "eval").alias("eval")
    )
    pairs = F.sort_array(F.collect_list(F.struct("label", "n")))  # one entry per label
    return by_label.agg(
        F.sum("n").alias("total_samples"), F.sum("train").alias("training_samples"), F.sum("eval").alias("eval_samples"),
        F.count("label").alias("unique_labels"), F.to_json(F.map_from_entries(pairs)).alias("label_distribution"),
    ).withColumn("settings", F.lit(json.dumps(settings or {}, sort_keys=True)))
