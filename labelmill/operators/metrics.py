"""Classification metrics from one confusion table.

Rows are reduced once to counts per (actual, predicted); everything else is arithmetic
on that table, whose size depends on the label set and not on the data. Three dialects
differ in the pairs they use, in their class sets, in how undefined values count and in
scale:

* report:   every successful row; percent; undefined per-class values are NULL and drop
            out of means; defined only if every successful row has a truth.
* live:     successful rows with a truth; percent; a given class list; zeros count.
* analysis: rows with neither value missing; fractions; union of classes; zeros count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelmill.functions.text import safe_text
from labelmill.operators.run_stats import ratio


# ---- pairs and counts -------------------------------------------------------------

def report_pairs(results: DataFrame) -> DataFrame:
    return results.filter("success").select(
        F.coalesce("ground_truth", F.lit("")).alias("actual"), F.coalesce("final_answer", F.lit("")).alias("predicted")
    )


def live_pairs(results: DataFrame) -> DataFrame:
    return report_pairs(results).filter(F.col("actual") != "")


def analysis_pairs(results: DataFrame, predicted: str = "final_answer", actual: str = "ground_truth") -> DataFrame:
    ok = F.coalesce(F.col("success"), F.lit(True)) if "success" in results.columns else F.lit(True)
    return (
        results.filter(ok)
        .select(safe_text(F.col(actual)).alias("actual"), safe_text(F.col(predicted)).alias("predicted"))
        .dropna()
    )


def eval_pairs(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Label pairs of a training evaluation; positions labelled -100 are padding."""
    return df.select(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).filter(
        F.col("actual") != "-100"
    )


def confusion_counts(pairs: DataFrame) -> DataFrame:
    """actual, predicted, n: only the cells that occur."""
    return pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def class_counts(cells: DataFrame) -> DataFrame:
    """class, tp, support, predicted_n (with fp and fn) over the union of classes."""
    n, hit = F.col("n"), F.col("actual") == F.col("predicted")
    zero = F.lit(0).cast("long")
    rows = F.array(
        F.struct(F.col("actual").alias("class"), F.when(hit, n).otherwise(zero).alias("tp"), n.alias("support"), zero.alias("predicted_n")),
        F.struct(F.col("predicted").alias("class"), zero.alias("tp"), zero.alias("support"), n.alias("predicted_n")),
    )
    out = cells.select(F.explode(rows).alias("r")).groupBy("r.class").agg(
        F.sum("r.tp").alias("tp"), F.sum("r.support").alias("support"), F.sum("r.predicted_n").alias("predicted_n")
    )
    return out.withColumn("fp", F.col("predicted_n") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))


def confusion_sparse(cells: DataFrame) -> DataFrame:
    """The cells that occur, with their row's and column's totals and their share of the row:
    what a matrix tells, for answers of any number. Totals come from aggregations."""
    rows = cells.groupBy("actual").agg(F.sum("n").alias("actual_total"))
    columns = cells.groupBy("predicted").agg(F.sum("n").alias("predicted_total"))
    out = cells.join(rows, "actual").join(columns, "predicted")
    return out.select("actual", "predicted", "n", "actual_total", "predicted_total", _div(F.col("n"), F.col("actual_total")).alias("row_share"))


#: Classes of a dense matrix that nobody has listed: it has the square of them.
MOST_CLASSES = 2000


def _class_list(cells: DataFrame, most: int) -> list[str]:
    """The label set, sorted; an open set of answers raises instead of being collected."""
    found = class_counts(cells).select("class").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} classes: name them, or use confusion_sparse")
    return sorted(r["class"] for r in found)


def confusion_grid(cells: DataFrame, classes: list[str] | None = None, most: int = MOST_CLASSES) -> DataFrame:
    """Dense matrix with zeros, for a class list.

    With ``classes`` (live dialect) the rows are exactly those classes and the columns
    are those plus predictions seen in their rows; otherwise both are the union, of at most
    ``most`` classes.
    """
    if classes is not None:
        cells = cells.filter(F.col("actual").isin(classes))
        rows = F.array(*[F.lit(c) for c in classes])
        seen = cells.select("predicted").distinct().agg(F.collect_set("predicted"))
        columns = F.array_distinct(F.concat(rows, seen.scalar()))
        base = cells.sparkSession.range(1)
        grid = base.select(F.explode(rows).alias("actual")).withColumn("predicted", F.explode(columns))
    else:
        labels = F.array(*[F.lit(c) for c in _class_list(cells, most)]).cast("array<string>")
        grid = cells.sparkSession.range(1).select(F.explode(labels).alias("actual")).withColumn("predicted", F.explode(labels))
    return grid.join(cells, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(cells: DataFrame, classes: list[str]) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    wide = cells.groupBy("actual").pivot("predicted", classes).agg(F.sum("n"))
    have = {c: F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in classes}
    labels = cells.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("actual"))
    return labels.join(wide, "actual", "left").select("actual", *have.values())


# ---- arithmetic on class counts ----------------------------------------------------

def _div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a.cast("double") / F.nullif(b, F.lit(0))


def _f1(p: Column, r: Column) -> Column:
    s = F.coalesce(p, F.lit(0.0)) + F.coalesce(r, F.lit(0.0))
    return F.when(s > 0, 2 * p * r / s)


def with_rates(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1; null where undefined."""
    out = counts.withColumn("precision", _div(F.col("tp"), F.col("predicted_n"))).withColumn("recall", _div(F.col("tp"), F.col("support")))
    # With no true positive both rates are 0 or undefined, hence no f1.
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _gate(cells: DataFrame) -> DataFrame:
    """One struct: number of pairs, and of pairs that lack a truth."""
    n = F.col("n")
    return cells.agg(
        F.struct(F.sum(n).alias("total"), F.coalesce(F.sum(F.when(F.col("actual") == "", n)), F.lit(0)).alias("untrue")).alias("g")
    )


def report_per_class(results: DataFrame) -> DataFrame:
    """Every per-class figure of the report dialect, as fractions.

    Specificity, NPV, FPR, FNR and Jaccard exist for classes that really occur.
    Empty unless every successful row has a truth.
    """
    cells = confusion_counts(report_pairs(results))
    out = with_rates(class_counts(cells)).withColumn("g", _gate(cells).scalar())
    out = out.filter((F.col("g.untrue") == 0) & (F.col("g.total") > 0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    tn = F.col("g.total") - tp - fp - fn
    real = F.col("support") > 0
    rate = lambda a, b: F.when(real, _div(a, b))
    out = out.withColumn("tn", tn)
    tn = F.col("tn")
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return (
        out.withColumn("specificity", rate(tn, tn + fp))
        .withColumn("npv", rate(tn, tn + fn))
        .withColumn("fpr", rate(fp, fp + tn))
        .withColumn("fnr", rate(fn, fn + tp))
        .withColumn("jaccard", rate(tp, tp + fp + fn))
        .withColumn("mcc", F.when(real, (tp.cast("double") * tn - fp.cast("double") * fn) / F.nullif(root, F.lit(0.0))))
        .withColumn("total", F.col("g.total"))
        .drop("g")
    )


def _weighted(x: Column) -> Column:
    """Support-weighted mean over the classes where x is defined."""
    w = F.col("support")
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def _pct(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0)) * 100


def report_summary(results: DataFrame) -> DataFrame:
    """All overall figures of the report dialect in one row, zeros if not defined."""
    tp, fp, fn, sup, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("support"), F.col("total")
    real = sup > 0
    stp, sn = F.sum(tp), F.max(n)
    rtp, rfp, rfn = (F.sum(F.when(real, c)) for c in (tp, fp, fn))
    micro_p, micro_r = ratio(stp, stp + F.sum(fp)), ratio(stp, stp + F.sum(fn))
    po = ratio(stp, sn)
    pe = F.coalesce(F.sum(_div(sup, n) * _div(F.col("predicted_n"), n)), F.lit(0.0))
    kappa = F.when((pe == 1.0) | sn.isNull(), 0.0).otherwise((po - pe) / F.nullif(1.0 - pe, F.lit(0.0)))
    cols = {
        "accuracy": po * 100,
        "balanced_accuracy": _pct(F.avg(F.when(real, F.col("recall")))),
        "kappa": kappa,
        "weighted_kappa": kappa,
        "mcc": F.coalesce(F.avg("mcc"), F.lit(0.0)),
        "hamming_loss": ratio(sn - stp, sn),
        "macro_f1": _pct(F.avg("f1")),
        "micro_f1": F.when(stp > 0, 2 * micro_p * micro_r / (micro_p + micro_r) * 100).otherwise(0.0),
        "weighted_f1": _weighted(F.col("f1")) * 100,
        "macro_precision": _pct(F.avg("precision")),
        "macro_recall": _pct(F.avg("recall")),
        "micro_precision": ratio(rtp, rtp + rfp) * 100,
        "micro_recall": ratio(rtp, rtp + rfn) * 100,
        "weighted_precision": _weighted(F.col("precision")) * 100,
        "weighted_recall": _weighted(F.col("recall")) * 100,
        "macro_jaccard": _pct(F.avg("jaccard")),
        "micro_jaccard": ratio(rtp, rtp + rfp + rfn) * 100,
        "weighted_jaccard": _weighted(F.col("jaccard")) * 100,
        "pairs": F.coalesce(sn, F.lit(0)),
    }
    return report_per_class(results).agg(*[c.alias(k) for k, c in cols.items()])


def classification_report(results: DataFrame) -> DataFrame:
    """Per predicted class, then macro, micro and weighted rows; percent, undefined = 0."""
    cols = ["precision", "recall", "f1", "specificity", "npv", "jaccard"]
    per = report_per_class(results)
    body = per.filter("predicted_n > 0").select(
        F.lit(1).alias("part"), "class", *[_pct(F.col(c)).alias(c) for c in cols], "support"
    )
    s = report_summary(results)
    none = F.lit(None).cast("double")
    kinds = F.array(*[
        F.struct(
            F.lit(i).alias("part"), F.lit(name).alias("class"), F.col(f"{k}_precision").alias("precision"),
            F.col(f"{k}_recall").alias("recall"), F.col(f"{k}_f1").alias("f1"), none.alias("specificity"),
            none.alias("npv"), F.col(f"{k}_jaccard").alias("jaccard"), F.col("pairs").alias("support"),
        )
        for i, (k, name) in enumerate([("macro", "macro avg"), ("micro", "micro avg"), ("weighted", "weighted")], 2)
    ])
    tail = s.filter("pairs > 0").select(F.explode(kinds).alias("k")).select("k.*")
    return body.unionByName(tail)


# ---- live dialect -------------------------------------------------------------------

def live_classes(configured: list[str] | None, find: list[str] | None) -> list[str]:
    return configured or find or ["0", "1", "2"]


def live_per_class(cells: DataFrame, classes: list[str]) -> DataFrame:
    """Counts of the given classes, from cells whose actual class is given."""
    inside = cells.filter(F.col("actual").isin(classes))
    names = cells.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    got = names.join(class_counts(inside), "class", "left").fillna(0)
    out = with_rates(got)
    for c in ("precision", "recall", "f1"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return out


def metric_name(metric: str, average: str = "") -> str:
    return {"f1": f"F1-{average or 'macro'}", "kappa": "Kappa"}.get(metric, "Accuracy")


def live_summary(cells: DataFrame, classes: list[str]) -> DataFrame:
    """Accuracy, macro, micro and weighted F1, kappa: percent, one row.

    Accuracy counts every pair; the other figures only see pairs of the given classes.
    """
    whole = cells.agg(
        F.struct(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("right"),
        ).alias("w")
    )
    per = live_per_class(cells, classes).withColumn("w", whole.scalar())
    tp, sup, n = F.col("tp"), F.col("support"), F.col("w.total")
    stp = F.sum(tp)
    p, r = ratio(stp, stp + F.sum("fp")), ratio(stp, stp + F.sum("fn"))
    total, po = F.max(n), ratio(F.max("w.right"), F.max(n))
    pe = F.coalesce(F.sum(_div(sup, n) * _div(F.col("predicted_n"), n)), F.lit(0.0))
    return per.agg(
        (po * 100).alias("accuracy"),
        _pct(F.avg("f1")).alias("macro_f1"),
        F.when(stp > 0, 2 * p * r / (p + r) * 100).otherwise(0.0).alias("micro_f1"),
        (ratio(F.sum(F.col("f1") * sup), F.sum(sup)) * 100).alias("weighted_f1"),
        F.when((pe == 1.0) | (total == 0), 0.0).otherwise((po - pe) / F.nullif(1.0 - pe, F.lit(0.0)) * 100).alias("kappa"),
        total.alias("pairs"),
    )


def live_metric_from_cells(cells: DataFrame, metric: str, classes: list[str], average: str = "") -> DataFrame:
    column = {
        "f1": {"micro": "micro_f1", "weighted": "weighted_f1"}.get(average, "macro_f1"),
        "kappa": "kappa",
    }.get(metric, "accuracy")
    return live_summary(cells, classes).select(
        F.lit(metric_name(metric, average)).alias("metric_name"), F.col(column).alias("metric_value"), "pairs"
    )


def live_metric(results: DataFrame, metric: str, classes: list[str], average: str = "") -> DataFrame:
    return live_metric_from_cells(confusion_counts(live_pairs(results)), metric, classes, average)


def running_metric(
    results: DataFrame,
    order: str,
    metric: str,
    classes: list[str],
    average: str = "",
    bucket_rows: int = 1_000_000,
) -> DataFrame:
    """The live metric after each completed row, in the order of a whole-number column.

    Running counts per class are two-level: totals of buckets of consecutive rows are
    summed up first (one small row per bucket), then rows are counted inside their
    bucket. No task ever holds more than one bucket.
    """
    pairs = results.filter(F.col("success") & (F.coalesce("ground_truth", F.lit("")) != ""))
    pairs = pairs.select(F.col(order).cast("long").alias("o"), F.col("ground_truth").alias("a"), F.col("final_answer").alias("p"))
    known = F.col("a").isin(classes)
    marks = {"n": F.lit(1), "right": (F.col("a") == F.col("p")).cast("int")}
    if metric in ("f1", "kappa"):
        for i, c in enumerate(classes):
            marks[f"s{i}"] = (F.col("a") == c).cast("int")
            marks[f"q{i}"] = (known & (F.col("p") == c)).cast("int")
            marks[f"t{i}"] = ((F.col("a") == c) & (F.col("p") == c)).cast("int")
    marked = pairs.select("o", F.floor(F.col("o") / bucket_rows).alias("b"), *[m.cast("long").alias(k) for k, m in marks.items()])
    totals = marked.groupBy("b").agg(*[F.sum(k).alias(k) for k in marks])
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("b", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias("base_" + k) for k in marks])
    inside = Window.partitionBy("b").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    run = marked.join(base, "b").select("o", *[(F.sum(k).over(inside) + F.col("base_" + k)).alias(k) for k in marks])
    n = F.col("n")
    po = ratio(F.col("right"), n)
    ids = range(len(classes))
    add = lambda xs: reduce(lambda x, y: x + y, xs, F.lit(0.0))
    if metric == "f1":
        f1 = [F.coalesce(2.0 * F.col(f"t{i}") / F.nullif(F.col(f"s{i}") + F.col(f"q{i}"), F.lit(0)), F.lit(0.0)) for i in ids]
        if average == "micro":
            t, s, q = (add([F.col(f"{k}{i}") for i in ids]) for k in "tsq")
            value = F.coalesce(2.0 * t / F.nullif(s + q, F.lit(0.0)), F.lit(0.0))
        elif average == "weighted":
            value = ratio(add([f * F.col(f"s{i}") for i, f in zip(ids, f1)]), add([F.col(f"s{i}") for i in ids]))
        else:
            value = add(f1) / len(classes)
    elif metric == "kappa":
        pe = add([_div(F.col(f"s{i}"), n) * _div(F.col(f"q{i}"), n) for i in ids])
        value = F.when(pe == 1.0, 0.0).otherwise((po - pe) / F.nullif(1.0 - pe, F.lit(0.0)))
    else:
        value = po
    return run.select(F.col("o").alias(order), n.alias("pairs"), (value * 100).alias("metric_value"))


# ---- analysis dialect ---------------------------------------------------------------

def analysis_per_class(cells: DataFrame) -> DataFrame:
    out = with_rates(class_counts(cells))
    for c in ("precision", "recall", "f1"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return out.withColumnRenamed("f1", "f1_score")


def analysis_summary(cells: DataFrame) -> DataFrame:
    n = F.col("t")
    total = cells.agg(F.sum("n"))
    per = analysis_per_class(cells).withColumn("t", total.scalar())
    po = ratio(F.sum("tp"), F.max(n))
    pe = F.coalesce(F.sum(_div(F.col("support"), n) * _div(F.col("predicted_n"), n)), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return per.agg(
        po.alias("accuracy"),
        mean("recall").alias("balanced_accuracy"),
        F.when(1.0 - pe > 0, (po - pe) / F.nullif(1.0 - pe, F.lit(0.0))).otherwise(0.0).alias("cohen_kappa"),
        mean("precision").alias("macro_precision"),
        mean("recall").alias("macro_recall"),
        mean("f1_score").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1_score").alias("weighted_f1"),
        F.coalesce(F.max(n), F.lit(0)).alias("valid"),
    )
