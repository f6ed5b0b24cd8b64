import math

import pytest
from pyspark.sql import functions as F

from labelmill.operators import metrics, run_stats
from labelmill.operators.report import render_json, report_rows, report_stats
from labelmill.operators.sections import as_text

FIELDS = "row_index bigint, final_answer string, ground_truth string, success boolean, error string, response_time_ms bigint"


def run(spark, pairs, failed=()):
    data = [(i, p, a, True, "", t) for i, (p, a, t) in enumerate(pairs)]
    data += [(len(data) + i, "", a, False, e, t) for i, (a, e, t) in enumerate(failed)]
    return spark.createDataFrame(data, FIELDS)


def pairs(spark, predicted, actual):
    return run(spark, [(p, a, 100) for p, a in zip(predicted, actual)])


def summary(df):
    return metrics.report_summary(df).first().asDict()


def test_report_accuracy(spark):
    assert summary(pairs(spark, "pnp", "pnp"))["accuracy"] == 100
    assert summary(pairs(spark, "pnp", "npn"))["accuracy"] == 0
    assert summary(pairs(spark, "pnp", "pnn"))["accuracy"] == pytest.approx(66.667, abs=1e-3)
    assert set(summary(run(spark, [])).values()) == {0}


def test_report_kappa(spark):
    assert summary(pairs(spark, "pnu", "pnu"))["kappa"] == pytest.approx(1.0)
    assert summary(pairs(spark, "pnp", "npn"))["kappa"] == pytest.approx(-0.8)
    assert summary(pairs(spark, "ppp", "ppp"))["kappa"] == 0  # expected agreement is 1


def test_report_per_class(spark):
    got = {r["class"]: r for r in metrics.report_per_class(pairs(spark, "pnpun", "pnnup")).collect()}
    assert set(got) == set("pnu")
    assert (got["p"]["precision"], got["p"]["recall"], got["p"]["f1"]) == (0.5, 0.5, 0.5)
    assert (got["u"]["precision"], got["u"]["specificity"]) == (1.0, 1.0)


def test_undefined_values_leave_the_means(spark):
    df = pairs(spark, "aab", "acc")  # c never predicted, b never true
    got = {r["class"]: r for r in metrics.report_per_class(df).collect()}
    assert got["c"]["precision"] is None and got["c"]["f1"] is None and got["b"]["recall"] is None
    assert got["b"]["specificity"] is None and got["b"]["jaccard"] is None
    s = summary(df)
    assert s["macro_f1"] == pytest.approx(100 * 2 / 3)  # only class a has an f1
    assert s["macro_precision"] == pytest.approx(25)  # a: 1/2, b: 0
    assert s["weighted_f1"] == pytest.approx(100 * 2 / 3)
    assert s["micro_precision"] == pytest.approx(50)  # false positives of b do not count
    assert s["balanced_accuracy"] == pytest.approx(50)


def test_gate_without_truth(spark):
    df = run(spark, [("p", "p", 1), ("n", "", 1)])
    assert metrics.report_per_class(df).count() == 0
    assert summary(df)["accuracy"] == 0
    assert run_stats.class_distribution(df).count() == 2


def test_confusion(spark):
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion_grid(metrics.confusion_counts(metrics.report_pairs(pairs(spark, "pnpu", "pnnu")))).collect()}
    assert len(cells) == 9 and cells["n", "p"] == 1 and cells["u", "p"] == 0


def live(spark, predicted, actual, classes, metric, average=""):
    return metrics.live_metric(pairs(spark, predicted, actual), metric, classes, average).first()["metric_value"]


def test_live(spark):
    assert live(spark, "ABCABCAA", "ABCABBBC", list("ABC"), "accuracy") == pytest.approx(62.5)
    p, a = "AABBC", "ABBCC"
    assert live(spark, p, a, list("ABC"), "f1", "micro") == pytest.approx(60)
    assert live(spark, "AB", "AB", ["A", "B"], "kappa") == pytest.approx(100)
    assert live(spark, "AB", "BA", ["A", "B"], "kappa") < 0
    assert live(spark, "AX", "AX", ["A"], "f1") == pytest.approx(100)  # X is no class
    assert live(spark, "AX", "AX", ["A"], "accuracy") == pytest.approx(100)
    assert live(spark, "AB", "AB", ["A", "B"], "unknown") == pytest.approx(100)
    assert metrics.metric_name("f1", "micro") == "F1-micro" and metrics.metric_name("?") == "Accuracy"
    assert metrics.live_classes(None, None) == ["0", "1", "2"]


def test_micro_f1_is_accuracy(spark):
    s = summary(pairs(spark, "abcabcab", "aacbbcab"))
    assert s["micro_f1"] == pytest.approx(s["accuracy"])


def test_running_metric_buckets(spark):
    df = pairs(spark, "aabbab" * 5, "abbaab" * 5)
    for metric, average in (("accuracy", ""), ("f1", "micro"), ("kappa", "")):
        small = metrics.running_metric(df, "row_index", metric, ["a", "b"], average, bucket_rows=4).orderBy("row_index").collect()
        big = metrics.running_metric(df, "row_index", metric, ["a", "b"], average).orderBy("row_index").collect()
        assert small == big and len(small) == 30
    last = metrics.live_metric(df, "kappa", ["a", "b"]).first()["metric_value"]
    assert small[-1]["metric_value"] == pytest.approx(last)


FIVE = [("pos", "pos", 100), ("neg", "neg", 150), ("pos", "neg", 200), ("neu", "neu", 120)]


def test_five_results(spark):
    df = run(spark, FIVE, [("pos", "timeout error", 5000)])
    t = run_stats.time_stats(df).first()
    assert (t.min_ms, t.median_ms, t.max_ms, t.p95_ms, t.p99_ms) == (100, 150, 5000, 5000, 5000)
    assert t.avg_ms == 1114.0
    mean = 5570 / 5
    assert t.std_ms == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in (100, 150, 200, 120, 5000)) / 5))
    assert [tuple(r) for r in run_stats.error_distribution(df).collect()] == [("timeout", 1, 100.0)]
    assert {r.bucket: r["items"] for r in run_stats.time_buckets(df).collect()} == {"100-500ms": 4, "5-15s": 1}
    assert run_stats.throughput(df).first().per_second == pytest.approx(5 / 5.57)
    assert run_stats.status_grade(df).first()["status"] == "ACCEPTABLE"
    stats = report_stats(df)
    assert "status = ACCEPTABLE" in as_text(report_rows(df), "run") and '"total": 5' in render_json(stats)


def test_percentile_ranks(spark):
    from pyspark.sql import functions as F

    from labelmill.operators.quantiles import floor_percentiles, linear_percentiles, value_counts

    df = spark.range(20).select((F.col("id") * 1000003 % 20).alias("v"))
    assert floor_percentiles(value_counts(df, F.col("v")), {"p95": 0.95, "p50": 0.5}).first().asDict() == {"p95": 19, "p50": 10}
    lin = linear_percentiles(df, F.col("v"), {"p25": 0.25, "p99": 0.99}).first()
    assert (lin.p25, lin.p99) == (pytest.approx(4.75), pytest.approx(18.81))
    one = linear_percentiles(spark.range(1), F.col("id"), {"m": 0.5}).first()
    assert one.m == 0


@pytest.mark.parametrize("few", [1 << 16, 2])
def test_ranks_do_not_depend_on_the_spread(spark, monkeypatch, few):
    """One huge outlier, tiny differences, signs and infinities: still the sorted picks."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from labelmill.operators import quantiles
    from labelmill.operators.quantiles import floor_percentiles, linear_percentiles, value_counts

    monkeypatch.setattr(quantiles, "FEW", few)  # with 2, all steps are taken
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-12), rng.gauss(0, 1e9), 0.0, 5.0, 1e300, -float("inf")]) for _ in range(800)] + [1e15]
    df = spark.createDataFrame([(v, "ab"[i % 2]) for i, v in enumerate(values)], "x double, g string")
    got = {r.grp: r for r in linear_percentiles(df.filter("x > double('-infinity')"), F.col("x"), {"p1": 0.01, "m": 0.5, "p99": 0.99}, F.col("g")).collect()}
    for k, g in enumerate("ab"):
        own = [v for v in values[k::2] if v > -np.inf]
        assert [got[g][p] for p in ("p1", "m", "p99")] == [pytest.approx(np.percentile(own, q)) for q in (1, 50, 99)]
    whole = [rng.randrange(-5, 5) for _ in range(300)] + [10**15, -(1 << 63), (1 << 63) - 1]
    ints = spark.createDataFrame([(v,) for v in whole], "v long")
    counts = value_counts(ints, F.col("v"))
    assert floor_percentiles(counts, {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p999": 0.9999}).first().asDict() == {p: sorted(whole)[int(q * len(whole))] for p, q in (("p0", 0.0), ("p50", 0.5), ("p99", 0.99), ("p999", 0.9999))}


def test_open_answers_need_no_dense_matrix(spark):
    """100,000 different answers: figures by aggregation, and no grid of their square."""
    from pyspark.sql import functions as F

    from labelmill.operators import metrics, report

    i = F.col("id")
    answer = F.concat(F.lit("a"), (i % 100_000).cast("string"))
    results = spark.range(150_000).select(
        i.alias("row_index"), F.lit(True).alias("success"), answer.alias("ground_truth"), F.when(i % 4 == 0, F.lit("a1")).otherwise(answer).alias("final_answer"), F.lit("").alias("error"),
        F.lit(5).cast("long").alias("response_time_ms"),
    )
    s = metrics.report_summary(results).first()
    assert s.accuracy == pytest.approx(75.0, abs=0.01) and 74 < s.kappa * (100 if s.kappa <= 1 else 1) < 76 and s.mcc is not None
    cells = metrics.confusion_counts(metrics.report_pairs(results))
    sparse = metrics.confusion_sparse(cells)
    assert sparse.count() == cells.count() < 150_001 and sparse.filter("predicted = 'a1' and actual = 'a4'").first()["predicted_total"] > 37_000
    for dense in (lambda: metrics.confusion_grid(cells), lambda: report.confusion_sheet(results)):
        with pytest.raises(ValueError, match="more than 2000 classes"):
            dense()
    assert report.confusion_sheet(results, ["a1", "a2"]).columns == ["actual", "a1", "a2"]


def test_empty_run(spark):
    df = run(spark, [])
    assert run_stats.overview(df).first().total == 0
    assert run_stats.compare_runs(df, df).first().success_rate_diff == 0
    assert run_stats.time_stats(df).first().avg_ms == 0
    assert {r.metric: r.value for r in run_stats.comparison_rows(df, df).collect()}["total_diff"] == "0"


def test_eval_padding(spark):
    df = spark.createDataFrame([("0", "-100"), ("1", "1"), ("1", "0")], "p string, t string")
    s = metrics.analysis_summary(metrics.confusion_counts(metrics.eval_pairs(df, "p", "t"))).first()
    assert (s.accuracy, s.valid) == (0.5, 2) and s.macro_f1 == pytest.approx(1 / 3)


def test_error_analysis_outputs(spark, tmp_path):
    from labelmill.operators import error_analysis as E
    from labelmill.operators.report import write_report_csv

    df = run(spark, [("1", "2", 10), ("3", "2", 30), ("2", "2", 20), ("nan", "2", 5), ("x", "2", 0)], [("2", "bad", 7)])
    df = df.withColumn("input_text", F.lit("in\n text")).withColumn("thinking_content", F.lit(None).cast("string"))
    c = E.categorize(df)
    assert sorted((r.category, r.error_type, r.error_direction) for r in c.filter("category = 'discrepancy'").collect()) == [
        ("discrepancy", "2_to_1", "underestimate"), ("discrepancy", "2_to_3", "overestimate"), ("discrepancy", "2_to_x", "different_class")]
    E.write_errors_by_type(c, str(tmp_path / "e"))
    assert {r.error_type: r["count"] for r in spark.read.json(str(tmp_path / "e")).groupBy("error_type").count().collect()} == {"2_to_1": 1, "2_to_3": 1, "2_to_x": 1}
    summary = E.analysis_summary(df).first().asDict()
    assert (summary["total_samples"], summary["valid_samples"], summary["missing_samples"], summary["failed_predictions"], summary["total_errors"]) == (6, 4, 1, 1, 3)
    times = E.response_time_stats(df).first().asDict()
    assert times["median"] == 10 and times["std"] == pytest.approx(math.sqrt(437.2 / 4))
    found = {(r.section, r.item, r.metric): r.value for r in E.analysis_rows(df, c).collect()}
    assert found["error_type", "2_to_1", "items"] == "1" and found["response_time", "", "median"] == "10.000000"
    assert found["summary", "", "total_errors"] == "3" and ("class", "2", "f1_score") in found
    assert E.model_name(None, {"models": {"model_name": "s"}}) == "s" and E.model_name(None, None) == "Unknown"
    write_report_csv(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "summary")).count() == 12
