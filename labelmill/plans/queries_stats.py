"""Registered queries: run statistics, metrics, voting and error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.operators import consensus, error_analysis, metrics, run_stats, significance
from labelmill.functions.parsing import ParsingRules
from labelmill.plans import views as V
from labelmill.plans.registry import SQL, query, rounded, table

R = f"WITH r AS ({V.results_sql()})"


# ---- run statistics -----------------------------------------------------------------

@query("a1_overview", f"""{R} SELECT count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failed,
 round(count(*) FILTER (success) / CAST(count(*) AS DOUBLE) * 100, 6) AS success_rate, CAST(sum(response_time_ms) AS BIGINT) AS total_time_ms FROM r""")
def _(spark, d):
    return rounded(run_stats.overview(V.results(spark, d)))


RANKED = f"{R}, s AS (SELECT response_time_ms AS t, row_number() OVER (ORDER BY response_time_ms) - 1 AS i, count(*) OVER () AS n FROM r)"
_at = lambda p: f"max(t) FILTER (i = CAST(floor(CAST(n AS DOUBLE) * {p}) AS BIGINT))"


@query("a2_time_stats", f"""{RANKED} SELECT round(((sum(t) // count(*)) * 1000000 + ((sum(t) % count(*)) * 1000000) // count(*)) / 1e6, 6) AS avg_ms,
 min(t) AS min_ms, max(t) AS max_ms, {_at(0.5)} AS median_ms, {_at(0.95)} AS p95_ms, {_at(0.99)} AS p99_ms, round(stddev_pop(t), 6) AS std_ms FROM s""")
def _(spark, d):
    return rounded(run_stats.time_stats(V.results(spark, d)))


@query("a3_rank_percentile", f"{RANKED} SELECT " + ", ".join(f"{_at(p)} AS {k}" for k, p in run_stats.PERCENTILES.items()) + " FROM s")
def _(spark, d):
    return run_stats.time_percentiles(V.results(spark, d))


@query("a4_time_buckets", f"""{R} SELECT CASE WHEN response_time_ms < 100 THEN '< 100ms' WHEN response_time_ms < 500 THEN '100-500ms'
 WHEN response_time_ms < 1000 THEN '500ms-1s' WHEN response_time_ms < 5000 THEN '1-5s' WHEN response_time_ms < 15000 THEN '5-15s' ELSE '> 15s' END AS bucket,
 count(*) AS items FROM r GROUP BY 1""")
def _(spark, d):
    return run_stats.time_buckets(V.results(spark, d))


@query("a5_throughput", f"""{R}, t AS (SELECT count(*) / (CAST(sum(response_time_ms) AS DOUBLE) / 1000.0) AS x FROM r)
 SELECT round(x, 6) AS per_second, round(x * 60, 6) AS per_minute, round(x * 3600, 6) AS per_hour FROM t""")
def _(spark, d):
    return rounded(run_stats.throughput(V.results(spark, d)))


@query("a6_class_distribution", f"""{R} SELECT final_answer AS class, count(*) AS items,
 round(count(*) / CAST((SELECT count(*) FROM r) AS DOUBLE) * 100, 6) AS percentage FROM r WHERE success GROUP BY 1""")
def _(spark, d):
    return rounded(run_stats.class_distribution(V.results(spark, d)))


@query("a7_error_distribution", f"""{R} SELECT CASE WHEN contains(lower(error), 'timeout') THEN 'timeout' WHEN contains(lower(error), 'connection') THEN 'connection'
 WHEN contains(lower(error), 'parse') THEN 'parsing' ELSE 'other' END AS error_class, count(*) AS items,
 round(count(*) / CAST((SELECT count(*) FROM r WHERE NOT success) AS DOUBLE) * 100, 6) AS percentage FROM r WHERE NOT success GROUP BY 1""")
def _(spark, d):
    return rounded(run_stats.error_distribution(V.results(spark, d)))


@query("a8_status_grade", f"""{R}, s AS (SELECT count(*) FILTER (success) / CAST(count(*) AS DOUBLE) * 100 AS x,
  ((sum(response_time_ms) // count(*)) * 1000000 + ((sum(response_time_ms) % count(*)) * 1000000) // count(*)) / 1e6 AS y FROM r)
 SELECT round(x, 6) AS success_rate, round(y, 6) AS avg_ms,
 CASE WHEN x >= 95 THEN 'EXCELLENT' WHEN x >= 90 THEN 'GOOD' WHEN x >= 80 THEN 'ACCEPTABLE' ELSE 'NEEDS IMPROVEMENT' END AS status,
 CASE WHEN y < 1000 THEN 'FAST' WHEN y < 5000 THEN 'GOOD' WHEN y < 15000 THEN 'MODERATE' ELSE 'SLOW' END AS performance FROM s""")
def _(spark, d):
    return rounded(run_stats.status_grade(V.results(spark, d)))


def _run_sql(every):
    return f"""SELECT count(*) AS n, count(*) FILTER (final_answer = ground_truth) AS ok,
  ((sum(response_time_ms) // count(*)) * 1000000 + ((sum(response_time_ms) % count(*)) * 1000000) // count(*)) / 1e6 AS y
  FROM ({V.results_sql(every)})"""


def _agreeing(df):
    """Run comparison needs runs that differ: success here means agreement with the truth."""
    return df.withColumn("success", F.col("final_answer") == F.col("ground_truth"))


_rate = lambda i: f"(r{i}.ok / CAST(r{i}.n AS DOUBLE) * 100)"


@query("a9_compare_runs", f"""WITH r1 AS ({_run_sql(5)}), r2 AS ({_run_sql(7)}) SELECT
 r1.n AS total_1, r1.ok AS success_1, r1.n - r1.ok AS failed_1, round({_rate(1)}, 6) AS success_rate_1, round(r1.y, 6) AS avg_ms_1,
 r2.n AS total_2, r2.ok AS success_2, r2.n - r2.ok AS failed_2, round({_rate(2)}, 6) AS success_rate_2, round(r2.y, 6) AS avg_ms_2,
 r2.n - r1.n AS total_diff, round({_rate(2)} - {_rate(1)}, 6) AS success_rate_diff, round(r2.y - r1.y, 6) AS avg_ms_diff FROM r1, r2""")
def _(spark, d):
    return rounded(run_stats.compare_runs(_agreeing(V.results(spark, d)), _agreeing(V.results(spark, d, 7))))


_SIDE = [(f"{k}_{i}", whole) for i in (1, 2) for k, whole in (("total", True), ("success", True), ("failed", True), ("success_rate", False), ("avg_ms", False))]
_COMPARED = _SIDE + [("total_diff", True), ("success_rate_diff", False), ("avg_ms_diff", False)]


@query("a10_comparison_rows", f"WITH c AS MATERIALIZED ({SQL['a9_compare_runs']}) " + " UNION ALL ".join(
    f"SELECT 'comparison' AS section, '' AS item, '{m}' AS metric, {f'CAST({m} AS VARCHAR)' if whole else f"printf('%.6f', {m})"} AS value FROM c" for m, whole in _COMPARED))
def _(spark, d):
    return run_stats.comparison_rows(_agreeing(V.results(spark, d)), _agreeing(V.results(spark, d, 7)))


@query("a11_dataset_profile", f"""WITH t AS ({V.TRAINING_SQL}) SELECT count(*) AS rows, count(DISTINCT label) AS labels, round(avg(length(text)), 6) AS mean_length,
 round(CAST(median(length(text)) AS DOUBLE), 6) AS median_length, CAST(min(length(text)) AS BIGINT) AS min_length, CAST(max(length(text)) AS BIGINT) AS max_length FROM t""")
def _(spark, d):
    return rounded(run_stats.dataset_profile(V.training_rows(spark, d), "text", "label"))


@query("a11_label_counts", f"""WITH t AS ({V.TRAINING_SQL}) SELECT label, count(*) AS items, round(count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE) * 100, 6) AS percentage
 FROM t WHERE label IS NOT NULL GROUP BY 1 ORDER BY items DESC, label LIMIT 10""")
def _(spark, d):
    return rounded(run_stats.label_counts(V.training_rows(spark, d), "label"))


@query("a12_most_frequent", "SELECT event_type AS value, count(*) AS items FROM events GROUP BY 1 ORDER BY items DESC, value LIMIT 1")
def _(spark, d):
    return run_stats.most_frequent(table(spark, d, "events"), "event_type")


@query("a12_distinct_in_order", """SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS distinct_words
 FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def _(spark, d):
    kept = run_stats.distinct_in_order(F.split("text", " "))
    return table(spark, d, "documents").select("doc_id", F.array_join(kept, " ").alias("distinct_words"))


# ---- metrics: report dialect --------------------------------------------------------

def _cells(view: str, actual: str, predicted: str, where: str) -> str:
    return f"""WITH r AS ({view}), cells AS (SELECT {actual} AS a, {predicted} AS p, count(*) AS n FROM r WHERE {where} GROUP BY 1, 2),
 cls AS (SELECT a AS c FROM cells UNION SELECT p FROM cells), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS big FROM cells),
 cnt AS (SELECT c, CAST(coalesce(sum(n) FILTER (a = c AND p = c), 0) AS DOUBLE) AS tp, CAST(coalesce(sum(n) FILTER (a <> c AND p = c), 0) AS DOUBLE) AS fp,
   CAST(coalesce(sum(n) FILTER (a = c AND p <> c), 0) AS DOUBLE) AS fn FROM cls, cells GROUP BY c)"""


REPORT = _cells(V.results_sql(), "ground_truth", "final_answer", "success") + """,
 per AS (SELECT c AS class, tp, fp, fn, big - tp - fp - fn AS tn, big, tp + fn AS support, tp + fp AS predicted_n,
   CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM cnt, tot),
 full_per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1,
   CASE WHEN support > 0 AND tn + fp > 0 THEN tn / (tn + fp) END AS specificity, CASE WHEN support > 0 AND tn + fn > 0 THEN tn / (tn + fn) END AS npv,
   CASE WHEN support > 0 AND tn + fp > 0 THEN fp / (tn + fp) END AS fpr, CASE WHEN support > 0 THEN fn / (fn + tp) END AS fnr,
   CASE WHEN support > 0 THEN tp / (tp + fp + fn) END AS jaccard,
   CASE WHEN support > 0 AND (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM per)"""
_wavg = lambda x: f"sum({x} * support) / sum(support) FILTER ({x} IS NOT NULL) * 100"


def _report(name, select):
    """One figure of the report dialect: (query name, {column: SQL over full_per})."""
    sql = ", ".join(f"round({v}, 6) AS {k}" for k, v in select.items())

    @query(name, f"{REPORT} SELECT {sql} FROM full_per")
    def _(spark, d):
        return rounded(metrics.report_summary(V.results(spark, d)).select(*select))


_report("m2_accuracy", {"accuracy": "sum(tp) / max(big) * 100"})
_report("m6_macro_averages", {"macro_precision": "avg(precision) * 100", "macro_recall": "avg(recall) * 100", "macro_f1": "avg(f1) * 100", "macro_jaccard": "avg(jaccard) * 100"})
_report("m7_micro_f1", {"micro_f1": "2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) * 100"})
_report("m8_micro_precision_recall", {
    "micro_precision": "sum(tp) FILTER (support > 0) / (sum(tp + fp) FILTER (support > 0)) * 100",
    "micro_recall": "sum(tp) FILTER (support > 0) / (sum(tp + fn) FILTER (support > 0)) * 100"})
_report("m9_micro_jaccard", {"micro_jaccard": "sum(tp) FILTER (support > 0) / (sum(tp + fp + fn) FILTER (support > 0)) * 100"})
_report("m10_weighted_averages", {f"weighted_{k}": _wavg(k) for k in ("precision", "recall", "f1", "jaccard")})
_report("m11_balanced_accuracy", {"balanced_accuracy": "avg(recall) FILTER (support > 0) * 100"})
_kappa = "(sum(tp) / max(big) - sum(support / big * predicted_n / big)) / (1 - sum(support / big * predicted_n / big))"
_report("m12_kappa", {"kappa": _kappa})
_report("m13_weighted_kappa", {"weighted_kappa": _kappa})
_report("m14_mcc", {"mcc": "avg(mcc)"})
_report("m15_hamming_loss", {"hamming_loss": "1 - sum(tp) / max(big)"})


def _per_class(name, columns):
    ints = {"support", "predicted_n", "tp", "fp", "fn", "tn"}
    sql = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in ints else f"round({c}, 6) AS {c}" for c in columns)

    @query(name, f"{REPORT} SELECT class, {sql} FROM full_per")
    def _(spark, d):
        return rounded(metrics.report_per_class(V.results(spark, d)).select("class", *columns))


_per_class("m3_per_class", ["precision", "recall", "f1", "support", "tp", "fp", "fn"])
_per_class("m4_specificity_npv_fpr_fnr", ["specificity", "npv", "fpr", "fnr", "tn"])
_per_class("m5_jaccard", ["jaccard"])


@query("m1_confusion_report", f"""{REPORT} SELECT a.c AS actual, b.c AS predicted, CAST(coalesce(max(n), 0) AS BIGINT) AS n
 FROM cls a CROSS JOIN cls b LEFT JOIN cells ON cells.a = a.c AND cells.p = b.c GROUP BY 1, 2""")
def _(spark, d):
    return metrics.confusion_grid(metrics.confusion_counts(metrics.report_pairs(V.results(spark, d))))


@query("m16_classification_report", REPORT + """, m AS (SELECT avg(precision) * 100 AS mp, avg(recall) * 100 AS mr, avg(f1) * 100 AS mf, avg(jaccard) * 100 AS mj,
  sum(tp) FILTER (support > 0) / (sum(tp + fp) FILTER (support > 0)) * 100 AS ip, sum(tp) FILTER (support > 0) / (sum(tp + fn) FILTER (support > 0)) * 100 AS ir,
  2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) * 100 AS f_i, sum(tp) FILTER (support > 0) / (sum(tp + fp + fn) FILTER (support > 0)) * 100 AS ij,
  """ + ", ".join(f"{_wavg(k)} AS w{k[0]}" for k in ("precision", "recall", "f1", "jaccard")) + """, CAST(max(big) AS BIGINT) AS n FROM full_per)
 SELECT 1 AS part, class, round(coalesce(precision, 0) * 100, 6) AS precision, round(coalesce(recall, 0) * 100, 6) AS recall, round(coalesce(f1, 0) * 100, 6) AS f1,
  round(coalesce(specificity, 0) * 100, 6) AS specificity, round(coalesce(npv, 0) * 100, 6) AS npv, round(coalesce(jaccard, 0) * 100, 6) AS jaccard, CAST(support AS BIGINT) AS support
  FROM full_per WHERE predicted_n > 0
 UNION ALL SELECT 2, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), NULL, NULL, round(mj, 6), n FROM m
 UNION ALL SELECT 3, 'micro avg', round(ip, 6), round(ir, 6), round(f_i, 6), NULL, NULL, round(ij, 6), n FROM m
 UNION ALL SELECT 4, 'weighted', round(wp, 6), round(wr, 6), round(wf, 6), NULL, NULL, round(wj, 6), n FROM m""")
def _(spark, d):
    return rounded(metrics.classification_report(V.results(spark, d)))


# ---- metrics: live dialect ----------------------------------------------------------
# Three of the four classes are configured, so pairs of the fourth only count in accuracy.

LIVE = ["signup", "click", "view"]
_names = "(VALUES ('signup'), ('click'), ('view')) AS k(c)"
LIVE_SQL = f"""WITH r AS ({V.results_sql()}), pairs AS (SELECT ground_truth AS a, final_answer AS p FROM r WHERE success AND ground_truth <> ''),
 inside AS (SELECT a, p, count(*) AS n FROM pairs WHERE a IN ('signup', 'click', 'view') GROUP BY 1, 2),
 w AS (SELECT CAST(count(*) AS DOUBLE) AS big, CAST(count(*) FILTER (a = p) AS DOUBLE) AS hit FROM pairs),
 cnt AS (SELECT c, CAST(coalesce(sum(n) FILTER (a = c AND p = c), 0) AS DOUBLE) AS tp, CAST(coalesce(sum(n) FILTER (a = c), 0) AS DOUBLE) AS support,
   CAST(coalesce(sum(n) FILTER (p = c), 0) AS DOUBLE) AS predicted_n FROM {_names}, inside GROUP BY c),
 f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (support + predicted_n) ELSE 0 END AS f1 FROM cnt, w)"""
_LIVE_VALUE = {
    ("accuracy", ""): ("Accuracy", "max(hit) / max(big) * 100"),
    ("f1", ""): ("F1-macro", "avg(f1) * 100"),
    ("f1", "micro"): ("F1-micro", "2 * sum(tp) / (sum(support) + sum(predicted_n)) * 100"),
    ("f1", "weighted"): ("F1-weighted", "sum(f1 * support) / sum(support) * 100"),
    ("kappa", ""): ("Kappa", "(max(hit) / max(big) - sum(support / big * predicted_n / big)) / (1 - sum(support / big * predicted_n / big)) * 100"),
}


def _live(metric, average):
    label, value = _LIVE_VALUE[(metric, average)]

    @query(f"m17_live_{metric}{'_' + average if average else ''}", f"{LIVE_SQL} SELECT '{label}' AS metric_name, round({value}, 6) AS metric_value, CAST(max(big) AS BIGINT) AS pairs FROM f")
    def _(spark, d):
        return rounded(metrics.live_metric(V.results(spark, d), metric, LIVE, average))


for _key in _LIVE_VALUE:
    _live(*_key)


@query("m1_confusion_sparse", """WITH c AS (SELECT event_type AS actual, props AS predicted, count(*) AS n FROM events GROUP BY 1, 2)
 SELECT actual, predicted, n, CAST(sum(n) OVER (PARTITION BY actual) AS BIGINT) AS actual_total, CAST(sum(n) OVER (PARTITION BY predicted) AS BIGINT) AS predicted_total,
  round(n / sum(n) OVER (PARTITION BY actual), 6) AS row_share FROM c""")
def _(spark, d):
    """Open answers: a whole reply is a class, so the matrix has only the cells that occur."""
    pairs = table(spark, d, "events").select(F.col("event_type").alias("actual"), F.col("props").alias("predicted"))
    return rounded(metrics.confusion_sparse(metrics.confusion_counts(pairs)))


@query("m12_kappa_open_answers", """WITH c AS (SELECT event_type AS a, CASE WHEN event_id % 3 = 0 THEN event_type ELSE props END AS p, count(*) AS n FROM events GROUP BY 1, 2),
 t AS (SELECT sum(n) AS n, sum(n) FILTER (a = p) AS hit FROM c), m AS (SELECT x, sum(s) AS s, sum(q) AS q FROM (SELECT a AS x, n AS s, 0 AS q FROM c UNION ALL SELECT p, 0, n FROM c) GROUP BY x),
 e AS (SELECT sum((s / n) * (q / n)) AS pe FROM m, t GROUP BY n) SELECT round(((hit / n) - pe) / (1 - pe), 6) AS cohen_kappa, round(hit / n, 6) AS accuracy FROM t, e""")
def _(spark, d):
    e = table(spark, d, "events")
    pairs = e.select(F.col("event_type").alias("actual"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("props")).alias("predicted"))
    return rounded(metrics.analysis_summary(metrics.confusion_counts(pairs)).select("cohen_kappa", "accuracy"))


@query("m1_confusion_live", f"""{LIVE_SQL}, cols AS (SELECT c FROM {_names} UNION SELECT p FROM inside)
 SELECT k.c AS actual, cols.c AS predicted, CAST(coalesce(max(n), 0) AS BIGINT) AS n FROM {_names} CROSS JOIN cols LEFT JOIN inside ON a = k.c AND p = cols.c GROUP BY 1, 2""")
def _(spark, d):
    return metrics.confusion_grid(metrics.confusion_counts(metrics.live_pairs(V.results(spark, d))), LIVE)


RUNNING = f"""WITH r AS ({V.results_sql()}), p AS (SELECT row_index AS o, ground_truth AS a, final_answer AS p FROM r WHERE success AND ground_truth <> ''),
 c AS (SELECT o, CAST(count(*) OVER w AS DOUBLE) AS n, CAST(count(*) FILTER (a = p) OVER w AS DOUBLE) AS hit, """ + ", ".join(
    f"CAST(count(*) FILTER (a = '{c}') OVER w AS DOUBLE) AS s{i}, CAST(count(*) FILTER (p = '{c}' AND a IN ('signup', 'click', 'view')) OVER w AS DOUBLE) AS q{i}, CAST(count(*) FILTER (a = '{c}' AND p = '{c}') OVER w AS DOUBLE) AS t{i}"
    for i, c in enumerate(LIVE)) + " FROM p WINDOW w AS (ORDER BY o ROWS UNBOUNDED PRECEDING))"
_f1s = [f"CASE WHEN t{i} > 0 THEN 2 * t{i} / (s{i} + q{i}) ELSE 0 END" for i in range(3)]
_pe = " + ".join(f"s{i} / n * q{i} / n" for i in range(3))
_RUN_VALUE = {
    ("accuracy", ""): "hit / n * 100",
    ("f1", ""): f"({' + '.join(_f1s)}) / 3 * 100",
    ("f1", "micro"): "CASE WHEN t0 + t1 + t2 > 0 THEN 2 * (t0 + t1 + t2) / (s0 + s1 + s2 + q0 + q1 + q2) ELSE 0 END * 100",
    ("f1", "weighted"): f"CASE WHEN s0 + s1 + s2 > 0 THEN ({' + '.join(f'({f}) * s{i}' for i, f in enumerate(_f1s))}) / (s0 + s1 + s2) ELSE 0 END * 100",
    ("kappa", ""): f"CASE WHEN {_pe} = 1 THEN 0 ELSE (hit / n - ({_pe})) / (1 - ({_pe})) END * 100",
}


def _running(metric, average):
    @query(f"m18_running_{metric}{'_' + average if average else ''}", f"{RUNNING} SELECT o AS row_index, CAST(n AS BIGINT) AS pairs, round({_RUN_VALUE[(metric, average)]}, 6) AS metric_value FROM c")
    def _(spark, d):
        # Buckets far smaller than the default, so that a small table has several.
        return rounded(metrics.running_metric(V.results(spark, d), "row_index", metric, LIVE, average, bucket_rows=1000))


for _key in _RUN_VALUE:
    _running(*_key)


# ---- metrics: analysis dialect ------------------------------------------------------

_gone = lambda c: f"({c} IS NULL OR lower({c}) IN ('nan', 'null', 'none', '', 'n/a'))"
JUDGED = _cells(V.JUDGED_SQL, "trim(ground_truth)", "trim(final_answer)", f"success AND NOT {_gone('ground_truth')} AND NOT {_gone('final_answer')}")
ANALYSIS = JUDGED + """, y AS (SELECT c AS class, tp, fp, fn, big, tp + fn AS support, tp + fp AS predicted_n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score FROM cnt, tot)"""
_ANALYSIS_COLS = {
    "accuracy": "sum(tp) / max(big)", "balanced_accuracy": "avg(recall)", "cohen_kappa": _kappa,
    "macro_precision": "avg(precision)", "macro_recall": "avg(recall)", "macro_f1": "avg(f1_score)",
    "weighted_precision": "sum(precision * support) / sum(support)", "weighted_recall": "sum(recall * support) / sum(support)",
    "weighted_f1": "sum(f1_score * support) / sum(support)",
}


def _analysis_cells(spark, d):
    return metrics.confusion_counts(metrics.analysis_pairs(V.judged(spark, d)))


@query("m2_m12_analysis_summary", f"{ANALYSIS} SELECT " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _ANALYSIS_COLS.items()) + ", CAST(max(big) AS BIGINT) AS valid FROM y")
def _(spark, d):
    return rounded(metrics.analysis_summary(_analysis_cells(spark, d)))


@query("m3_per_class_analysis", f"{ANALYSIS} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM y")
def _(spark, d):
    return rounded(metrics.analysis_per_class(_analysis_cells(spark, d)).select("class", "precision", "recall", "f1_score", "support"))


@query("m1_confusion_analysis", f"""{JUDGED} SELECT a.c AS actual, b.c AS predicted, CAST(coalesce(max(n), 0) AS BIGINT) AS n
 FROM cls a CROSS JOIN cls b LEFT JOIN cells ON cells.a = a.c AND cells.p = b.c GROUP BY 1, 2""")
def _(spark, d):
    return metrics.confusion_grid(_analysis_cells(spark, d))


EVAL = _cells("SELECT CASE WHEN turn = 0 THEN '-100' ELSE role END AS t, CASE WHEN contains(text, '?') OR turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS g FROM conversations", "t", "g", "t <> '-100'")


@query("m19_eval_metrics", EVAL + """, y AS (SELECT tp, big, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cnt, tot)
 SELECT round(sum(tp) / max(big), 6) AS accuracy, round(avg(f1), 6) AS f1_score, CAST(max(big) AS BIGINT) AS eval_samples FROM y""")
def _(spark, d):
    turns = table(spark, d, "conversations").select(
        F.when(F.col("turn") == 0, "-100").otherwise(F.col("role")).alias("t"),
        F.when(F.contains("text", F.lit("?")) | (F.col("turn") % 2 == 0), "user").otherwise("assistant").alias("g"),
    )
    s = metrics.analysis_summary(metrics.confusion_counts(metrics.eval_pairs(turns, "g", "t")))
    return rounded(s.select("accuracy", F.col("macro_f1").alias("f1_score"), F.col("valid").alias("eval_samples")))


# ---- voting -------------------------------------------------------------------------

VOTES = f"""WITH a AS ({V.ATTEMPTS_SQL}), g AS (SELECT row_index, answer, count(*) AS n, min(attempt_no) AS f FROM a WHERE success GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY n DESC, f) AS pos FROM g),
 v AS (SELECT row_index, max(answer) FILTER (pos = 1) AS final_answer, CAST(max(n) AS BIGINT) AS count, CAST(sum(n) AS BIGINT) AS total,
   CAST(max(n) AS DOUBLE) / sum(n) AS ratio, string_agg(answer || '=' || n, ',' ORDER BY answer) AS distribution, count(*) AS kinds FROM k GROUP BY 1)"""
_flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query("v1_consensus", f"{VOTES} SELECT row_index, final_answer, count, total, round(ratio, 6) AS ratio, distribution FROM v")
def _(spark, d):
    v = consensus.consensus(V.attempts(spark, d))
    return rounded(v.select("row_index", "final_answer", "count", "total", "ratio", _flat("distribution").alias("distribution")))


VOTED = VOTES + """, h AS (SELECT row_index, max(response) FILTER (attempt_no = 1) AS first_reply, bool_or(success) FILTER (attempt_no = 1) AS first_ok,
   bool_or(success) AS success, CAST(sum(response_time_ms) AS BIGINT) AS response_time_ms, max(props) FILTER (attempt_no = 1) AS thought
   FROM (SELECT a.*, e.props FROM a JOIN events e ON e.event_id = a.row_index * 5 + a.attempt_no - 1) GROUP BY 1)"""


def _voted(spark, d):
    return consensus.consensus_result(V.attempts(spark, d), ParsingRules(thinking_tags="<think></think>"))


@query("v2_consensus_result", f"""{VOTED} SELECT h.row_index, coalesce(final_answer, '') AS final_answer, CASE WHEN success THEN first_reply ELSE '' END AS raw_response,
 CASE WHEN success AND first_ok THEN thought ELSE '' END AS thinking_content, success, CASE WHEN success THEN '' ELSE 'all attempts failed' END AS error, response_time_ms,
 count, total FROM h LEFT JOIN v ON h.row_index = v.row_index""")
def _(spark, d):
    return _voted(spark, d).select(
        "row_index", "final_answer", "raw_response", "thinking_content", "success", "error", "response_time_ms",
        F.col("consensus.count").alias("count"), F.col("consensus.total").alias("total"),
    )


@query("v2_vote_in_place", f"""{VOTED} SELECT h.row_index, coalesce(final_answer, '') AS final_answer, CASE WHEN success THEN first_reply ELSE '' END AS raw_response,
 CASE WHEN success AND first_ok THEN thought ELSE '' END AS thinking_content, success, CASE WHEN success THEN '' ELSE 'all attempts failed' END AS error, response_time_ms,
 count, total, distribution FROM h LEFT JOIN v ON h.row_index = v.row_index""")
def _(spark, d):
    """Attempts in an array of their row (five by construction), parsed and voted there."""
    each = F.struct("attempt_no", "response", "response_time_ms", "success", F.lit("").alias("error"))
    rows = V.attempts(spark, d).groupBy("row_index").agg(F.sort_array(F.collect_list(each)).alias("attempts"))
    out = consensus.vote_in_place(rows, ParsingRules(thinking_tags="<think></think>", answer_patterns=[r"answer:\s*(\w+)"]))
    return out.select(
        "row_index", "final_answer", "raw_response", "thinking_content", "success", "error", "response_time_ms",
        F.col("consensus.count").alias("count"), F.col("consensus.total").alias("total"), _flat("consensus.distribution").alias("distribution"),
    )


@query("v3_consensus_summary", f"{VOTES} SELECT CAST(5 AS BIGINT) AS repeat_count, count(*) AS items_with_consensus, round(avg(ratio), 6) AS avg_consensus_ratio FROM v")
def _(spark, d):
    return rounded(consensus.consensus_summary(_voted(spark, d), 5))


@query("v3_consensus_variety", f"{VOTES} SELECT kinds AS distinct_answers, count(*) AS items FROM v GROUP BY 1")
def _(spark, d):
    return consensus.consensus_variety(_voted(spark, d))


@query("v4_consensus_stats", f"""{VOTES} SELECT CAST(arg_min(total, row_index) AS BIGINT) AS repeat_count, count(*) AS items_with_consensus, round(avg(ratio), 6) AS avg_consensus_ratio,
 round(min(ratio), 6) AS min_consensus_ratio, round(max(ratio), 6) AS max_consensus_ratio FROM v""")
def _(spark, d):
    return rounded(consensus.consensus_stats(_voted(spark, d)))


@query("i3_minimal_mode", f"""{VOTED} SELECT h.row_index, CASE WHEN success THEN first_reply ELSE '' END AS final_answer, success,
 CASE WHEN success THEN CAST(1 AS BIGINT) END AS count, CASE WHEN success THEN CAST(5 AS BIGINT) END AS total, CASE WHEN success THEN CAST(1 AS DOUBLE) END AS ratio FROM h""")
def _(spark, d):
    v = consensus.consensus_result(V.attempts(spark, d), minimal=True)
    return v.select("row_index", "final_answer", "success", F.col("consensus.count").alias("count"), F.col("consensus.total").alias("total"), F.col("consensus.ratio").alias("ratio"))


# ---- error analysis -----------------------------------------------------------------

CATEGORIES = f"""WITH r AS ({V.JUDGED_SQL}), c0 AS (SELECT *, CASE WHEN {_gone('final_answer')} THEN NULL ELSE trim(final_answer) END AS prediction,
   CASE WHEN {_gone('ground_truth')} THEN NULL ELSE trim(ground_truth) END AS truth FROM r),
 c AS (SELECT *, CASE WHEN NOT success THEN 'failed' WHEN prediction IS NULL OR truth IS NULL THEN 'missing' WHEN prediction = truth THEN 'correct' ELSE 'discrepancy' END AS category FROM c0),
 e AS (SELECT *, CASE WHEN category = 'missing' THEN CASE WHEN prediction IS NULL AND truth IS NULL THEN 'both' WHEN prediction IS NULL THEN 'prediction' ELSE 'ground_truth' END END AS missing_type,
   CASE WHEN category = 'discrepancy' THEN truth || '_to_' || prediction END AS error_type,
   CASE WHEN category = 'discrepancy' THEN CASE WHEN try_cast(prediction AS INTEGER) > try_cast(truth AS INTEGER) THEN 'overestimate'
     WHEN try_cast(prediction AS INTEGER) < try_cast(truth AS INTEGER) THEN 'underestimate' ELSE 'different_class' END END AS error_direction FROM c)"""


def _categorized(spark, d):
    return error_analysis.categorize(V.judged(spark, d))


@query("e1_categorize_records", f"{CATEGORIES} SELECT row_index, category, missing_type FROM e")
def _(spark, d):
    return _categorized(spark, d).select("row_index", "category", "missing_type")


@query("e2_error_type_direction", f"{CATEGORIES} SELECT row_index, error_type, error_direction FROM e")
def _(spark, d):
    return _categorized(spark, d).select("row_index", "error_type", "error_direction")


@query("e3_error_patterns", f"""{CATEGORIES} SELECT 'type' AS kind, error_type AS value, count(*) AS items FROM e WHERE category = 'discrepancy' GROUP BY 2
 UNION ALL SELECT 'direction', error_direction, count(*) FROM e WHERE category = 'discrepancy' GROUP BY 2""")
def _(spark, d):
    return error_analysis.error_patterns(_categorized(spark, d))


@query("e3_top_error_types", f"{CATEGORIES} SELECT error_type, count(*) AS items FROM e WHERE category = 'discrepancy' GROUP BY 1 ORDER BY items DESC, error_type LIMIT 5")
def _(spark, d):
    return error_analysis.top_error_types(_categorized(spark, d))


@query("e4_analysis_summary", ANALYSIS + f""", c0 AS (SELECT success, {_gone('final_answer')} OR {_gone('ground_truth')} AS gone, trim(final_answer) = trim(ground_truth) AS same FROM r),
 h AS (SELECT count(*) AS total_samples, count(*) FILTER (success AND NOT gone) AS valid_samples, count(*) FILTER (success AND gone) AS missing_samples,
  count(*) FILTER (NOT success) AS failed_predictions, count(*) FILTER (success AND NOT gone AND NOT same) AS total_errors FROM c0),
 m AS (SELECT """ + ", ".join(f"round({v}, 6) AS {k}" for k, v in _ANALYSIS_COLS.items()) + """ FROM y)
 SELECT h.*, round((total_samples - failed_predictions) / CAST(total_samples AS DOUBLE), 6) AS success_rate, round(total_errors / CAST(valid_samples AS DOUBLE), 6) AS error_rate, m.* FROM h, m""")
def _(spark, d):
    return rounded(error_analysis.analysis_summary(V.judged(spark, d)))


@query("e5_response_time_stats", f"""WITH t AS (SELECT response_time_ms / 1.0 AS ms FROM ({V.JUDGED_SQL}) WHERE response_time_ms > 0)
 SELECT round(avg(ms), 6) AS mean, round(stddev_samp(ms), 6) AS std, round(min(ms), 6) AS min, round(max(ms), 6) AS max, round(median(ms), 6) AS median FROM (SELECT CAST(ms AS DOUBLE) AS ms FROM t)""")
def _(spark, d):
    return rounded(error_analysis.response_time_stats(V.judged(spark, d)))


_RECORD_SQL = {
    "index": "row_index", "predicted": "prediction", "ground_truth": "truth", "text": "input_text", "thinking": "thinking_content",
    "text_length": "CAST(length(input_text) AS BIGINT)", "thinking_length": "CAST(length(thinking_content) AS BIGINT)",
}


def _records(layout):
    cols = ", ".join(f"{_RECORD_SQL.get(c, c)} AS {c}" for c in error_analysis.RECORD_LAYOUTS[layout])

    @query(f"e6_discrepancy_records_{layout}", f"{CATEGORIES} SELECT {cols} FROM e WHERE category = 'discrepancy'")
    def _(spark, d):
        return error_analysis.discrepancy_records(_categorized(spark, d), layout)


for _layout in error_analysis.RECORD_LAYOUTS:
    _records(_layout)


# ---- significance tests ---------------------------------------------------------------

@query("w1_chi_square", """WITH c AS (SELECT event_type AS a, user_id % 3 AS b, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM c GROUP BY a), k AS (SELECT b, sum(n) AS k FROM c GROUP BY b),
 s AS (SELECT CAST(sum(n) AS BIGINT) AS pairs, sum(n) * (sum(CAST(n AS DOUBLE) * n / r / k) - 1) AS x, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS degrees FROM c JOIN r USING (a) JOIN k USING (b)),
 p AS (SELECT exp(-x / 2) * sum((x / 2) ** i / gamma(i + 1)) AS p FROM s, range(0, 4) AS t(i) GROUP BY x)
 SELECT pairs, degrees, round(x, 6) AS statistic, round(p, 6) AS p_value, round(sqrt(x / pairs / 2), 6) AS cramers_v FROM s, p""")
def _(spark, d):
    """Event types against thirds of the users: an even number of degrees has a closed form."""
    cells = table(spark, d, "events").groupBy(F.col("event_type").alias("actual"), (F.col("user_id") % 3).alias("predicted")).agg(F.count("*").alias("n"))
    return rounded(significance.chi_square(cells))


@query("w2_mcnemar", f"""WITH j AS (SELECT x.ground_truth = x.final_answer AS a, y.ground_truth = y.final_answer AS b FROM ({V.results_sql(5)}) x JOIN ({V.results_sql(7)}) y USING (row_index) WHERE x.success AND y.success),
 s AS (SELECT count(*) AS pairs, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM j),
 e AS (SELECT least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0)))) AS p FROM s, range(0, 1000000) AS t(i) WHERE i <= least(b, c))
 SELECT pairs, b AS only_first, c AS only_second, round(greatest(abs(b - c) - 1, 0) ** 2 / (b + c), 6) AS statistic, round(p, 6) AS exact_p_value FROM s, e""")
def _(spark, d):
    return rounded(significance.mcnemar(V.results(spark, d, 5), V.results(spark, d, 7)).drop("p_value"))


@query("w3_binomial", """WITH s AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS k FROM events),
 f AS (SELECT i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.8) + (n - i) * ln(0.2)) AS f, k FROM s, range(0, 10000000) AS t(i) WHERE i <= n),
 p AS (SELECT coalesce(sum(f) FILTER (i <= k), 0) AS low, coalesce(sum(f) FILTER (i >= k), 0) AS high FROM f)
 SELECT n AS trials, k AS hits, round(k / n, 6) AS share, round(low, 6) AS p_at_most, round(high, 6) AS p_at_least, round(least(1.0, 2 * least(low, high)), 6) AS p_value FROM s, p""")
def _(spark, d):
    return rounded(significance.binomial(table(spark, d, "events"), F.col("event_type") != "error", 0.8))


@query("w4_kolmogorov_smirnov", """WITH c AS (SELECT value AS v, count(*) FILTER (event_type <> 'view') AS a, count(*) FILTER (event_type = 'view') AS b FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1),
 r AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM c), t AS (SELECT CAST(sum(a) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS m FROM c),
 s AS (SELECT n, m, max(abs(fa - fb)) AS s, sqrt(CAST(n AS DOUBLE) * m / (n + m)) AS root FROM r, t GROUP BY n, m), x AS (SELECT *, (root + 0.12 + 0.11 / root) * s AS x FROM s)
 SELECT n AS first_n, m AS second_n, round(s, 6) AS statistic, round(CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, (SELECT sum(CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * j * j * x * x)) FROM range(1, 101) AS t(j)))) END, 6) AS p_value FROM x""")
def _(spark, d):
    return rounded(significance.kolmogorov_smirnov(table(spark, d, "events"), F.col("value"), F.col("event_type") == "view"))
