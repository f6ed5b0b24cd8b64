"""Registered queries: sources, sinks, joins, resume and streams.

Files are written by Spark from the given tables into the shared scratch folder and
read back, so a query exercises the writer and the reader on whole tables.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from labelmill.operators import report, resume, run_stats
from labelmill.plans import views as V
from labelmill.plans.queries_stats import LIVE, LIVE_SQL, REPORT, VOTES, R
from labelmill.plans.registry import query, rounded, table
from labelmill.session import scratch_path
from labelmill.sinks import writers
from labelmill.sources import readers, results as saved
from labelmill.streaming import streams


# ---- sources ------------------------------------------------------------------------

def _in_order(df: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Rows in key order over files: as many as the input has partitions, and at least a few
    so that small tables too are read from several."""
    n = max(least, df.rdd.getNumPartitions())
    return df.repartitionByRange(n, key).sortWithinPartitions(key)


def _json_arrays(df: DataFrame, key: str, path: str, wrap: tuple[str, str] = ("", "")) -> str:
    """A JSON array file per partition, written line by line: nothing is gathered."""
    head, tail = wrap

    def array(batches):
        open_with = head + "["
        for pdf in batches:
            lines = []
            for line in pdf["line"]:
                lines.append(open_with + line)
                open_with = ","
            yield pd.DataFrame({"value": lines}, dtype=object)
        if open_with == ",":
            yield pd.DataFrame({"value": ["]" + tail]})

    lines = _in_order(df, key).select(F.to_json(F.struct(*df.columns)).alias("line"))
    lines.mapInPandas(array, "value string").write.text(path)
    return path


_CSV_DOCS = "SELECT doc_id AS row_index, CAST(doc_id AS VARCHAR) AS doc_id, text, lang, CAST(n_chars AS VARCHAR) AS n_chars FROM documents"


def _csv_docs(spark, d):
    path = scratch_path(spark, "docs-csv")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    docs = _in_order(docs, "doc_id")
    writer = docs.write.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("s1_load_csv", _CSV_DOCS)
def _(spark, d):
    return readers.load_csv(spark, _csv_docs(spark, d))


@query("s1_load_csv_broken_rows", """SELECT event_id AS row_index, CAST(event_id AS VARCHAR) AS id, event_type AS kind, CAST(user_id AS VARCHAR) AS usr FROM events WHERE event_type NOT IN ('error', 'view')""")
def _(spark, d):
    """Rows of errors lack a cell and rows of views have one too many: both are skipped
    and leave their positions free."""
    kind, i, u = F.col("event_type"), F.col("event_id").cast("string"), F.col("user_id").cast("string")
    line = F.when(kind == "error", F.concat_ws(",", i, kind)).when(kind == "view", F.concat_ws(",", i, kind, u, u)).otherwise(F.concat_ws(",", i, kind, u))
    path = scratch_path(spark, "broken-csv")
    parts = _in_order(table(spark, d, "events"), "event_id")
    # The row before which each file's header goes is the first of its partition.
    lines = parts.select("event_id", line.alias("line")).mapInPandas(_with_header, "value string")
    lines.write.text(path)
    return readers.load_csv(spark, path)


def _with_header(batches):
    """Each file starts with the header line, as separate exports do."""
    head = ["id,kind,usr"]
    for pdf in batches:
        yield pd.DataFrame({"value": head + pdf["line"].tolist()})
        head = []


@query("s2_load_json", "SELECT doc_id AS row_index, doc_id, text, lang, n_chars FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    return readers.load_json(spark, _json_arrays(docs, "doc_id", scratch_path(spark, "docs-json")))


@query("s2_load_json_lines", "SELECT event_id AS row_index, event_id, event_type, value FROM events")
def _(spark, d):
    path = scratch_path(spark, "events-jsonl")
    _in_order(table(spark, d, "events").select("event_id", "event_type", "value"), "event_id").write.json(path)
    return readers.load_json(spark, path, lines=True)


@query("s3_load_parquet", "SELECT doc_id AS row_index, * FROM documents")
def _(spark, d):
    return readers.load_parquet(spark, f"{d}/documents.parquet")


@query("s4_load_results", f"""{R} SELECT row_index, input_text, ground_truth, final_answer, success, error, response_time_ms FROM r""")
def _(spark, d):
    """A run saved with the older field names, nanoseconds and a results object."""
    old = V.results(spark, d).select(
        F.col("row_index").alias("index"), "input_text", "ground_truth", "final_answer", F.col("success").alias("inference_success"),
        "error", (F.col("response_time_ms") * 1000000).alias("response_time"),
    )
    path = _json_arrays(old, "index", scratch_path(spark, "old-run"), ('{"results": ', ', "summary": {"total": 1}}'))
    out = saved.load_results(spark, path, time_unit="ns")
    return out.select("row_index", "input_text", "ground_truth", "final_answer", "success", "error", "response_time_ms")


@query("s5_load_table", "SELECT event_id AS row_index, * FROM events")
def _(spark, d):
    return readers.load_table(spark, f"{d}/events.parquet")


def _as_workbook(pdf: pd.DataFrame) -> pd.DataFrame:
    """One workbook of a group's rows: numbers as values, every other name as shared text."""
    book, rows = int(pdf["book"].iloc[0]), pdf.sort_values("doc_id")
    names = ["doc_id", "text", "source", "n_chars"]
    shared = {v: i for i, v in enumerate(dict.fromkeys([*names, *rows["source"].fillna("")]))}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    lines = ['<row r="1">' + "".join(f'<c r="{c}1" t="s"><v>{shared[n]}</v></c>' for c, n in zip("ABCD", names)) + "</row>"]
    for i, r in enumerate(rows.itertuples(), 2):
        cells = f'<c r="A{i}"><v>{r.doc_id}</v></c><c r="B{i}" t="inlineStr"><is><t>{escape(r.text)}</t></is></c>'
        lines.append(f'<row r="{i}">{cells}<c r="C{i}" t="s"><v>{shared[r.source or ""]}</v></c><c r="D{i}"><v>{r.n_chars}</v></c></row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{escape(v)}</t></si>" for v in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(lines) + "</sheetData></worksheet>")
    return pd.DataFrame({"path": [f"book-{book}"], "content": [out.getvalue()]})


@query("s6_read_workbooks", r"""SELECT 'book-' || CAST(doc_id // 500 AS VARCHAR) AS file, doc_id % 500 AS row_index, CAST(doc_id AS VARCHAR) AS doc_id, source, CAST(n_chars AS VARCHAR) AS n_chars,
  CASE WHEN t = '' THEN CAST(doc_id AS VARCHAR) ELSE t END AS text FROM (SELECT *, regexp_replace(coalesce(text, ''), '[^\x20-\x7E\x{A0}-\x{D7FF}]+', ' ', 'g') AS t FROM documents)""")
def _(spark, d):
    """Documents in workbooks of 500 rows, without the characters that XML has no form for."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E\x{A0}-\x{D7FF}]+", " ")
    docs = table(spark, d, "documents").select("doc_id", plain.alias("text"), "source", "n_chars", F.floor(F.col("doc_id") / 500).alias("book"))
    books = docs.groupBy("book").applyInPandas(_as_workbook, "path string, content binary")
    cell = lambda n: F.col("cells")[n].alias(n)
    return readers.read_workbooks(books).select("file", "row_index", cell("doc_id"), cell("source"), cell("n_chars"), "text")


_TEXT_VIEW = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE source END AS content, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE lang END AS text, text AS body FROM documents"""
_TEXT_SQL = {
    "csv": "CASE WHEN coalesce(text, '') = '' THEN head ELSE text END",
    "json": "coalesce(text, content, {long})",
    "parquet": "CASE WHEN coalesce(text, content, '') = '' THEN {long} ELSE coalesce(text, content) END",
}
_LONG = "coalesce(CASE WHEN strlen(head) > 10 THEN head END, CASE WHEN strlen(content) > 10 THEN content END, CASE WHEN strlen(text) > 10 THEN text END, CASE WHEN strlen(body) > 10 THEN body END, '')"


def _resolve(kind):
    @query(f"s7_resolve_text_{kind}", f"SELECT doc_id, {_TEXT_SQL[kind].format(long=_LONG)} AS resolved FROM (SELECT 'd' || doc_id AS head, * FROM ({_TEXT_VIEW}))")
    def _(spark, d):
        i = F.col("doc_id")
        view = table(spark, d, "documents").select(
            F.concat(F.lit("d"), i.cast("string")).alias("head"),
            F.when(i % 3 == 0, None).when(i % 3 == 1, "").otherwise(F.col("source")).alias("content"),
            F.when(i % 5 == 0, None).when(i % 5 == 1, "").otherwise(F.col("lang")).alias("text"), F.col("text").alias("body"), "doc_id",
        )
        return view.select("doc_id", readers.resolve_text(view.schema, kind).alias("resolved"))


for _kind in _TEXT_SQL:
    _resolve(_kind)


@query("s8_row_index", "SELECT doc_id, doc_id AS row_index FROM documents")
def _(spark, d):
    path = scratch_path(spark, "docs-parts")
    _in_order(table(spark, d, "documents").select("doc_id", "text"), "doc_id").write.parquet(path)
    return readers.load_parquet(spark, path).select("doc_id", "row_index")


@query("s9_limit_rows", "SELECT event_id, event_type FROM events WHERE event_id < 250")
def _(spark, d):
    return readers.limit_rows(readers.load_parquet(spark, f"{d}/events.parquet"), 250).select("event_id", "event_type")


@query("s10_load_ground_truth", "SELECT d.doc_id AS row_index, d.lang, CAST(l.quality AS VARCHAR) AS reference_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    docs = readers.load_parquet(spark, f"{d}/documents.parquet")
    return readers.join_ground_truth(docs, table(spark, d, "labels"), "doc_id", "quality").select("row_index", "lang", "reference_label")


# ---- sinks --------------------------------------------------------------------------

def _run(spark, d):
    """Results with two original columns, one of them named like a result field on disk."""
    r = V.results(spark, d)
    return r.withColumn("index", F.col("user_id") + 1000)


@query("k1_write_json", f"""{R} SELECT row_index AS index, input_text, ground_truth, final_answer, raw_response, thinking_content, success AS inference_success, error, response_time_ms AS response_time,
 user_id, user_id + 1000 AS orig_index FROM r""")
def _(spark, d):
    path = scratch_path(spark, "out-json")
    out = _run(spark, d)
    writers.write_json(out, path, with_truth=True, metric="f1", classes=V.CLASSES)
    return spark.read.schema(writers.json_projection(out, True).schema).json(f"{path}/results")


@query("k1_run_summary", LIVE_SQL + """, o AS (SELECT count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failed FROM r)
 SELECT total, success, failed, 'F1-macro' AS metric_name, round(v, 6) AS metric_value FROM o, (SELECT avg(f1) * 100 AS v FROM f)""")
def _(spark, d):
    s = writers.run_summary(V.results(spark, d), "f1", LIVE)
    return rounded(s.select("total", "success", "failed", "live_metrics.metric_name", "live_metrics.metric_value"))


@query("k2_write_csv", f"""{R} SELECT CAST(user_id AS VARCHAR) AS user_id, raw_response, CAST(response_time_ms AS VARCHAR) AS response_time, CAST(success AS VARCHAR) AS inference_success, final_answer, ground_truth FROM r""")
def _(spark, d):
    path = scratch_path(spark, "out-csv")
    writers.write_csv(V.results(spark, d), path, with_truth=True)
    return spark.read.option("header", True).option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(path)


def _half(spark, d):
    """Original rows, and results for the rows up to two thirds of the table, with gaps."""
    original = readers.load_parquet(spark, f"{d}/events.parquet").select("row_index", "event_id", "ts", "props")
    most = table(spark, d, "events").agg(F.floor(F.max("event_id") * 2 / 3))
    done = V.results(spark, d).filter((F.col("row_index") <= most.scalar()) & (F.col("user_id") != 8))
    return original, done


_HALF = f"{R}, h AS (SELECT * FROM r WHERE row_index <= (SELECT max(event_id) * 2 // 3 FROM events) AND user_id <> 8)"


_ENRICHED = f"""{_HALF} SELECT event_id, props, raw_response, coalesce(response_time_ms, 0) AS response_time, coalesce(success, false) AS inference_success, final_answer, ground_truth
 FROM events LEFT JOIN h ON event_id = row_index"""


def _enriched(spark, d, **options):
    path = scratch_path(spark, "out-enriched")
    original, done = _half(spark, d)
    writers.write_parquet_enriched(original, done, path, with_truth=True, **options)
    return spark.read.parquet(path).drop("ts")


@query("k3_write_parquet_enriched", f"{_ENRICHED} WHERE event_id <= (SELECT max(row_index) FROM h)")
def _(spark, d):
    return _enriched(spark, d, cut_unprocessed=True)


@query("k3_write_parquet_all_rows", _ENRICHED)
def _(spark, d):
    return _enriched(spark, d)


@query("k4_write_parquet_new", f"""{R} SELECT row_index AS index, raw_response, response_time_ms AS response_time, success AS inference_success, final_answer, thinking_content, CAST(user_id AS VARCHAR) AS user_id FROM r""")
def _(spark, d):
    path = scratch_path(spark, "out-new")
    writers.write_parquet_new(V.results(spark, d), path, with_thinking=True)
    return spark.read.parquet(path)


@query("k5_write_results", f"{R} SELECT row_index AS index, final_answer FROM r")
def _(spark, d):
    path = writers.write_results(V.results(spark, d), scratch_path(spark, "out-any"), "parquet")
    return spark.read.parquet(path).select("index", "final_answer")


_OVERALL = """ o AS (SELECT count(*) AS total, count(*) FILTER (success) / CAST(count(*) AS DOUBLE) * 100 AS success_rate, count(*) / (CAST(sum(response_time_ms) AS DOUBLE) / 1000.0) AS per_second FROM r),
 m AS (SELECT sum(tp) / max(big) * 100 AS accuracy, avg(recall) FILTER (support > 0) * 100 AS balanced_accuracy, avg(f1) * 100 AS macro_f1, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) * 100 AS micro_f1,
  sum(f1 * support) / sum(support) FILTER (f1 IS NOT NULL) * 100 AS weighted_f1, (sum(tp) / max(big) - sum(support / big * predicted_n / big)) / (1 - sum(support / big * predicted_n / big)) AS kappa, avg(mcc) AS mcc FROM full_per)"""
_SUMMARY_ROWS = ["accuracy", "balanced_accuracy", "macro_f1", "micro_f1", "weighted_f1", "kappa", "mcc", "success_rate"]


@query("k6_report_long", f"{REPORT}, {_OVERALL}" + " UNION ALL ".join([f" SELECT '{m}' AS metric, round({m}, 6) AS value, NULL AS class, 'summary' AS type FROM o, m" for m in _SUMMARY_ROWS]
    + [" SELECT 'throughput_per_second', round(per_second, 6), NULL, 'performance' FROM o"]
    + [f" SELECT '{n}', round(coalesce({c}, 0) * 100, 6), class, 'per_class' FROM full_per WHERE precision IS NOT NULL" for n, c in report.CLASS_METRICS]))
def _(spark, d):
    return rounded(report.report_long(V.results(spark, d)))


@query("k7_report_summary", f"""{REPORT}, {_OVERALL}, ti AS (SELECT sum(response_time_ms) AS s, count(*) AS n FROM r), pc AS (SELECT max(t) AS p95 FROM (SELECT response_time_ms AS t, row_number() OVER (ORDER BY response_time_ms) - 1 AS i, count(*) OVER () AS n FROM r) WHERE i = CAST(floor(CAST(n AS DOUBLE) * 0.95) AS BIGINT))
 SELECT 'Summary' AS section, 'Total Items' AS metric, CAST(total AS VARCHAR) AS value FROM o""" + "".join(
    f" UNION ALL SELECT '{s}', '{n.replace(chr(39), chr(39) * 2)}', printf('{f}', {c}) FROM o, m, ti, pc" for s, n, f, c in [
        ("Summary", "Success Rate", "%.2f%%", "success_rate"), ("Summary", "Accuracy", "%.2f%%", "accuracy"), ("Summary", "Balanced Accuracy", "%.2f%%", "balanced_accuracy"),
        ("Summary", "Macro F1", "%.2f%%", "macro_f1"), ("Summary", "Micro F1", "%.2f%%", "micro_f1"), ("Summary", "Weighted F1", "%.2f%%", "weighted_f1"),
        ("Summary", "Cohen's Kappa", "%.4f", "kappa"), ("Summary", "MCC", "%.4f", "mcc"), ("Performance", "Throughput Per Second", "%.2f", "per_second"),
        ("Performance", "Average Response Time", "%.3fms", "((s // n) * 1000000 + ((s % n) * 1000000) // n) / 1e6"), ("Performance", "P95 Response Time", "%.3fms", "CAST(p95 AS DOUBLE)")]))
def _(spark, d):
    return report.summary_section(V.results(spark, d))


_CLASS_COLS = report.CLASS_COLUMNS


@query("k7_report_per_class", f"{REPORT} SELECT class, " + ", ".join(f"printf('%.2f%%', coalesce({c}, 0) * 100) AS {c}" for c in _CLASS_COLS) + ", CAST(CAST(predicted_n AS BIGINT) AS VARCHAR) AS support FROM full_per WHERE predicted_n > 0")
def _(spark, d):
    return report.class_section(V.results(spark, d))


@query("k8_summary_sheet", f"{REPORT}, {_OVERALL}" + " UNION ALL ".join(f" SELECT '{n}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM o, m" for c, n in [
    ("total", "Total Items"), ("success_rate", "Success Rate"), ("accuracy", "Accuracy"), ("balanced_accuracy", "Balanced Accuracy"), ("macro_f1", "Macro F1"), ("micro_f1", "Micro F1"),
    ("weighted_f1", "Weighted F1"), ("kappa", "Cohen''s Kappa"), ("mcc", "MCC"), ("per_second", "Throughput/sec")]))
def _(spark, d):
    return rounded(report.summary_sheet(V.results(spark, d)))


@query("k8_per_class_sheet", f"{REPORT} SELECT class, " + ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in _CLASS_COLS) + ", CAST(predicted_n AS BIGINT) AS support FROM full_per WHERE predicted_n > 0")
def _(spark, d):
    return rounded(report.per_class_sheet(V.results(spark, d)))


@query("k8_confusion_sheet", f"""{REPORT} SELECT k.c AS actual, """ + ", ".join(f"CAST(coalesce(sum(n) FILTER (p = '{c}'), 0) AS BIGINT) AS {c}" for c in V.CLASSES) + " FROM cls k LEFT JOIN cells ON a = k.c GROUP BY 1")
def _(spark, d):
    return report.confusion_sheet(V.results(spark, d))


@query("k9_report_stats", f"{R} SELECT count(*) AS total, count(*) FILTER (success) AS success FROM r")
def _(spark, d):
    """The overview part of the rendered document's statistics, as a table."""
    return run_stats.overview(V.results(spark, d)).select("total", "success")


@query("k11_output_projection", f"{R} SELECT CAST(user_id AS VARCHAR) AS user_id, thinking_content, response_time_ms AS response_time, success AS inference_success, final_answer FROM r")
def _(spark, d):
    return writers.csv_projection(V.results(spark, d), with_thinking=True, with_raw=False)


# ---- joins and resume ---------------------------------------------------------------

_DONE = "(SELECT event_id AS row_index FROM events WHERE user_id <> 8 AND event_type <> 'view')"


def _done(spark, d):
    return V.results(spark, d).filter("user_id <> 8 and final_answer <> 'view'")


def _events(spark, d):
    return readers.load_parquet(spark, f"{d}/events.parquet").select("row_index", "event_type", "value")


@query("j1_resume_remaining", f"SELECT event_id AS row_index, event_type, value FROM events WHERE event_id NOT IN (SELECT row_index FROM {_DONE})")
def _(spark, d):
    return resume.remaining(_events(spark, d), _done(spark, d))


@query("j1_retry_failed", f"SELECT event_id AS row_index, event_type, value FROM events WHERE user_id = 8 OR event_type IN ('view', 'error')")
def _(spark, d):
    return resume.remaining(_events(spark, d), _done(spark, d), retry_failed=True)


@query("j2_merge_results", f"{R} SELECT row_index, final_answer, CASE WHEN success THEN NULL ELSE error END AS error FROM r")
def _(spark, d):
    r = V.results(spark, d)
    old = r.filter("success").select("row_index", "final_answer")
    return resume.merge_results(old, r.filter("not success").select("row_index", "final_answer", "error"))


@query("j3_enrich_original", f"{_HALF} SELECT e.event_id AS row_index, event_type, value, final_answer FROM events e LEFT JOIN h ON event_id = h.row_index")
def _(spark, d):
    return resume.enrich_original(_events(spark, d), _half(spark, d)[1].select("row_index", "final_answer"))


@query("j4_join_labels", "SELECT d.doc_id AS row_index, CAST(l.toxic AS VARCHAR) AS reference_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    docs = readers.load_parquet(spark, f"{d}/documents.parquet").select("row_index")
    return readers.join_ground_truth(docs, table(spark, d, "labels"), "doc_id", "toxic")


@query("j5_resume_state", f"""SELECT (SELECT count(*) FROM {_DONE}) AS completed, count(*) AS total, count(*) - (SELECT count(*) FROM {_DONE}) AS remaining, 'partial' AS state FROM events""")
def _(spark, d):
    return resume.resume_state(_events(spark, d), _done(spark, d))


# ---- streams ------------------------------------------------------------------------

def as_stream(spark, df, label, batches=3):
    """The table as a file stream of about ``batches`` micro-batches, whatever its size."""
    path, parts = scratch_path(spark, label), df.rdd.getNumPartitions()
    (df if parts >= batches else df.repartition(batches)).write.parquet(path)
    return streams.read_stream(spark, path, df.schema, files_per_batch=-(-max(parts, batches) // batches))


def _result_stream(spark, d, label):
    return as_stream(spark, V.results(spark, d), label)


@query("t1_stream_results_parquet", f"""{R} SELECT row_index AS index, input_text, ground_truth, final_answer, success AS inference_success, response_time_ms AS response_time, thinking_content, raw_response,
 '{{"user_id":' || user_id || '}}' AS original_data_json FROM r""")
def _(spark, d):
    out = scratch_path(spark, "stream-out")
    streams.stream_results(_result_stream(spark, d, "stream-in"), out, scratch_path(spark, "stream-cp"), "parquet").awaitTermination()
    return spark.read.parquet(out)


@query("t1_stream_results_csv", f"""{R} SELECT CAST(user_id AS VARCHAR) AS user_id, raw_response, thinking_content, CAST(response_time_ms AS VARCHAR) AS response_time, CAST(success AS VARCHAR) AS inference_success, final_answer FROM r""")
def _(spark, d):
    out = scratch_path(spark, "stream-out")
    streams.stream_results(_result_stream(spark, d, "stream-in"), out, scratch_path(spark, "stream-cp"), "csv", with_thinking=True).awaitTermination()
    return spark.read.option("header", True).option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(out)


def _last(spark, out):
    """The row of the last batch."""
    runs = spark.read.parquet(out).drop("run")
    return runs.filter(F.col("batch") == runs.agg(F.max("batch")).scalar()).drop("batch")


@query("t2_stream_metric", f"{LIVE_SQL} SELECT 'F1-macro' AS metric_name, round(avg(f1) * 100, 6) AS metric_value, CAST(max(big) AS BIGINT) AS pairs FROM f")
def _(spark, d):
    out = scratch_path(spark, "metric-out")
    streams.stream_metric(_result_stream(spark, d, "metric-in"), scratch_path(spark, "metric-cp"), out, "f1", LIVE).awaitTermination()
    return rounded(_last(spark, out))


@query("t3_stream_counters", f"{R} SELECT count(*) AS processed, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM r")
def _(spark, d):
    out = scratch_path(spark, "count-out")
    streams.stream_counters(_result_stream(spark, d, "count-in"), scratch_path(spark, "count-cp"), out).awaitTermination()
    return _last(spark, out).drop("percent")


@query("t4_stream_resume", f"{R} SELECT row_index AS index, final_answer FROM r")
def _(spark, d):
    """Two runs over a growing folder with one checkpoint: nothing is lost or repeated."""
    r = V.results(spark, d)
    path, out, cp = (scratch_path(spark, x) for x in ("resume-in", "resume-out", "resume-cp"))
    parts = [r.filter("success"), r.filter("not success")]
    for part in parts:
        part.write.mode("append").parquet(path)
        streams.stream_results(streams.read_stream(spark, path, r.schema, 1), out, cp, "parquet").awaitTermination()
    return spark.read.parquet(out).select("index", "final_answer")


@query("t5_stream_consensus", f"{VOTES} SELECT row_index, final_answer, count, total, round(ratio, 6) AS ratio FROM v")
def _(spark, d):
    a = V.attempts(spark, d)
    source = as_stream(spark, a, "votes-in")
    out = scratch_path(spark, "votes-out")
    streams.write_once(streams.stream_consensus(source, 5), out, scratch_path(spark, "votes-cp")).awaitTermination()
    return rounded(spark.read.parquet(out))


@query("t5_stream_consensus_gaps", f"{VOTES} SELECT row_index, final_answer, count, total, round(ratio, 6) AS ratio FROM v")
def _(spark, d):
    """Failed attempts never arrive and first ones arrive twice; the rest is voted at the end."""
    a = V.attempts(spark, d).filter("success")
    a = a.unionByName(a.filter("attempt_no = 1"))
    out = scratch_path(spark, "gaps-out")
    streams.write_once(streams.stream_consensus(as_stream(spark, a, "gaps-in"), 5), out, scratch_path(spark, "gaps-cp")).awaitTermination()
    voted = spark.read.parquet(out)
    return rounded(voted.unionByName(streams.votes_at_end(a, voted)))


@query("t5_stream_consensus_timers", f"{VOTES} SELECT row_index, final_answer, count, total, round(ratio, 6) AS ratio FROM v")
def _(spark, d):
    """Failed attempts never arrive, so rows that have one vote by their timers. Attempts are a
    second apart; a last marker, which is no vote, moves event time beyond the last timer."""
    at = (F.col("row_index") * 10 + F.col("attempt_no")).cast("timestamp")
    a = V.attempts(spark, d).filter("success").select("row_index", "attempt_no", "answer", "success", at.alias("at"))
    path, out = scratch_path(spark, "timed-in"), scratch_path(spark, "timed-out")
    _in_order(a, "row_index").write.parquet(path)
    last = a.agg(F.max("at").alias("last")).selectExpr("cast(null as bigint) as row_index", "0 as attempt_no", "'' as answer", "false as success", "last + interval 1 hour as at")
    last.write.mode("append").parquet(path)
    buckets = max(256, -(-spark.read.parquet(path).count() // 4096))
    votes = streams.stream_consensus(streams.read_stream(spark, path, a.schema), 5, buckets=buckets, time="at", wait="1 minute")
    streams.write_once(votes, out, scratch_path(spark, "timed-cp")).awaitTermination()
    return rounded(spark.read.parquet(out))
