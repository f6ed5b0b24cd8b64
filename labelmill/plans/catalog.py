"""All registered queries, and the flagship one."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmill.config import Job, Provider
from labelmill.functions.parsing import ParsingRules
from labelmill.operators import metrics
from labelmill.operators.infer import HashResponder
from labelmill.plans import queries_clean, queries_io, queries_stats, queries_text, views  # noqa: F401
from labelmill.plans.labelling import label_stream, label_table, label_to
from labelmill.plans.registry import QUERIES, SQL, query, rounded, table
from labelmill.session import scratch_path
from labelmill.streaming import streams

__all__ = ["QUERIES", "SQL", "flagship"]

JOB = Job(
    provider=Provider(name="vllm", base_url="http://model"),
    system="You judge documents.",
    user="Is this {lang} document from {source} good? {text}",
    parsing=ParsingRules(thinking_tags="<think></think>", answer_patterns=[r"answer:\s*(\w+)"], find=["0", "1"], default="none"),
    parameters={"temperature": 0.0, "max_tokens": 16},
    workers=8,
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for every document, replies of the hash responder, parsed answers, and the
    report figures per class over the documents that have a label."""
    rows = views.labelled(spark, sf_dir).withColumn("row_index", F.col("doc_id"))
    results = label_table(rows, JOB, HashResponder()).filter("quality is not null").withColumn("ground_truth", F.col("quality").cast("string"))
    return metrics.report_per_class(results).select("class", "precision", "recall", "f1", "specificity", "jaccard", "support")


_PROMPT = "'Is this ' || coalesce(lang, '') || ' document from ' || coalesce(source, '') || ' good? ' || coalesce(text, '')"
_H = f"md5(doc_id || chr(10) || {_PROMPT})"


@query("run_label_documents", f"""WITH r AS (SELECT CAST(quality AS VARCHAR) AS a, CASE CAST('0x' || substr({_H}, 1, 4) AS INTEGER) % 2 WHEN 0 THEN '0' ELSE '1' END AS p
   FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND CAST('0x' || substr({_H}, 5, 2) AS INTEGER) % 10 <> 0), c AS (SELECT '0' AS c UNION ALL SELECT '1'),
 k AS (SELECT c, CAST(count(*) FILTER (a = c AND p = c) AS DOUBLE) AS tp, CAST(count(*) FILTER (a <> c AND p = c) AS DOUBLE) AS fp,
   CAST(count(*) FILTER (a = c AND p <> c) AS DOUBLE) AS fn, CAST(count(*) FILTER (a <> c AND p <> c) AS DOUBLE) AS tn FROM r, c GROUP BY c)
 SELECT c AS class, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
   round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp + fn), 6) AS jaccard, CAST(tp + fn AS BIGINT) AS support FROM k""")
def _(spark, d):
    return rounded(flagship(spark, d))


_STREAM_REPLY = f"""SELECT doc_id AS index, text AS input_text, CAST('0x' || substr({_H}, 5, 2) AS INTEGER) % 10 <> 0 AS inference_success,
 CASE WHEN CAST('0x' || substr({_H}, 5, 2) AS INTEGER) % 10 = 0 THEN '' WHEN CAST('0x' || substr({_H}, 1, 4) AS INTEGER) % 2 = 0 THEN '0' ELSE '1' END AS final_answer,
 CASE WHEN CAST('0x' || substr({_H}, 5, 2) AS INTEGER) % 10 = 0 THEN '' ELSE 'case ' || substr({_H}, 1, 4) END AS thinking_content FROM documents"""


@query("k1_durable_run", _STREAM_REPLY)
def _(spark, d):
    """A run over a part of the documents, then one over all: it asks for the rest only."""
    rows = table(spark, d, "documents").withColumn("row_index", F.col("doc_id"))
    path = scratch_path(spark, "durable-run")
    label_to(rows.filter("lang = 'en'"), JOB, HashResponder(), path)
    out = label_to(rows, JOB, HashResponder(), path)
    return out.select(F.col("row_index").alias("index"), "input_text", F.col("success").alias("inference_success"), "final_answer", "thinking_content")


@query("t1_stream_labelling", _STREAM_REPLY)
def _(spark, d):
    """Documents arrive as a file stream, are labelled, and their results streamed out."""
    out, checkpoint = (scratch_path(spark, x) for x in ("label-out", "label-cp"))
    docs = table(spark, d, "documents").withColumn("row_index", F.col("doc_id"))
    stream = queries_io.as_stream(spark, docs, "label-in")
    streams.stream_results(label_stream(stream, JOB, HashResponder()), out, checkpoint, "parquet").awaitTermination()
    return spark.read.parquet(out).select("index", "input_text", "inference_success", "final_answer", "thinking_content")


@query("run_label_repeated", f"""WITH a AS (SELECT doc_id, n, md5(doc_id || ':' || n || chr(10) || {_PROMPT}) AS h FROM documents CROSS JOIN range(1, 4) AS k(n)),
 r AS (SELECT doc_id, n, CAST('0x' || substr(h, 5, 2) AS INTEGER) % 10 <> 0 AS ok, CASE CAST('0x' || substr(h, 1, 4) AS INTEGER) % 2 WHEN 0 THEN '0' ELSE '1' END AS answer FROM a),
 g AS (SELECT doc_id, answer, count(*) AS c, min(n) AS f FROM r WHERE ok GROUP BY 1, 2), v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) AS pos, sum(c) OVER (PARTITION BY doc_id) AS total FROM g)
 SELECT d.doc_id AS row_index, coalesce(answer, '') AS final_answer, answer IS NOT NULL AS success, CAST(c AS BIGINT) AS votes, CAST(total AS BIGINT) AS total FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id AND pos = 1""")
def _(spark, d):
    """Every document asked three times in one task, voted on, written once."""
    docs = table(spark, d, "documents").withColumn("row_index", F.col("doc_id"))
    job = dataclasses.replace(JOB, repeat=3)
    out = label_table(docs, job, HashResponder())
    return out.select("row_index", "final_answer", "success", F.col("consensus.count").alias("votes"), F.col("consensus.total").alias("total"))
