"""Run-shaped tables derived from the given ones, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmill.plans.registry import table
from labelmill.session import spread

CLASSES = ["signup", "click", "view", "purchase"]


def _choose(key, options):
    out = None
    for i, o in enumerate(options[:-1]):
        out = F.when(key == i, o) if out is None else out.when(key == i, o)
    return out.otherwise(options[-1])


def results(spark: SparkSession, d: str, every: int = 5) -> DataFrame:
    """A finished run: one result per event, every n-th user's truths differ."""
    kind, i = F.col("event_type"), F.col("event_id") % 4
    ok = kind != "error"
    errors = ["request Timeout after 60s", "Connection refused", "failed to parse body", "server said no"]
    return table(spark, d, "events").select(
        F.col("event_id").alias("row_index"),
        F.col("user_id"),
        F.col("props").alias("input_text"),
        F.when(F.col("user_id") % every != 0, kind).otherwise(_choose(i, CLASSES)).alias("ground_truth"),
        F.when(ok, kind).otherwise("").alias("final_answer"),
        F.when(ok, F.concat(F.lit("Answer: "), kind)).otherwise("").alias("raw_response"),
        F.when(ok, F.col("props")).otherwise("").alias("thinking_content"),
        ok.alias("success"),
        F.when(ok, "").otherwise(_choose(i, errors)).alias("error"),
        F.round(F.col("value") * 100).cast("long").alias("response_time_ms"),
    )


def results_sql(every: int = 5) -> str:
    return f"""SELECT event_id AS row_index, user_id, props AS input_text,
  CASE WHEN user_id % {every} <> 0 THEN event_type WHEN event_id % 4 = 0 THEN 'signup' WHEN event_id % 4 = 1 THEN 'click'
       WHEN event_id % 4 = 2 THEN 'view' ELSE 'purchase' END AS ground_truth,
  CASE WHEN event_type <> 'error' THEN event_type ELSE '' END AS final_answer,
  CASE WHEN event_type <> 'error' THEN 'Answer: ' || event_type ELSE '' END AS raw_response,
  CASE WHEN event_type <> 'error' THEN props ELSE '' END AS thinking_content,
  event_type <> 'error' AS success,
  CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 4 = 0 THEN 'request Timeout after 60s' WHEN event_id % 4 = 1 THEN 'Connection refused'
       WHEN event_id % 4 = 2 THEN 'failed to parse body' ELSE 'server said no' END AS error,
  CAST(round(value * 100) AS BIGINT) AS response_time_ms
 FROM events"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Five attempts per row: consecutive events are one row's attempts."""
    return table(spark, d, "events").select(
        F.floor(F.col("event_id") / 5).alias("row_index"),
        (F.col("event_id") % 5 + 1).cast("int").alias("attempt_no"),
        F.concat(F.lit("<think>"), "props", F.lit("</think> Answer: "), "event_type").alias("response"),
        F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("answer"),
        (F.col("event_type") != "error").alias("success"),
        F.round(F.col("value") * 100).cast("long").alias("response_time_ms"),
    )


ATTEMPTS_SQL = """SELECT event_id // 5 AS row_index, CAST(event_id % 5 + 1 AS INTEGER) AS attempt_no,
  '<think>' || props || '</think> Answer: ' || event_type AS response,
  CASE WHEN event_type <> 'error' THEN event_type ELSE '' END AS answer, event_type <> 'error' AS success,
  CAST(round(value * 100) AS BIGINT) AS response_time_ms FROM events"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels where they have any."""
    return spread(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id", "left")


LABELLED_SQL = "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Replies of every shape the parser has to handle, built around whole documents."""
    q = F.coalesce(F.col("quality").cast("string"), F.lit("unknown"))
    text = F.col("text")
    lit = F.lit
    shapes = [
        F.concat(lit("Answer: "), q),
        F.concat(lit("<think>"), F.translate(text, "\n", " "), lit("</think> classification: "), q),
        F.concat(lit("<think>\n"), text, lit("\n</think>\nAnswer: "), q, lit(" done")),
        F.concat(lit("<think>"), text),
        lit(""),
        F.concat(lit("  the label is POSITIVE for "), F.col("source"), lit(" ")),
        F.concat(text, lit("\nANSWER: "), q),
    ]
    return labelled(spark, d).select("doc_id", _choose(F.col("doc_id") % 7, shapes).alias("raw_response"))


RESPONSES_SQL = f"""SELECT doc_id, CASE doc_id % 7
   WHEN 0 THEN 'Answer: ' || q
   WHEN 1 THEN '<think>' || replace(text, chr(10), ' ') || '</think> classification: ' || q
   WHEN 2 THEN '<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || 'Answer: ' || q || ' done'
   WHEN 3 THEN '<think>' || text
   WHEN 4 THEN ''
   WHEN 5 THEN '  the label is POSITIVE for ' || source || ' '
   ELSE text || chr(10) || 'ANSWER: ' || q END AS raw_response
 FROM (SELECT *, coalesce(CAST(quality AS VARCHAR), 'unknown') AS q FROM ({LABELLED_SQL}))"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with missing values of every kind against document labels."""
    i = F.col("doc_id") % 11
    none = F.lit(None).cast("string")
    guess = _choose(i, [F.lit("nan"), F.lit(""), none, F.lit(" 1 "), F.lit("2"), F.lit("N/A"), F.lit("other"), F.col("toxic").cast("string")])
    return labelled(spark, d).select(
        F.col("doc_id").alias("row_index"), F.col("text").alias("input_text"), F.col("lang").alias("thinking_content"),
        guess.alias("final_answer"), F.col("quality").cast("string").alias("ground_truth"),
        (F.col("doc_id") % 13 != 0).alias("success"), F.when(F.col("doc_id") % 17 != 0, F.col("n_chars")).otherwise(0).alias("response_time_ms"),
    )


JUDGED_SQL = f"""SELECT doc_id AS row_index, text AS input_text, lang AS thinking_content,
  CASE doc_id % 11 WHEN 0 THEN 'nan' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN ' 1 ' WHEN 4 THEN '2' WHEN 5 THEN 'N/A' WHEN 6 THEN 'other'
    ELSE CAST(toxic AS VARCHAR) END AS final_answer,
  CAST(quality AS VARCHAR) AS ground_truth, doc_id % 13 <> 0 AS success,
  CASE WHEN doc_id % 17 <> 0 THEN n_chars ELSE 0 END AS response_time_ms
 FROM ({LABELLED_SQL})"""


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a label made of both judgements; null where there is none."""
    tag = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    return labelled(spark, d).select("doc_id", "text", tag.alias("label"))


TRAINING_SQL = f"SELECT doc_id, text, 'q' || CAST(quality AS VARCHAR) || 't' || CAST(toxic AS VARCHAR) AS label FROM ({LABELLED_SQL})"
