"""The whole run: table -> prompts -> replies -> answers -> statistics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelmill.config import Job, run_manifest
from labelmill.functions import requests, templates
from labelmill.operators import consensus, infer, resume
from labelmill.operators.infer import Responder
from labelmill.session import materialize


def prepare_requests(rows: DataFrame, job: Job, text: str = "text") -> DataFrame:
    """Add input_text, ground_truth, prompt and request to a table with row_index."""
    prompt = templates.render_prompt(rows.schema, job.user, text, "row_index", job.placeholder_map)
    out = rows.withColumn("prompt", prompt)
    fallback = text if text in rows.columns else rows.columns[0]
    out = out.withColumn("input_text", templates.input_text(rows.schema, job.user, job.input_text_field, job.output_text_field, fallback))
    out = out.withColumn("ground_truth", templates.ground_truth(rows.schema, job.truth_column))
    messages = requests.build_messages(job.system, F.col("prompt"))
    body = requests.build_request(job.provider.name, messages, job.parameters, job.model, flashinfer_safe=job.flashinfer_safe)
    return out.withColumn("request", body)


def _completion(job: Job) -> bool:
    return job.provider.name == "llamacpp" and job.parameters.get("chat_format") is None


def answer(ready: DataFrame, job: Job, responder: Responder) -> DataFrame:
    """Ask for every prepared row, parse the replies and vote: one narrow stage, for
    tables and for streams."""
    calls = dict(
        provider=job.provider.name, completion=_completion(job), workers=job.workers,
        per_second=100.0 if job.rate_limit else None,
    )
    if job.repeat == 1:
        out = infer.parse_results(infer.infer(ready, responder, **calls), job.parsing, job.minimal_mode)
    else:
        asked = infer.infer_attempts(ready, responder, job.repeat, gap_s=1.0 if job.rate_limit else 0.0, **calls)
        out = consensus.vote_in_place(asked, job.parsing, job.minimal_mode)
    return out.drop("prompt", "request", "finish_reason")


def label_table(rows: DataFrame, job: Job, responder: Responder, text: str = "text", done: DataFrame | None = None) -> DataFrame:
    """Results for every row, written once before they are returned.

    ``done`` are results of an earlier, interrupted run, which are kept and not asked
    for again.
    """
    todo = resume.remaining(rows, done) if done is not None else rows
    out = materialize(answer(prepare_requests(todo, job, text), job, responder), "results")
    return resume.merge_results(done, out) if done is not None else out


def results_at(spark: SparkSession, path: str) -> DataFrame | None:
    """What runs have committed below ``path``, one row per row_index; None before the first.

    A task that was lost while it committed may have been run again, so that its rows are
    there twice.
    """
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return found.dropDuplicates(["row_index"])


def label_to(rows: DataFrame, job: Job, responder: Responder, path: str, text: str = "text", rows_per_commit: int | None = None, retry_failed: bool = False) -> DataFrame:
    """Results for every row below ``path``, durable while the run goes on.

    Every task moves its file to ``path`` when it ends, not when the job does, so what has
    been paid for survives a failed job and a lost driver. Running it again asks only for rows
    without a committed result (and failed ones with ``retry_failed``, whose new results
    replace the old), and appends. ``rows_per_commit`` deals the rows into tasks of that size;
    otherwise they keep their partitions. Settings of the run, without the key, are written to
    ``_manifest`` below the path.
    """
    spark = rows.sparkSession
    done = results_at(spark, path)
    todo = rows if done is None else resume.remaining(rows, done, retry_failed=retry_failed)
    if rows_per_commit:
        tasks = max(1, -(-todo.count() // rows_per_commit))
        todo = todo.repartition(tasks, "row_index")
    if retry_failed and done is not None:
        kept = materialize(done.filter("success"), "kept-results")
        answered = materialize(answer(prepare_requests(todo, job, text), job, responder), "results")
        resume.merge_results(kept, answered).write.mode("overwrite").parquet(path)
    else:
        ready = answer(prepare_requests(todo, job, text), job, responder)
        ready.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    run_manifest(spark, job, path=path).write.mode("append").json(f"{path}/_manifest")
    return results_at(spark, path)


def label_stream(rows: DataFrame, job: Job, responder: Responder, text: str = "text") -> DataFrame:
    """The same for a stream of rows; write it with ``streaming.stream_results``, whose
    checkpoint also resumes an interrupted run."""
    return answer(prepare_requests(rows, job, text), job, responder)


def preview(rows: DataFrame, job: Job, n: int = 3, text: str = "text") -> DataFrame:
    """Prompts of the first rows, to check a template before paying for calls."""
    return prepare_requests(rows.filter(F.col("row_index") < n), job, text).select("row_index", "input_text", "prompt")
