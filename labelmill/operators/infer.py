"""Model calls as a pluggable, batched operator.

A responder lives in the Python worker: it is opened once per partition and answers
Arrow batches of requests. Only the key and the request body cross into Python; all
other columns stay in the JVM. Real responders are not deterministic, so the result
must be written once (``session.materialize``) before anything reads it twice.
"""

from __future__ import annotations

import collections
import hashlib
import http.client
import json
import threading
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Iterator, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from labelmill.functions import parsing, requests
from labelmill.functions.text import bind, normalize_label
from labelmill.session import bounded_batches

REPLY = "struct<body string, transport_error string, elapsed_ms bigint>"


class Responder(Protocol):
    def open(self) -> None: ...

    def respond(self, key: str, request: str) -> tuple[str | None, str | None, int]:
        """(reply body, transport error, elapsed ms) for one request."""

    def close(self) -> None: ...


@dataclass
class HashResponder:
    """Answers from a hash of the key and of the last message of the request.

    Another prompt gets another reply, and the same one gets the same reply everywhere.
    Of md5(key, line break, message) the first four hex digits choose the label, the next
    two decide on a failure, the next three give the response time.
    """

    labels: list[str] = field(default_factory=lambda: ["0", "1"])
    fail_one_in: int = 10

    def open(self) -> None:
        pass

    def close(self) -> None:
        pass

    def respond(self, key, request):
        body = json.loads(request)
        message = (body["messages"][-1].get("content") if "messages" in body else body.get("prompt")) or ""
        h = hashlib.md5(f"{key}\n{message}".encode()).hexdigest()
        elapsed = int(h[6:9], 16)
        if self.fail_one_in and int(h[4:6], 16) % self.fail_one_in == 0:
            return None, "connection refused", elapsed
        label = self.labels[int(h[:4], 16) % len(self.labels)]
        content = f"<think>case {h[:4]}</think> Answer: {label}"
        body = {
            "choices": [{"message": {"content": content}, "finish_reason": "stop"}],
            "usage": {"prompt_tokens": len(request), "completion_tokens": len(content), "total_tokens": len(request) + len(content)},
        }
        return json.dumps(body), None, elapsed


@dataclass
class HttpResponder:
    """One POST per request to a model server. A server that says it is busy (429 or 503) is
    asked again, up to ``retries`` times, after the pause it names or a doubling one."""

    url: str
    timeout_s: float = 60.0
    headers: dict[str, str] = field(default_factory=dict)
    retries: int = 3
    pause_s: float = 1.0

    def open(self) -> None:
        pass

    def close(self) -> None:
        pass

    def _post(self, request: str):
        """(reply body, transport error, seconds to wait before another try or None)"""
        post = urllib.request.Request(self.url, request.encode(), {"Content-Type": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(post, timeout=self.timeout_s) as r:
                return r.read().decode("utf-8", "replace"), None, None
        except urllib.error.HTTPError as e:
            wait = None
            if e.code in (429, 503):
                named = (e.headers.get("Retry-After") or "") if e.headers else ""
                wait = float(named) if named.strip().isdigit() else self.pause_s
            return e.read().decode("utf-8", "replace"), None, wait
        except (OSError, http.client.HTTPException) as e:
            return None, f"request failed: {e or type(e).__name__}", None

    def respond(self, key, request):
        start = time.monotonic()
        for attempt in range(self.retries + 1):
            body, error, wait = self._post(request)
            if wait is None or attempt == self.retries:
                break
            time.sleep(wait * 2**attempt)
        return body, error, int((time.monotonic() - start) * 1000)


@dataclass
class Pace:
    """Spaces request starts so that all partitions together keep to one rate."""

    per_second: float
    partitions: int
    _next: float = 0.0

    def wait(self, clock=time.monotonic, sleep=time.sleep) -> None:
        gap = self.partitions / self.per_second
        now = clock()
        if now < self._next:
            sleep(self._next - now)
            now = self._next
        self._next = now + gap


def _calls(workers: int | None, pace: Pace | None, respond):
    """(open a pool, call) where calls of one task overlap up to ``workers`` at a time.

    Request starts are paced one after the other, as the pool hands them out. Whatever a call
    raises becomes its row's error: no reply can end the job.
    """
    lock = threading.Lock()

    def one(*request):
        if pace:
            with lock:
                pace.wait()
        start = time.monotonic()
        try:
            return respond(*request)
        except Exception as e:  # noqa: BLE001  a responder may raise anything
            return None, f"request failed: {e or type(e).__name__}", int((time.monotonic() - start) * 1000)

    return ThreadPoolExecutor(max(1, workers or 1)), one


def _in_flight(pool: ThreadPoolExecutor, call, batches: Iterator[tuple]) -> Iterator[list]:
    """Replies batch by batch. Calls of the next batch start while slow ones of this batch
    are still out, so that one slow reply doesn't leave the other workers idle."""
    waiting: collections.deque = collections.deque()
    for columns in batches:
        waiting.append([pool.submit(call, *row) for row in zip(*columns)])
        if len(waiting) > 1:
            yield [f.result() for f in waiting.popleft()]
    while waiting:
        yield [f.result() for f in waiting.popleft()]


def responder_udf(responder: Responder, pace: Pace | None = None, workers: int | None = None):
    @F.pandas_udf(REPLY)
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        responder.open()
        pool, one = _calls(workers, pace, responder.respond)
        try:
            for rows in _in_flight(pool, one, batches):
                out = pd.DataFrame(rows, columns=["body", "transport_error", "elapsed_ms"])
                yield out.astype({"elapsed_ms": "int64"})
        finally:
            pool.shutdown()
            responder.close()

    return ask.asNondeterministic()


def infer(
    df: DataFrame,
    responder: Responder,
    request: str = "request",
    key: list[str] | None = None,
    provider: str = "vllm",
    completion: bool = False,
    workers: int | None = None,
    per_second: float | None = None,
) -> DataFrame:
    """One request per row; a failed call marks its row and the run goes on.

    The input's partitions are kept: no row is shuffled. ``workers`` sets how many calls
    each running task has in flight. Adds raw_response, success, error, response_time_ms,
    tool_calls, usage and finish_reason.
    """
    key = key or ["row_index"]
    pace = Pace(per_second, running_tasks(df)) if per_second else None
    ask = responder_udf(responder, pace, workers)
    keyed = F.concat_ws(":", *[F.col(k).cast("string") for k in key])
    out = bounded_batches(df).withColumn("_reply", ask(keyed, F.col(request)))
    out = out.withColumn("_body", F.col("_reply.body")).withColumn("_transport", F.col("_reply.transport_error"))
    out = out.withColumn("response_time_ms", F.col("_reply.elapsed_ms"))
    out = requests.decode_response(out, "_body", provider, completion)
    failed = F.col("_transport").isNotNull()
    return (
        out.withColumn("success", F.col("success") & ~failed)
        .withColumn("error", F.when(failed, F.col("_transport")).otherwise(F.col("error")))
        .withColumnRenamed("content", "raw_response")
        .drop("_reply", "_body", "_transport")
    )


def infer_attempts(
    df: DataFrame,
    responder: Responder,
    repeat: int,
    request: str = "request",
    key: str = "row_index",
    provider: str = "vllm",
    completion: bool = False,
    workers: int | None = None,
    per_second: float | None = None,
    gap_s: float = 0.0,
) -> DataFrame:
    """All attempts of a row, one after the other, as an array column ``attempts``.

    Voting on the array needs no shuffle; ``workers`` rows of a task are asked at once.
    ``gap_s`` is the pause between attempts.
    """
    check_repeat(repeat)
    pace = Pace(per_second, running_tasks(df)) if per_second else None

    @F.pandas_udf("struct<body array<string>, transport_error array<string>, elapsed_ms array<bigint>>")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        responder.open()
        pool, one = _calls(workers, pace, responder.respond)

        def attempts_of(row_key, body):
            replies = []
            for n in range(1, repeat + 1):
                if n > 1 and gap_s:
                    time.sleep(gap_s)
                replies.append(one(f"{row_key}:{n}", body))
            return tuple(map(list, zip(*replies)))

        try:
            for rows in _in_flight(pool, attempts_of, batches):
                yield pd.DataFrame(rows, columns=["body", "transport_error", "elapsed_ms"])
        finally:
            pool.shutdown()
            responder.close()

    out = bounded_batches(df).withColumn("_r", ask.asNondeterministic()(F.col(key).cast("string"), F.col(request)))

    def attempt(reply: Column, i: Column) -> Column:
        def row(d: Column) -> Column:
            failed = reply["transport_error"].isNotNull()
            return F.struct(
                (i + 1).cast("int").alias("attempt_no"), d["content"].alias("response"), (d["success"] & ~failed).alias("success"),
                F.when(failed, reply["transport_error"]).otherwise(d["error"]).alias("error"),
                reply["elapsed_ms"].alias("response_time_ms"), d["tool_calls"].alias("tool_calls"), d["usage"].alias("usage"),
            )

        return bind(requests.decode(reply["body"], provider, completion), row)

    replies = F.arrays_zip("_r.body", "_r.transport_error", "_r.elapsed_ms")
    return out.withColumn("attempts", F.transform(replies, attempt)).drop("_r")


def running_tasks(df: DataFrame) -> int:
    """How many tasks over the partitions of ``df`` can run at once: a rate is shared by these."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return slots if df.isStreaming else max(1, min(slots, df.rdd.getNumPartitions()))


def check_repeat(repeat: int) -> None:
    if not 1 <= repeat <= 10:
        raise ValueError("repeat count must be between 1 and 10")


def with_attempts(df: DataFrame, repeat: int) -> DataFrame:
    """One row per (row, attempt), attempts numbered from 1."""
    check_repeat(repeat)
    return df.withColumn("attempt_no", F.explode(F.sequence(F.lit(1), F.lit(repeat))))


def infer_repeat(df: DataFrame, responder: Responder, repeat: int, request: str = "request", key: str = "row_index", **kw) -> DataFrame:
    """The attempts table: every attempt of every row is kept, failed ones too."""
    out = infer(with_attempts(df, repeat), responder, request, [key, "attempt_no"], **kw)
    return out.withColumnRenamed("raw_response", "response")


def parse_results(df: DataFrame, rules: parsing.ParsingRules, minimal: bool = False) -> DataFrame:
    """Answers of single-request results; failed rows get no answer.

    In minimal mode the reply itself is the answer.
    """
    if minimal:
        ok = F.col("success")
        return df.withColumn("final_answer", F.when(ok, F.col("raw_response")).otherwise("")).withColumn("thinking_content", F.lit(""))
    out = parsing.parse_responses(df, rules)
    ok = F.col("success")
    return out.withColumn("final_answer", F.when(ok, normalize_label(F.col("final_answer"))).otherwise("")).withColumn(
        "thinking_content", F.when(ok, F.col("thinking_content")).otherwise("")
    )


def usage_summary(results: DataFrame) -> DataFrame:
    """Token totals over the rows that carry usage."""
    part = lambda n: F.coalesce(F.sum(F.col(f"usage.{n}")), F.lit(0)).alias(n)
    return results.agg(
        F.count("usage").alias("rows_with_usage"), part("prompt_tokens"), part("completion_tokens"), part("total_tokens")
    )

