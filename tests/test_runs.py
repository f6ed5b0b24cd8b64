"""Model calls, voting, resume and whole runs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelmill.config import Job, LiveMetrics, Provider
from labelmill.functions.parsing import ParsingRules
from labelmill.operators import consensus, infer, resume
from labelmill.operators.infer import HashResponder, HttpResponder, Pace
from labelmill.plans.labelling import label_table, prepare_requests

ATT = "row_index bigint, attempt_no int, response string, answer string, success boolean, response_time_ms bigint"


def votes(spark, data):
    return spark.createDataFrame([(r, n, f"<t>why {a}</t>{a}", a if ok else "", ok, 10) for r, n, a, ok in data], ATT)


def test_vote_tie_goes_to_the_first(spark):
    df = votes(spark, [(1, 1, "b", True), (1, 2, "a", True), (1, 3, "a", True), (1, 4, "b", True)])
    r = consensus.consensus(df).first()
    assert (r.final_answer, r["count"], r.total, r.ratio, r.distribution) == ("b", 2, 4, 0.5, {"a": 2, "b": 2})


def test_vote_ignores_failures(spark):
    df = votes(spark, [(1, 1, "x", False), (1, 2, "a", True), (2, 1, "x", False), (2, 2, "x", False)])
    got = {r.row_index: r for r in consensus.consensus_result(df, ParsingRules(thinking_tags="<t></t>")).collect()}
    assert got[1].final_answer == "a" and got[1].raw_response == "<t>why x</t>x" and got[1].thinking_content == ""
    assert got[1].response_time_ms == 20 and got[1].consensus.ratio == 1.0
    assert not got[2].success and got[2].error == "all attempts failed" and got[2].consensus is None
    stats = consensus.consensus_stats(consensus.consensus_result(df)).first()
    assert (stats.items_with_consensus, stats.repeat_count) == (1, 1)


def test_minimal_mode_takes_the_first_reply_even_if_failed(spark):
    df = votes(spark, [(1, 1, "x", False), (1, 2, "a", True)])
    r = consensus.consensus_result(df, minimal=True).first()
    assert r.final_answer == "<t>why x</t>x" and (r.consensus["count"], r.consensus.total, r.consensus.ratio) == (1, 2, 1.0)


def test_vote_does_not_depend_on_partitions(spark):
    data = [(i, n, "abc"[(i * n) % 3], (i + n) % 4 > 0) for i in range(40) for n in range(1, 6)]
    one = consensus.consensus(votes(spark, data).coalesce(1)).orderBy("row_index").collect()
    many = consensus.consensus(votes(spark, data).repartition(8)).orderBy("row_index").collect()
    assert one == many


def job(**k):
    return Job(
        provider=Provider("vllm", "http://model"), system="s", user="Judge {text} of {kind}",
        parsing=ParsingRules(thinking_tags="<think></think>", answer_patterns=[r"answer:\s*(\w+)"], default="none"),
        live_metrics=LiveMetrics(True, "accuracy", "truth"), workers=2, **k,
    )


def table(spark, n=60):
    return spark.range(n).select(
        F.col("id").alias("row_index"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("k").alias("kind"),
        F.concat(F.lit(" "), (F.col("id") % 2).cast("string")).alias("truth"),
    )


def test_replies_depend_on_the_prompt(spark):
    rows, other = table(spark), job()
    other.user = "Weigh {text} of {kind}"
    one, two = ([tuple(r) for r in label_table(rows, j, HashResponder()).select("row_index", "final_answer").orderBy("row_index").collect()] for j in (job(), other))
    assert one != two


def test_run_and_resume_in_two_halves(spark):
    rows = table(spark)
    cols = ["row_index", "final_answer", "success", "error", "ground_truth", "thinking_content", "response_time_ms"]
    whole = label_table(rows, job(), HashResponder())
    half = label_table(rows.filter("row_index < 30"), job(), HashResponder())
    rest = label_table(rows, job(), HashResponder(), done=half)
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, rest.select(cols).collect()))
    assert whole.count() == 60 and {r.ground_truth for r in whole.collect()} == {"0", "1"}
    state = resume.resume_state(rows, half).first()
    assert (state.completed, state.total, state.remaining, state.state) == (30, 60, 30, "partial")
    assert resume.resume_state(rows, whole).first().state == "complete"
    failed = whole.filter("not success").first()
    assert failed.error == "connection refused" and failed.final_answer == ""


def test_repeated_run(spark):
    out = label_table(table(spark, 20), job(repeat=3), HashResponder())
    assert out.count() == 20
    r = out.filter("success").first()
    assert r.consensus.total <= 3 and r.final_answer in ("0", "1") and r.input_text.startswith("text")
    minimal = label_table(table(spark, 5), job(repeat=2, minimal_mode=True), HashResponder(fail_one_in=0)).first()
    assert minimal.final_answer.startswith("<think>")


def test_repeat_bounds(spark):
    with pytest.raises(ValueError):
        infer.with_attempts(table(spark), 11)


def test_bad_replies_do_not_stop_the_run(spark):
    class Broken(HashResponder):  # local, so that workers get it by value
        def respond(self, key, request):
            kind = int(key) % 4
            return [("not json", None, 1), ('{"choices": []}', None, 2), ('{"error": {"message": "busy"}}', None, 3), (None, "timeout", 4)][kind]

    rows = prepare_requests(table(spark, 4), job())
    got = {r.row_index: (r.success, r.error, r.response_time_ms) for r in infer.infer(rows, Broken()).collect()}
    assert got == {0: (False, "failed to decode response", 1), 1: (False, "no response choices returned", 2), 2: (False, "busy", 3), 3: (False, "timeout", 4)}


def test_http_responder_reports_unreachable_server():
    body, error, ms = HttpResponder("http://127.0.0.1:9/none", timeout_s=2).respond("1", "{}")
    assert body is None and error.startswith("request failed") and ms >= 0


def test_workers_are_calls_in_flight_in_one_task(spark):
    class Counting(HashResponder):  # local, so that workers get it by value
        def open(self):
            import threading

            self.lock, self.now, self.most = threading.Lock(), 0, 0

        def respond(self, key, request):
            import time

            with self.lock:
                self.now += 1
                self.most = max(self.most, self.now)
            time.sleep(0.05)
            with self.lock:
                self.now -= 1
            return f'{{"choices": [{{"message": {{"content": "{self.most}"}}}}]}}', None, 1

    rows = prepare_requests(table(spark, 12).coalesce(1), job())
    out = infer.infer(rows, Counting(), workers=4)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert max(int(r.raw_response) for r in out.collect()) == 4


def test_pace_spaces_starts():
    now, slept = [0.0], []
    pace = Pace(per_second=10, partitions=2)
    for _ in range(3):
        pace.wait(clock=lambda: now[0], sleep=lambda s: (slept.append(round(s, 6)), now.__setitem__(0, now[0] + s)))
    assert slept == [0.2, 0.2]


def test_only_key_and_request_cross_into_python(spark):
    rows = prepare_requests(table(spark), job())
    plan = infer.infer(rows, HashResponder())._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("ArrowEvalPython") == 1


def test_streamed_vote_counts_an_attempt_once():
    from types import SimpleNamespace

    import pandas as pd

    from labelmill.streaming.streams import vote_when_complete

    held = []
    state = SimpleNamespace(exists=False, update=held.append)
    batch = pd.DataFrame({"row_index": [7, 7, 7], "attempt_no": [1, 1, 2], "answer": ["a", "a", "b"], "success": True})
    assert list(vote_when_complete(3)((0,), iter([batch]), state)) == []
    assert held == [([7, 7], [1, 2], ["a", "b"], [True, True])]


def logging_responder(folder, raises="never"):
    """Leaves a file per call, and raises on one key. Made here so that workers get it by value."""

    class Logging(HashResponder):
        def respond(self, key, request):
            import uuid

            with open(f"{folder}/{key}-{uuid.uuid4().hex}", "w"):
                pass
            if key == raises:
                raise RuntimeError("reply cut short")
            return super().respond(key, request)

    return Logging(fail_one_in=0)


def test_whatever_a_responder_raises_is_a_failed_row(spark, tmp_path):
    for repeat in (1, 3):
        key = "7" if repeat == 1 else "7:2"
        got = {r.row_index: r for r in label_table(table(spark, 20), job(repeat=repeat), logging_responder(str(tmp_path), key)).collect()}
        assert len(got) == 20
        if repeat == 1:
            assert (got[7].success, got[7].error) == (False, "request failed: reply cut short") and got[8].success
        else:
            assert got[7].consensus.total == 2


def test_killed_run_resumes_from_what_was_committed(spark, tmp_path):
    from labelmill.plans.labelling import label_to, results_at

    calls, path = tmp_path / "calls", str(tmp_path / "out")
    calls.mkdir()
    asked = lambda: sorted(int(p.name.split("-")[0]) for p in calls.iterdir())
    rows = table(spark, 80).repartitionByRange(16, "row_index")
    # the job dies in the task of row 79, after its retries, behind the calls of other tasks
    dying = rows.withColumn("kind", F.when(F.col("row_index") == 79, F.raise_error(F.lit("driver lost")).cast("string")).otherwise(F.col("kind")))
    with pytest.raises(Exception, match="driver lost"):
        label_to(dying, job(), logging_responder(str(calls)), path)
    kept = {r.row_index for r in results_at(spark, path).collect()}
    assert 0 < len(kept) < 80
    before = asked()
    out = label_to(rows, job(), logging_responder(str(calls)), path)
    assert sorted(r.row_index for r in out.collect()) == list(range(80))
    again = asked()
    for i in before:
        again.remove(i)
    assert not set(again) & kept and set(again) == set(range(80)) - kept
    assert spark.read.json(f"{path}/_manifest").count() == 1
    assert label_to(rows, job(), logging_responder(str(calls)), path, rows_per_commit=10).count() == 80 and len(asked()) == len(before) + len(again)


def test_busy_server_is_asked_again(monkeypatch):
    import email.message
    import io
    import urllib.error

    from labelmill.operators import infer

    waits, replies = [], [429, 503, None]

    def post(request, timeout):
        code = replies.pop(0)
        if code:
            head = email.message.Message()
            if code == 429:
                head["Retry-After"] = "2"
            raise urllib.error.HTTPError("u", code, "busy", head, io.BytesIO(b"busy"))
        return io.BytesIO(b"{}")

    monkeypatch.setattr(infer.urllib.request, "urlopen", post)
    monkeypatch.setattr(infer.time, "sleep", waits.append)
    assert infer.HttpResponder("http://model").respond("1", "{}")[:2] == ("{}", None) and waits == [2.0, 2.0]
    monkeypatch.setattr(infer.urllib.request, "urlopen", lambda *a, **k: (_ for _ in ()).throw(infer.http.client.IncompleteRead(b"")))
    assert infer.HttpResponder("http://model").respond("1", "{}")[1].startswith("request failed")


@pytest.mark.parametrize("partitions", [2, 30])
def test_rate_is_shared_by_the_tasks_that_run(spark, tmp_path, partitions):
    """Starts per second over the whole run, whatever the number of partitions."""
    import time

    from labelmill.operators.infer import infer as ask

    rows = prepare_requests(table(spark, 60).repartition(partitions), job())
    ask(rows.limit(1), HashResponder()).collect()
    start = time.time()
    ask(rows, logging_responder(str(tmp_path)), per_second=20.0).collect()
    stamps = sorted(p.stat().st_mtime for p in tmp_path.iterdir())
    rate = (len(stamps) - 1) / (stamps[-1] - stamps[0])
    assert 8 < rate < 30 and time.time() > start


def test_streamed_votes_by_timer(spark, tmp_path):
    """Late, repeated and missing attempts: each row votes once, in the stream."""
    from labelmill.streaming import streams

    schema = "row_index bigint, attempt_no int, answer string, success boolean, at timestamp"
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [
        [(1, 1, "a", True, 1), (1, 2, "b", True, 2), (1, 2, "b", True, 2), (2, 1, "x", True, 1), (3, 1, "q", False, 1), (4, 1, "m", True, 1)],
        [(1, 3, "b", True, 30), (4, 2, "n", True, 50)],
        [(9, 1, "z", True, 130)],  # event time passes the timers of 2 and 4
        [(2, 2, "y", True, 131), (2, 3, "y", True, 131), (9, 2, "z", True, 132)],  # too late for 2
        [(None, 0, "", False, 1200)],
    ]
    got, path = [], str(tmp_path / "in")
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(*r[:4], t(r[4])) for r in rows], "row_index bigint, attempt_no int, answer string, success boolean, at string").withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(path)
        votes = streams.stream_consensus(streams.read_stream(spark, path, df.schema), 3, time="at", wait="60 seconds")
        streams.write_once(votes, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got.append(sorted(tuple(r) for r in spark.read.schema(streams.VOTE_SCHEMA).parquet(str(tmp_path / "out")).collect()))
    assert got[1] == [(1, "b", 2, 3, 2 / 3)]
    assert got[3] == [(1, "b", 2, 3, 2 / 3), (2, "x", 1, 1, 1.0), (4, "m", 1, 2, 0.5)]
    assert got[4] == got[3] + [(9, "z", 2, 2, 1.0)]


def test_timed_votes_of_many_rows_share_a_call(spark, tmp_path):
    """Null and very large keys, null answers, tied votes; a call handles a bucket of rows."""
    from labelmill.streaming import streams

    big = 2**60
    rows = [(None, 1, "n", True), (big, 1, "a", True), (big + 1, 1, "b", True), (big + 1, 2, None, True), (big + 2, 1, None, True), (-1, 1, "m", True), (-1, 2, "m", True), (5, 1, "f", False)]
    rows += [(i, k, f"{i * k % 3}", True) for i in range(100, 400) for k in (2, 1)]
    schema, path = "row_index bigint, attempt_no int, answer string, success boolean", str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.lit(100)))
    df.unionByName(spark.createDataFrame([(7, 1, "", False)], schema).withColumn("at", F.timestamp_seconds(F.lit(5000)))).write.parquet(path)
    votes = streams.stream_consensus(streams.read_stream(spark, path, df.schema), 2, time="at", wait="60 seconds", buckets=3)
    streams.write_once(votes, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.row_index: (r.final_answer, r["count"], r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {None: ("n", 1, 1), big: ("a", 1, 1), big + 1: ("b", 1, 2), big + 2: (None, 1, 1), -1: ("m", 2, 2)}
    for i in range(100, 400):
        one, two = f"{i % 3}", f"{i * 2 % 3}"
        want[i] = (one, 2 if one == two else 1, 2)
    assert got == want

    calls = []
    state = type("S", (), {"exists": False, "hasTimedOut": False, "getCurrentWatermarkMs": lambda s: 0, "update": lambda s, x: calls.append(x), "setTimeoutTimestamp": lambda s, t: calls.append(t)})()
    pdf = pd.DataFrame({"row_index": range(1000), "no_key": False, "attempt_no": 1, "answer": "a", "success": True, "ms": range(1000)})
    assert list(streams.vote_or_expire(2, 50)((0,), iter([pdf]), state)) == [] and len(calls[0][0]) == 1000 and calls[1] == 50


def test_python_steps_get_bounded_batches(spark):
    """Ten thousand texts at once are more than a worker should hold: neither model calls nor cleaning get them."""
    from labelmill.functions import cleaning

    rows = spark.createDataFrame([(i, '{"prompt": "é & x"}') for i in range(3)], "row_index long, request string")
    steps = [lambda: infer.infer(rows, HashResponder()), lambda: infer.infer_attempts(rows, HashResponder(), 2), lambda: cleaning.clean_text(rows, "request"), lambda: rows.select(cleaning.stem_text(F.col("request")))]
    for step in steps:
        for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
            spark.conf.unset(f"spark.sql.execution.arrow.{name}")
        assert step().count() == 3
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_template_column_with_a_dot(spark):
    from labelmill.functions.templates import render_prompt

    df = spark.sql("SELECT 'x' AS `a.b`, named_struct('c.d', 'y') AS s")
    assert df.select(render_prompt(df.schema, "{a.b} {c.d}").alias("p")).first().p == "x y"
