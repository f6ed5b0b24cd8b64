"""Shapes of physical plans that matter at scale."""

import re

from pyspark.sql import functions as F

from labelmill.config import Job, Provider
from labelmill.functions.parsing import ParsingRules
from labelmill.operators import conversations, metrics, run_stats
from labelmill.operators.infer import HashResponder
from labelmill.plans import views as V
from labelmill.plans.labelling import answer, prepare_requests
from labelmill.session import spread

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_a_run_is_one_narrow_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row_index", F.col("doc_id"))
    for repeat in (1, 3):
        job = Job(provider=Provider("vllm", "http://m"), user="{text}", parsing=ParsingRules(find=["1"]), repeat=repeat, workers=8)
        p = plan(answer(prepare_requests(docs, job), job, HashResponder()))
        assert "Exchange" not in p and p.count("ArrowEvalPython") == 1, repeat


def test_scans_read_only_needed_columns(spark):
    p = plan(run_stats.overview(V.results(spark, SF)))
    assert re.search(r"ReadSchema: struct<event_type:string,value:double>", p)
    p = plan(metrics.live_metric(V.results(spark, SF), "accuracy", V.CLASSES))
    assert "props" not in p and "value" not in p.split("ReadSchema")[1].split(">")[0]
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))" in p


def test_metrics_shuffle_rows_once(spark):
    p = final_plan(metrics.report_summary(V.results(spark, SF)))
    keyed = re.findall(r"Exchange hashpartitioning\((actual|ground_truth)[^)]*\)", p)
    assert p.count("FileScan") <= 1 and len(keyed) <= 2
    assert "ReusedExchange" in p


def test_percentiles_read_rows_once(spark):
    p = final_plan(run_stats.time_stats(V.results(spark, SF)))
    assert "events.parquet" not in p  # only the written counts are read


def test_truncation_limits_rows_before_the_shuffle(spark):
    p = plan(conversations.truncate_conversations(spark.read.parquet(f"{SF}/conversations.parquet"), 400))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_spread_only_touches_small_inputs(spark):
    few = spark.range(0, 100, 1, 1)
    many = spark.range(0, 100, 1, 64)
    assert spread(few).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread(many) is many
