"""Voting over repeated attempts of one row.

An attempts table has row_index, attempt_no, response, answer, success, error and
response_time_ms. A row has at most ten attempts, so the per-row groups are small by
contract; the number of rows is what grows. Attempts that arrive as rows are shuffled
once by row and both aggregation levels use that partitioning. Attempts made by one run
sit in an array of their row and are voted on without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelmill.functions import parsing
from labelmill.functions.text import bind, normalize_label


def _by_answer(attempts: DataFrame, key: str, extra: list[Column]) -> DataFrame:
    return (
        attempts.repartition(key)
        .groupBy(key, "success", "answer")
        .agg(F.count("*").alias("_n"), F.min("attempt_no").alias("_first"), *extra)
    )


def _vote() -> list[Column]:
    """Winner = most votes; a tie goes to the answer given first."""
    ok = F.col("success")
    rank = F.when(ok, F.struct(F.col("_n"), -F.col("_first")))
    pairs = F.collect_list(F.when(ok, F.struct(F.col("answer"), F.col("_n"))))
    return [
        F.max_by("answer", rank).alias("final_answer"),
        F.max(F.when(ok, F.col("_n"))).alias("count"),
        F.coalesce(F.sum(F.when(ok, F.col("_n"))), F.lit(0)).alias("total"),
        F.map_from_entries(F.sort_array(pairs)).alias("distribution"),
    ]


def consensus(attempts: DataFrame, key: str = "row_index") -> DataFrame:
    """Vote per row over successful attempts; rows without any are left out."""
    out = _by_answer(attempts.filter("success"), key, []).groupBy(key).agg(*_vote())
    return out.withColumn("ratio", F.col("count") / F.col("total"))


def consensus_result(
    attempts: DataFrame, rules: parsing.ParsingRules | None = None, key: str = "row_index", minimal: bool = False
) -> DataFrame:
    """One result per row: reply and reasoning of attempt one, answer by vote.

    ``minimal`` takes the first reply as the answer, even of a failed attempt.
    """
    head = F.min(F.struct("attempt_no", "response", "success")).alias("_head")
    time = F.sum("response_time_ms").alias("_ms")
    out = (
        _by_answer(attempts, key, [head, time])
        .groupBy(key)
        .agg(
            *_vote(),
            F.min("_head").alias("_head"),
            F.sum("_ms").alias("response_time_ms"),
            F.sum("_n").alias("_attempts"),
        )
    )
    out = out.withColumn("success", F.col("total") > 0)
    first = F.col("_head.response")
    out = out.withColumn("raw_response", F.when(F.col("success"), first).otherwise(""))
    if minimal:
        out = (
            out.withColumn("final_answer", F.when(F.col("success"), F.coalesce(first, F.lit(""))).otherwise(""))
            .withColumn("count", F.when(F.col("success"), F.lit(1).cast("long")))
            .withColumn("total", F.when(F.col("success"), F.col("_attempts")))
            .withColumn("ratio", F.when(F.col("success"), F.lit(1.0)))
            .withColumn("distribution", F.when(F.col("success"), F.create_map(F.coalesce(first, F.lit("")), F.lit(1).cast("long"))))
            .withColumn("thinking_content", F.lit(""))
        )
    else:
        tags = rules.thinking_tags if rules else ""
        think = F.when(F.col("success") & F.col("_head.success"), parsing.extract_thinking(first, tags)).otherwise("")
        out = (
            out.withColumn("final_answer", F.coalesce("final_answer", F.lit("")))
            .withColumn("ratio", F.when(F.col("success"), F.col("count") / F.col("total")))
            .withColumn("thinking_content", think)
        )
    out = out.withColumn("error", F.when(F.col("success"), "").otherwise("all attempts failed"))
    vote = F.struct(F.col("final_answer"), F.col("count"), F.col("total"), F.col("ratio"), F.col("distribution"))
    return out.withColumn("consensus", F.when(F.col("success"), vote)).select(
        key, "final_answer", "raw_response", "thinking_content", "success", "error", "response_time_ms", "consensus"
    )


def tally(answers: Column) -> Column:
    """Vote on an array of at most ten answers given in attempt order."""
    def count(kinds: Column) -> Column:
        one = lambda a, i: F.struct(F.size(F.filter(answers, lambda x: x == a)).cast("long").alias("n"), (-i).alias("order"), a.alias("answer"))
        return F.transform(kinds, one)

    def decide(counts: Column) -> Column:
        best, total = F.array_max(counts), F.size(answers).cast("long")
        pairs = F.sort_array(F.transform(counts, lambda c: F.struct(c["answer"].alias("answer"), c["n"].alias("n"))))
        return F.struct(
            best["answer"].alias("final_answer"), best["n"].alias("count"), total.alias("total"), (best["n"] / total).alias("ratio"),
            F.map_from_entries(pairs).alias("distribution"),
        )

    return F.when(F.size(answers) > 0, bind(bind(F.array_distinct(answers), count), decide))


def vote_in_place(df: DataFrame, rules: parsing.ParsingRules, minimal: bool = False) -> DataFrame:
    """The same results as ``consensus_result``, from a row's own ``attempts`` array.

    Rows stay where they are: no shuffle, whatever the size of their other columns.
    """
    patterns = parsing.usable_patterns(rules)
    answer = lambda a: F.when(~a["success"], "").otherwise(
        F.coalesce(a["response"], F.lit("")) if minimal else normalize_label(parsing.parse_answer(a["response"], rules, patterns))
    )
    names = ["attempt_no", "response", "response_time_ms", "success", "error"]
    parsed = F.transform("attempts", lambda a: F.struct(*[a[n].alias(n) for n in names], answer(a).alias("answer")))
    out = df.withColumn("attempts", parsed).withColumn("_good", F.filter("attempts", lambda a: a["success"]))
    out = out.withColumn("success", F.size("_good") > 0).withColumn("_first", F.element_at("attempts", 1))
    first = F.coalesce(F.col("_first.response"), F.lit(""))
    if minimal:
        vote = F.struct(
            first.alias("final_answer"), F.lit(1).cast("long").alias("count"), F.size("attempts").cast("long").alias("total"),
            F.lit(1.0).alias("ratio"), F.create_map(first, F.lit(1).cast("long")).alias("distribution"),
        )
        think = F.lit("")
    else:
        vote = tally(F.transform("_good", lambda a: a["answer"]))
        think = F.when(F.col("_first.success"), parsing.extract_thinking(first, rules.thinking_tags)).otherwise("")
    ok = F.col("success")
    out = out.withColumn("consensus", F.when(ok, vote))
    spent = F.aggregate("attempts", F.lit(0).cast("long"), lambda acc, a: acc + a["response_time_ms"])
    return out.withColumns({
        "final_answer": F.coalesce("consensus.final_answer", F.lit("")),
        "raw_response": F.when(ok, first).otherwise(""),
        "thinking_content": F.when(ok, think).otherwise(""),
        "error": F.when(ok, "").otherwise("all attempts failed"),
        "response_time_ms": spent,
    }).drop("_good", "_first")


def parse_attempts(attempts: DataFrame, rules: parsing.ParsingRules) -> DataFrame:
    out = parsing.parse_responses(attempts, rules, "response", "answer", "_thinking").drop("_thinking")
    return out.withColumn("answer", F.when(F.col("success"), normalize_label(F.col("answer"))).otherwise(""))


def consensus_variety(results: DataFrame) -> DataFrame:
    """How many rows got 1, 2, ... distinct answers."""
    return (
        results.filter(F.col("consensus").isNotNull())
        .groupBy(F.size("consensus.distribution").cast("long").alias("distinct_answers"))
        .agg(F.count("*").alias("items"))
    )


def consensus_summary(results: DataFrame, repeat: int) -> DataFrame:
    """Run summary; empty unless rows were asked more than once."""
    ratio = F.col("consensus.ratio")
    out = results.filter(F.col("consensus").isNotNull() & F.lit(repeat > 1)).agg(
        F.lit(repeat).cast("long").alias("repeat_count"),
        F.count("*").alias("items_with_consensus"),
        F.avg(ratio).alias("avg_consensus_ratio"),
    )
    return out.filter("items_with_consensus > 0")


def consensus_stats(results: DataFrame, key: str = "row_index") -> DataFrame:
    """Report statistics; the repeat count is the vote total of the first row."""
    ratio = F.col("consensus.ratio")
    out = results.filter(F.col("consensus").isNotNull()).agg(
        F.min_by("consensus.total", key).alias("repeat_count"),
        F.count("*").alias("items_with_consensus"),
        F.avg(ratio).alias("avg_consensus_ratio"),
        F.min(ratio).alias("min_consensus_ratio"),
        F.max(ratio).alias("max_consensus_ratio"),
    )
    return out.filter("items_with_consensus > 0")
