import pytest
from conftest import rows

from labelmill.functions.parsing import ParsingRules, parse_responses, skipped_patterns, split_tags, usable_patterns

POLAR = ["positive", "negative", "neutral"]
CASES = [
    # name, rules, reply, answer, thinking
    ("any case gives configured spelling", dict(find=POLAR), "It is POSITIVE, I think", "positive", ""),
    ("case-sensitive miss", dict(find=POLAR, case_sensitive=True, default="?"), "POSITIVE", "?", ""),
    ("exact hit", dict(find=POLAR, exact_match=True), "  Negative\n", "negative", ""),
    ("exact miss", dict(find=POLAR, exact_match=True, default="?"), "very negative", "?", ""),
    ("capture group", dict(answer_patterns=[r"answer:\s*(\w+)"]), "The Answer: 42 it is", "42", ""),
    ("list order beats text order", dict(answer_patterns=[r"second:\s*(\w+)", r"first:\s*(\w+)"]), "first: a second: b", "b", ""),
    ("pattern miss falls to find", dict(answer_patterns=[r"zzz (\w+)"], find=POLAR), "neutral tone", "neutral", ""),
    ("empty group ends the patterns, find takes over", dict(answer_patterns=[r"a:(\s*)", r"(\d)"], find=["b"]), "a: b 7", "b", ""),
    ("map after find", dict(find=POLAR, map={"positive": "1"}), "positive", "1", ""),
    ("map after pattern", dict(answer_patterns=[r"is (\w+)"], map={"good": "1"}), "it is good", "1", ""),
    ("default is not mapped", dict(find=["x"], default="d", map={"d": "no"}), "nothing", "d", ""),
    ("wildcard", dict(find=["*"], default="d"), "  any thing ", "any thing", ""),
    ("wildcard on empty", dict(find=["*"], default="d"), "   ", "d", ""),
    ("empty reply", dict(find=POLAR, default="d"), "", "d", ""),
    ("dot-all pattern", dict(answer_patterns=[r"(?s)result:\s*(.*?)(?:\n\n|$)"]), "result: one\ntwo\n\nthree", "one\ntwo", ""),
    ("reasoning stripped", dict(find=POLAR, thinking_tags="<think></think>"), "<think> maybe negative </think> positive", "positive", "maybe negative"),
    ("reasoning kept", dict(find=["negative", "positive"], thinking_tags="<think></think>", preserve_thinking=True), "<think>negative</think> positive", "negative", "negative"),
    ("first of two blocks", dict(find=POLAR, thinking_tags="<t></t>"), "<t>a</t> x <t>b</t> neutral", "neutral", "a"),
    ("brackets", dict(find=POLAR, thinking_tags="[R][/R]"), "[R]why[/R] positive", "positive", "why"),
    ("unclosed", dict(find=POLAR, thinking_tags="<t></t>"), "<t>negative", "negative", ""),
    ("block over lines stays in the reply", dict(find=["negative", "positive"], thinking_tags="<t></t>"), "<t>\nnegative\n</t> positive", "negative", "negative"),
    ("block over lines stripped on request", dict(find=["negative", "positive"], thinking_tags="<t></t>", strip_across_lines=True), "<t>\nnegative\n</t> positive", "positive", "negative"),
    ("bad and group-less patterns are skipped", dict(answer_patterns=["(open", r"\d+", r"n=(\d)"]), "n=5", "5", ""),
    ("look-around is skipped by default", dict(answer_patterns=[r"(?<=n=)(\d)"], default="d"), "n=5", "d", ""),
    ("look-around on request", dict(answer_patterns=[r"(?<=n=)(\d)"], default="d", linear_time_patterns=False), "n=5", "5", ""),
    ("unicode keyword", dict(find=["ÉLEVÉ"]), "risque élevé", "ÉLEVÉ", ""),
    ("regex characters in keywords are literal", dict(find=["a.c", "(x)"]), "abc (x)", "(x)", ""),
    ("keyword list order", dict(find=["2", "1"]), "1 or 2", "2", ""),
    ("ascii word boundary", dict(answer_patterns=[r"\b(on)\b"], default="d"), "éon", "on", ""),
    ("named group", dict(answer_patterns=[r"x=(?P<v>\d+)"]), "x=12", "12", ""),
    ("a class with signs is not possessive", dict(answer_patterns=[r"n=([*+\d]+)"], default="d"), "n=5", "5", ""),
    ("an escaped plus is not possessive", dict(answer_patterns=[r"a\++(b)"], default="d"), "a++b", "b", ""),
    ("possessive and back references are skipped", dict(answer_patterns=[r"(\d++)", r"(\d)\1"], default="d"), "n=55", "d", ""),
    ("dollar in reply", dict(answer_patterns=[r"cost (\S+)"]), "cost $1.5", "$1.5", ""),
]


@pytest.mark.parametrize("name,rules,reply,answer,thinking", CASES, ids=[c[0] for c in CASES])
def test_case(spark, name, rules, reply, answer, thinking):
    df = spark.createDataFrame([(reply,)], "raw_response string")
    assert rows(parse_responses(df, ParsingRules(**rules)), "final_answer", "thinking_content") == [(answer, thinking)]


def test_null_reply(spark):
    df = spark.createDataFrame([(None,)], "raw_response string")
    assert rows(parse_responses(df, ParsingRules(default="d")), "final_answer") == [("d",)]
    assert rows(parse_responses(df, ParsingRules(default="d", fallback="f")), "final_answer") == [("f",)]


def test_split_tags():
    assert split_tags("<a></a>") == ("<a>", "</a>")
    assert split_tags("[A][/A]") == ("[A]", "[/A]")
    assert split_tags("<a> </a>") == ("<a>", "</a>")
    assert split_tags("<a>") == ("", "") == split_tags("")


def test_group_counting(spark):
    kept = usable_patterns(ParsingRules(answer_patterns=[r"\(a\)", "[(]b", "(?:c)", "(d)"]))
    assert len(kept) == 1


def test_classes_escapes_and_skipped_patterns(spark):
    rules = lambda *p: ParsingRules(answer_patterns=list(p))
    good = [r"([*+\d]+)", r"a\++(b)", "([[:digit:]]+)", "([]a]+)", "([^]]+)", "([[&]+)"]
    assert len(usable_patterns(rules(*good))) == len(good)
    df = spark.createDataFrame([("n: 42",)], "raw_response string")
    assert parse_responses(df, rules("([[:digit:]]+)")).first().final_answer == "42"
    assert parse_responses(df, rules("([[:^alpha:]]+)2")).first().final_answer == ": 4"
    why = skipped_patterns(rules("(?=a)(b)", "none", "(open", "(?U)(a+)", "(fine)", "(a++)"))
    assert set(why) == {"(?=a)(b)", "none", "(open", "(?U)(a+)", "(a++)"}
