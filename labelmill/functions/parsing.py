"""From a model reply to an answer, as column expressions.

Order: reasoning text from the raw reply, strip reasoning, trim, answer patterns,
keywords, label map, default. The rules are plan-time values, so the chain is one
projection of built-in functions and stays inside generated code.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelmill.functions.text import bind, trim_ws


@dataclass(frozen=True)
class ParsingRules:
    find: list[str] = field(default_factory=list)
    default: str = ""
    fallback: str | None = None
    map: dict[str, str] = field(default_factory=dict)
    thinking_tags: str = ""
    preserve_thinking: bool = False
    answer_patterns: list[str] = field(default_factory=list)
    case_sensitive: bool = False
    exact_match: bool = False
    # Linear-time regex engines reject lookaround and back references; a rule set made
    # for one of them expects such patterns to be skipped.
    linear_time_patterns: bool = True
    # By default a reasoning block that spans lines is not stripped from the reply.
    strip_across_lines: bool = False


def split_tags(tags: str) -> tuple[str, str]:
    """Start and end tag from ``<a></a>``, ``[A][/A]`` or two words; ('', '') if neither."""
    for joint in ("><", "]["):
        head, sep, tail = tags.partition(joint)
        if sep:
            return head + joint[0], joint[1] + tail
    parts = tags.split()
    return (parts[0], parts[1]) if len(parts) == 2 else ("", "")


def extract_thinking(reply: Column, tags: str) -> Column:
    """Trimmed text between the first start tag and the next end tag, '' if there is none."""
    start, end = split_tags(tags)
    if not start or not end:
        return F.lit("")
    at = F.instr(reply, start)
    body = F.substr(reply, at + F.lit(len(start)))
    stop = F.instr(body, end)
    return F.when((at > 0) & (stop > 0), trim_ws(F.substr(body, F.lit(1), stop - 1))).otherwise("")


def strip_thinking(reply: Column, tags: str, preserve: bool = False, across_lines: bool = False) -> Column:
    start, end = split_tags(tags)
    if preserve or not start or not end:
        return reply
    inner = r"[\s\S]" if across_lines else r"[^\n]"
    return F.regexp_replace(reply, f"{re.escape(start)}{inner}*?{re.escape(end)}", "")


_BACKTRACKING = re.compile(r"\(\?(?:[=!>]|<[=!])|[*+?}]\+")
_ASCII_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
#: Named classes inside brackets and their (ASCII) spelling in Java.
_POSIX_NAMES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}
_UNGREEDY = re.compile(r"\(\?[a-z]*U")


def _outside_classes(pattern: str):
    """Yield (piece, inside a character class) for each character, escape or named class."""
    inside, i, first = False, 0, 0
    while i < len(pattern):
        named = _POSIX.match(pattern, i) if inside else None
        piece = named.group() if named else pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(piece)
        if piece == "[" and not inside:
            first = i + pattern.startswith("^", i)  # a closing bracket here is a member
            inside = True
            yield piece, False
        elif piece == "]" and inside and i - 1 > first:
            inside = False
            yield piece, False
        else:
            yield piece, inside


def _class_member(piece: str) -> str:
    """A piece of a character class in Java, where classes nest and intersect."""
    named = _POSIX.fullmatch(piece)
    if named:
        flip, name = named.groups()
        word = {"": r"\w", "^": r"\W"}[flip]
        return word if name == "word" else rf"\{'P' if flip else 'p'}{{{_POSIX_NAMES.get(name, name)}}}"
    return "\\" + piece if piece in "[]&" else piece


def _java_pattern(pattern: str) -> str:
    """Named groups, word boundaries and class members in Java's spelling."""
    out = "".join(_class_member(p) if inside else _ASCII_BOUNDARY if p == r"\b" else p for p, inside in _outside_classes(pattern))
    return out.replace("(?P<", "(?<")


def _plain(pattern: str) -> str:
    """What lies outside classes, with escapes as dots."""
    return "".join(p if len(p) == 1 else "." for p, inside in _outside_classes(pattern) if not inside)


def _capture_groups(pattern: str) -> int:
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", _plain(pattern)))


def _backtracks(pattern: str) -> bool:
    """Lookaround, back references or possessive counts, outside classes and escapes."""
    back = any(re.fullmatch(r"\\[1-9]", p) for p, inside in _outside_classes(pattern) if not inside)
    return back or bool(_BACKTRACKING.search(_plain(pattern)))


@functools.lru_cache(maxsize=256)
def _compile(patterns: tuple[str, ...]) -> tuple[bool, ...]:
    """Whether Spark takes each pattern: one small job if it takes all of them."""
    try:
        SparkSession.active().range(1).select(*[F.rlike(F.lit(""), F.lit(p)) for p in patterns]).collect()
        return (True,) * len(patterns)
    except PySparkException:
        if len(patterns) == 1:
            return (False,)
        half = len(patterns) // 2
        return _compile(patterns[:half]) + _compile(patterns[half:])


def checked_patterns(rules: ParsingRules) -> list[tuple[str, str | None, str | None]]:
    """(pattern, its spelling for Spark or None, why it is skipped or None), in list order."""
    flags = "(?d)" if rules.case_sensitive else "(?iud)"
    out = []
    for pattern in rules.answer_patterns:
        why = None
        if rules.linear_time_patterns and _backtracks(pattern):
            why = "needs backtracking"
        elif _UNGREEDY.search(_plain(pattern)):
            why = "swaps greedy and lazy matching"
        elif _capture_groups(pattern) == 0:
            why = "has no group"
        out.append((pattern, None if why else flags + _java_pattern(pattern), why))
    ready = tuple(java for _, java, _ in out if java)
    fine = dict(zip(ready, _compile(ready))) if ready else {}
    return [(p, java, why) if not java or fine[java] else (p, None, "does not compile") for p, java, why in out]


def usable_patterns(rules: ParsingRules) -> list[str]:
    """The patterns that compile and have a group, ready for Spark, in list order."""
    return [java for _, java, _ in checked_patterns(rules) if java]


def skipped_patterns(rules: ParsingRules) -> dict[str, str]:
    """Patterns that take no part in parsing, with the reason."""
    return {p: why for p, _, why in checked_patterns(rules) if why}


def match_patterns(body: Column, patterns: list[str]) -> Column:
    """Trimmed group 1 of the first pattern that matches, even if empty; null if none does."""
    out = None
    for p in patterns:
        value = trim_ws(F.regexp_extract(body, p, 1))
        hit = F.rlike(body, F.lit(p))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast("string") if out is None else out


def find_keyword(body: Column, lowered: Column, rules: ParsingRules) -> Column:
    """First keyword, in list order, that the reply contains (or equals); null if none."""
    text = body if rules.case_sensitive else lowered
    out = None
    for keyword in rules.find:
        if keyword == "*":
            hit, value = F.length(body) > 0, body
        else:
            needle = F.lit(keyword if rules.case_sensitive else keyword.lower())
            hit = (text == needle) if rules.exact_match else F.contains(text, needle)
            value = F.lit(keyword)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast("string") if out is None else out


def map_answer(answer: Column, mapping: dict[str, str]) -> Column:
    if not mapping:
        return answer
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), answer), answer)


def parse_answer(reply: Column, rules: ParsingRules, patterns: list[str] | None = None) -> Column:
    """The answer of one reply as a single expression, for use inside arrays too."""
    patterns = usable_patterns(rules) if patterns is None else patterns
    raw = F.coalesce(reply, F.lit(""))
    body = trim_ws(strip_thinking(raw, rules.thinking_tags, rules.preserve_thinking, rules.strip_across_lines))
    found = lambda b: F.coalesce(F.nullif(match_patterns(b, patterns), F.lit("")), find_keyword(b, F.lower(b), rules))
    final = F.coalesce(map_answer(bind(body, found), rules.map), F.lit(rules.default))
    return final if rules.fallback is None else F.when(reply.isNull(), F.lit(rules.fallback)).otherwise(final)


def parse_responses(
    df: DataFrame,
    rules: ParsingRules,
    response: str = "raw_response",
    answer: str = "final_answer",
    thinking: str = "thinking_content",
) -> DataFrame:
    """Add the answer and the reasoning text of every reply.

    Steps that later steps read more than once get their own column, which Catalyst
    keeps as separate projections of one stage rather than inlining them repeatedly.
    """
    raw = F.coalesce(F.col(response), F.lit(""))
    body = trim_ws(strip_thinking(raw, rules.thinking_tags, rules.preserve_thinking, rules.strip_across_lines))
    out = df.withColumn(thinking, extract_thinking(raw, rules.thinking_tags)).withColumn("_body", body)
    out = out.withColumn("_low", F.lower("_body"))
    found = F.coalesce(
        F.nullif(match_patterns(F.col("_body"), usable_patterns(rules)), F.lit("")),
        find_keyword(F.col("_body"), F.col("_low"), rules),
    )
    out = out.withColumn("_found", found)
    final = F.coalesce(map_answer(F.col("_found"), rules.map), F.lit(rules.default))
    if rules.fallback is not None:
        final = F.when(F.col(response).isNull(), F.lit(rules.fallback)).otherwise(final)
    return out.withColumn(answer, final).drop("_body", "_low", "_found")
