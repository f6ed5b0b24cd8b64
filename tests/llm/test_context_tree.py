"""Code lengths against a plain recursive context-tree weighting, and its promises."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import context_tree


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(docs, depth):
    """Scores by exact fractions: the weighting itself, with a text's bit added to its node."""
    zeros, ones = defaultdict(int), defaultdict(int)

    def decisions(text):
        data = [0xFE] * depth + list(lower(text).encode()) + [0xFF]
        for at in range(depth, len(data)):
            node = 1
            for i in range(8):
                bit = data[at] >> (7 - i) & 1
                yield tuple(data[at - depth : at]), node, bit
                node = node * 2 + bit

    children = defaultdict(set)
    for i, text in docs:
        if not is_held(i):
            for context, node, bit in decisions(text):
                for d in range(depth + 1):
                    tail = context[depth - d :]
                    (ones if bit else zeros)[tail, node] += 1
                    if d:
                        children[tail[1:], node].add(tail)

    def estimate(a, b):
        p = Fraction(1)
        for k in range(a):
            p *= Fraction(2 * k + 1, 2 * (k + 1))
        for k in range(b):
            p *= Fraction(2 * k + 1, 2 * (a + k + 1))
        return p

    weighted = {}

    def weight(tail, node):
        if (tail, node) not in weighted:
            pe = estimate(zeros[tail, node], ones[tail, node])
            if len(tail) < depth:
                below = Fraction(1)
                for c in sorted(children[tail, node]):
                    below *= weight(c, node)
                pe = (pe + below) / 2
            weighted[tail, node] = pe
        return weighted[tail, node]

    def chance(context, node, d):
        """Of a one behind the path from depth d on, by the shares the weighting leaves."""
        tail = context[depth - d :]
        a, b = zeros[tail, node], ones[tail, node]
        kt = Fraction(2 * b + 1, 2 * (a + b + 1))
        if d == depth:
            return kt
        below = Fraction(1)
        for c in children[tail, node]:
            below *= weight(c, node)
        own = estimate(a, b) / below
        return (own * kt + chance(context, node, d + 1)) / (own + 1)

    known = Counter()
    for i, text in docs:
        if not is_held(i):
            known.update([*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None])
    out = []
    memo = {}
    for i, text in docs:
        score = 0.0
        for context, node, bit in decisions(text):
            if (context, node) not in memo:
                memo[context, node] = float(chance(context, node, 0))
            score += math.log10(memo[context, node] if bit else 1 - memo[context, node])
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]
        total = known.total()
        base = sum(math.log10((known[t] + 1) / (total + len(known) + 1)) for t in tokens)
        out.append((i, is_held(i), len(tokens), sum(known[t] > 0 for t in tokens), total, base, score))
    return out


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, "".join(rng.choices(["the ", "cat", "sat ", "on", " a ", "Mat. ", "é", "\t", "ß"], k=rng.choice([0, 1, 5, 12])))) for i in range(n)]


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_equals_recursive_weighting(spark, monkeypatch, depth):
    monkeypatch.setattr(context_tree, "SLICE", 300)
    monkeypatch.setattr(context_tree, "RUN", 100)
    monkeypatch.setattr(context_tree, "BUCKET", 50)
    docs = texts(40, depth) + [(None, "no id"), (None, None), (3, "again"), (3, "again"), (90, None), (91, ""), (92, "A" * 60), (93, "\x00\x00 \x7f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS held", "2 AS n", "3 AS slice", "4 AS key", "5 AS ids")
    found = [tuple(r)[:7] for r in context_tree.score(df, depth=depth).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, round(r[6], 6))
    for got, want in zip(sorted(found, key=order), sorted(brute(docs, depth), key=order), strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5], abs=1e-9) and got[6] == pytest.approx(want[6], rel=1e-9, abs=1e-9)


def test_empty_table_and_nothing_to_learn(spark):
    assert context_tree.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = context_tree.score(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), held=F.lit(True)).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0 and row["score"] == pytest.approx(-24 * math.log10(2)) and row["bits_per_byte"] == pytest.approx(8)


def test_log_gamma():
    for v in [0.5, 1.0, 1.5, 2.0, 10.5, 1e3, 1e6 + 0.5, 1e10]:
        assert context_tree.log_gamma(np.array([v]))[0] == pytest.approx(math.lgamma(v), rel=1e-12, abs=1e-11)


def test_longer_contexts_tell_more_of_held_out_text(spark):
    """Words of known syllables in new combinations."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(["tion", "ing", "est", "ver", "al", "con"], k=rng.choice([2, 3, 4])))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(20))) for i in range(300)], "doc_id long, text string")
    total = [context_tree.score(docs, depth=d).filter("held_out").agg(F.sum("score"), F.max("bits_per_byte")).first() for d in (0, 2, 5)]
    assert total[0][0] < total[1][0] < total[2][0] and total[2][1] < 2.5
