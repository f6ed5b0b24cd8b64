"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from labelmill.llm import best_position

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counted:
            if n:
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
                if score > 0:
                    scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(n, seed, words=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(vocab, weights, k=rng.choice([1, 3, 20, 80])))) for i in range(n)]


def found(spark, docs, items, extra="", **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        d, q = d.selectExpr("*", *extra.split(";")), q.selectExpr("*", *extra.split(";"))
    return sorted((tuple(r) for r in best_position.rank(d, q, **kw).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in dict(BLOCK_POSTINGS=60, BLOCK_DOCS=25, FIRST_STEP=1, BATCH_TERMS=40).items():
            monkeypatch.setattr(best_position, name, value)
    docs, items = corpus(400, 1), [(i, t) for i, t in corpus(25, 2)]
    assert found(spark, docs, items) == brute(docs, items)


def test_case_bytes_ties_repeats_and_nulls(spark):
    docs = [(i, "Café x1 zeta") for i in range(30)] + [(5, "café"), (5, "café"), (None, "café café"), (None, None), (40, ""), (41, " \t-"), (42, "CAFÉ É_x1"), (43, "long " * 50_000 + "café")]
    items = [(1, "café"), (1, "café"), (2, "É x1 zeta zeta"), (3, None), (4, ""), (5, "nowhere"), (None, "long"), (6, "...")]
    assert found(spark, docs, items, extra="1 AS k;2 AS ord;3 AS score;4 AS rank;5 AS terms;6 AS size") == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a b")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_a_term_in_all_documents(spark):
    docs = [(i, "the " * (1 + i % 3) + f"r{i % 40}") for i in range(200)]
    items = [(1, "the"), (2, "the r1 r2"), (3, "r39")]
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_reading_stops_before_the_lists_end():
    """With strong documents on top, few entries are read, and none that could tie is missed."""
    rng = np.random.default_rng(4)
    n, tf = 5000, rng.integers(1, 4, 10_000)
    doc = np.concatenate([np.arange(n), np.arange(n)])
    tf[[7, n + 7]] = 400
    row = SimpleNamespace(ids=np.arange(n).tobytes(), sizes=np.full(n, 500).tobytes(), terms=np.array([0, 1], np.int32).tobytes(), counts=np.array([n, n], np.int32).tobytes(), doc=doc.astype(np.int32).tobytes(), tf=tf.astype(np.int32).tobytes())
    block, best, all_of_it = best_position.Block(row, n, n * 500), best_position.Best(1), best_position.Best(1)
    read = best_position.search(block, np.array([0, 1]), np.array([5, 3]), best)
    score = np.zeros(n, np.int64)
    np.add.at(score, block.doc, np.where(block.term == 0, 5, 3) * block.impact)
    all_of_it.add(score, np.arange(n))
    assert best.ids.tolist() == all_of_it.ids.tolist() == [7] and read < 200
