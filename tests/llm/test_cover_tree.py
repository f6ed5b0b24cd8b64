"""Hard negatives against brute force, and the tree's own promises."""

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelmill.llm import cover_tree

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    good = [(i, x, [math.floor(256 * float(np.float32(v))) for v in e], k) for k, (i, x, e) in enumerate(rows) if x is not None and e is not None and all(v is not None and math.isfinite(v) for v in e)]
    last = lambda i: (i is None, i)
    out = []
    for a, al, ae, ak in good:
        if a is None or not anchor(a):
            continue
        scored = [(sum(p * q for p, q in zip(ae, e)), i, x) for i, x, e, k in good if k != ak and len(e) == len(ae)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for ps, p, _ in [s for s in scored if s[2] == al][:positives]:
            fits = [s for s in scored if s[2] != al and low * ps <= 100 * s[0] <= high * ps][:negatives]
            out += [(a, p, n + 1, i, ps, ns) for n, (ns, i, _) in enumerate(fits)]
    return out


def key(row):
    return [(v is None, v) for v in row]


def same(spark, rows, monkeypatch=None, **settings):
    for name, value in settings.items():
        monkeypatch.setattr(cover_tree, name, value)
    found = [tuple(r) for r in cover_tree.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()]
    want = brute(rows, lambda i: i % 10 == 0)
    assert sorted(found, key=key) == sorted(want, key=key)
    return found


def clouds(n, labels, dim, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    label = rng.integers(0, labels, n)
    x = centres[label] * 0.3 + rng.normal(size=(n, dim)) * spread
    return [(int(i), int(c), [float(v) for v in row.astype(np.float32)]) for i, (c, row) in enumerate(zip(label, x))]


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_equals_brute_force(spark, monkeypatch, spread):
    assert same(spark, clouds(700, 4, 8, spread, 3), monkeypatch, TREE_ROWS=128, LEAF=8, FANOUT=6, TREES=2, ANCHORS=32, AT_ONCE=20)


def test_one_hot_label_and_many_equal_vectors(spark, monkeypatch):
    rows = clouds(300, 5, 6, 0.2, 5)
    rows += [(1000 + i, 2, rows[0][2]) for i in range(150)] + [(2000 + i, 3, rows[1][2]) for i in range(150)]
    assert same(spark, rows, monkeypatch, TREE_ROWS=64, LEAF=4, FANOUT=4, TREES=3)


def test_nulls_lengths_repeats_and_large_numbers(spark, monkeypatch):
    rows = clouds(60, 3, 4, 0.3, 7)
    rows += [(10, 1, [0.5, 0.5, 0.1, 0.0])] * 2 + [(None, 0, [0.4, 0.2, 0.1, 0.0]), (None, 1, [0.4, 0.2, 0.1, 0.0])]
    rows += [(20, None, [1.0] * 4), (30, 1, None), (40, 1, [1.0, None, 1.0, 1.0]), (50, 2, [float("nan")] * 4), (60, 2, [float("inf")] * 4)]
    rows += [(70, 1, []), (71, 1, []), (72, 2, []), (80, 1, [1.0, 2.0]), (81, 1, [2.0, 2.0]), (82, 0, [1.0, 1.0])]
    rows += [(90, 0, [0.0] * 4), (91, 0, [0.0] * 4), (92, 1, [0.0] * 4)]
    assert same(spark, rows)
    big = [(i, i % 2, [1e6 + 2e5 * i, 9e5 - 1e4 * i]) for i in range(40)]
    assert same(spark, big)


def test_empty_and_clashing_columns(spark):
    none = cover_tree.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0)
    assert none.count() == 0 and none.columns[:3] == ["anchor_id", "positive_id", "rank"]
    assert cover_tree.mine(spark.createDataFrame([(1, 1, [1.0])], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    rows = clouds(50, 2, 3, 0.3, 9)
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS u", "2 AS ord", "3 AS lab", "4 AS e", "5 AS a", "6 AS g", "7 AS block", "8 AS anchor")
    found = [tuple(r) for r in cover_tree.mine(extra, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(found) == sorted(brute(rows, lambda i: i % 10 == 0))


def test_radii_cover_and_searches_skip(monkeypatch):
    """Every node covers its points, children part them, and a search reads few leaves."""
    rows = clouds(2000, 20, 8, 0.01, 11)
    e = np.array([[math.floor(256 * v) for v in r[2]] for r in rows])
    most = float((e.astype(float) ** 2).sum(1).max())
    lab = np.array([r[1] for r in rows])
    x = cover_tree.augmented(e, most)
    order, nodes = cover_tree.build(x, lab)
    assert sorted(order) == list(range(len(rows)))
    children = defaultdict(list)
    for k, n in nodes.iterrows():
        inside = order[int(n["start"]) : int(n["stop"])]
        centre = order[int(n["centre"])]
        assert centre in inside and np.linalg.norm(x[inside] - x[centre], axis=1).max() <= n["radius"] + 1e-9
        for c in range(int(n["first"]), int(n["first"] + n["children"])):
            children[k].append((int(nodes["start"][c]), int(nodes["stop"][c])))
        if children[k]:
            spans = sorted(children[k])
            assert spans[0][0] == n["start"] and spans[-1][1] == n["stop"] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    part = pd.DataFrame({"u": np.arange(len(rows)), "ord": np.arange(len(rows)), "lab": lab, "e": list(e)})
    tree = cover_tree.Tree(next(cover_tree._packed(part, most).itertuples()), most)
    seen = []
    add = cover_tree.Searches.add
    monkeypatch.setattr(cover_tree.Searches, "add", lambda self, who, *rest: (seen.append(len(who)), add(self, who, *rest))[1])
    s = cover_tree.Searches(e[:1], np.array([0]), lab[:1], np.array([[-(1 << 62)]]), np.array([[1 << 62]]), 5, True)
    cover_tree.search(tree, s, slice(0, 1))
    assert len(s.results()[0]) == 5 and sum(seen) < 400
