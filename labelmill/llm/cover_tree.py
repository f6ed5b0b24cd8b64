"""Hard negatives by best-first search in cover trees over norm-augmented candidates.

With the largest norm M of all candidates, a candidate x becomes (x, sqrt(M^2 - |x|^2)) and
an anchor q becomes (q, 0): then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner
products are the nearest points, and a ball around a candidate bounds inner products from
above and below.

Candidates are sorted by length, label and id and cut into blocks; each block is one cover
tree. A node's children are a net of its points: centres are taken farthest first until
the covering radius has shrunk by ``SHRINK`` or there are ``FANOUT`` of them, the node's own
centre first. Every node has the measured radius that covers all points below it, and the
range of their labels. Trees are a written table, built once.

A search goes best-first: the open node with the highest bound is expanded next, nodes
wholly outside the window of allowed scores or without a wanted label are skipped, leaves
are verified by exact integer products, and a search ends when no open node's bound reaches
its k-th score (ties go on, because the smaller id wins them). Many searches of a task step
together, each in its own order. Anchors meet the trees in blocks, and the best of a task's
trees bound the next; only k rows per search leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from labelmill.llm.steps import saved

#: Numbers per tree, rows per tree at most, points per leaf, children per node, shrinking of
#: the radius from a node to its children, trees and anchors per task, searches at once.
TREE_VALUES, TREE_ROWS, LEAF, FANOUT, SHRINK, TREES, ANCHORS, AT_ONCE = 1 << 17, 2048, 32, 64, 1.5, 16, 2048, 512
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
_LAST, _NONE = (1 << 63) - 1, -(1 << 63)
#: Products are exact in doubles below this squared norm.
_EXACT = float(1 << 52)


def usable(vectors: DataFrame, anchors: Column, scale: int = 256) -> DataFrame:
    """The rows that take part, with floor(scale * x) as integers: u (row), ord (the id,
    null last), lab (label as a long), dim, e and anchor. Null labels, null vectors and
    vectors with null or non-finite components take no part."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label").cast("long") if isinstance(vectors.schema["label"].dataType, IntegralType) else F.xxhash64("label")
    good = vectors.filter(F.coalesce(F.col("label").isNotNull() & e.isNotNull() & finite, F.lit(False)))
    return good.select(
        F.monotonically_increasing_id().alias("u"), F.coalesce(F.col("vec_id").cast("long"), F.lit(_LAST)).alias("ord"), label.alias("lab"), F.size(e).alias("dim"),
        F.transform(e, lambda x: F.floor(x * F.lit(float(scale)))).alias("e"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )


def augmented(e: np.ndarray, most: float) -> np.ndarray:
    """Integer rows with the coordinate that gives all the norm sqrt(most)."""
    x = e.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0.0))))


def build(x: np.ndarray, lab: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """(order of the rows, nodes) of a cover tree over the rows of x.

    A node holds the ordered rows start to stop; centre is a row number in that order.
    """
    order, nodes, at = np.arange(len(x)), [[0, 0.0, 0, len(x), 0, 0, 0, 0]], 0
    while at < len(nodes):
        node = nodes[at]
        centre, start, stop = node[0], node[2], node[3]
        rows = order[start:stop]
        near = np.linalg.norm(x[rows] - x[centre], axis=1)
        node[1], node[6], node[7] = float(near.max()), int(lab[rows].min()), int(lab[rows].max())
        if stop - start > LEAF and node[1] > 0:
            centres, own, enough = [centre], np.zeros(len(rows), np.int64), node[1] / SHRINK
            while len(centres) < FANOUT and near.max() > enough:
                far = rows[int(near.argmax())]
                reach = np.linalg.norm(x[rows] - x[far], axis=1)
                own[reach < near] = len(centres)
                near = np.minimum(near, reach)
                centres.append(far)
            order[start:stop] = rows[np.argsort(own, kind="stable")]
            ends = start + np.cumsum(np.bincount(own, minlength=len(centres)))
            node[4], node[5] = len(nodes), len(centres)
            nodes += [[int(c), 0.0, int(a), int(b), 0, 0, 0, 0] for c, a, b in zip(centres, [start, *ends[:-1]], ends)]
        at += 1
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    frame = pd.DataFrame(nodes, columns=["centre", "radius", "start", "stop", "first", "children", "low_lab", "high_lab"])
    frame["centre"] = place[frame["centre"].to_numpy()]
    return order, frame


_NODE = ["centre", "start", "stop", "first", "children", "low_lab", "high_lab"]
_TREE = "dim int, rows int, u binary, ord binary, lab binary, e binary, radius binary, " + ", ".join(f"{c} binary" for c in _NODE)


def tree_rows(dim: int) -> int:
    return max(LEAF, min(TREE_ROWS, TREE_VALUES // max(dim, 1)))


def _packed(part: pd.DataFrame, most: float) -> pd.DataFrame:
    e = np.stack([np.asarray(v, np.int64) for v in part["e"]])
    lab = part["lab"].to_numpy(np.int64)
    order, nodes = build(augmented(e, most), lab)
    out = {"dim": e.shape[1], "rows": len(e), "u": part["u"].to_numpy(np.int64)[order].tobytes(), "ord": part["ord"].to_numpy(np.int64)[order].tobytes()}
    out |= {"lab": lab[order].tobytes(), "e": e[order].tobytes(), "radius": nodes["radius"].to_numpy(np.float64).tobytes()}
    return pd.DataFrame([out | {c: nodes[c].to_numpy(np.int64).tobytes() for c in _NODE}])


def index(rows: DataFrame, most: float, count: int) -> DataFrame:
    """A row per tree over all of ``rows``, of which there are ``count``."""
    order = ["dim", "lab", "ord", "u"]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // (TREE_ROWS * 8)))

    def run(batches):
        held: pd.DataFrame | None = None
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=True):
                if held is not None and held["dim"].iloc[0] != dim:
                    yield _packed(held, most)
                    held = None
                held = part if held is None else pd.concat([held, part])
                while len(held) >= tree_rows(dim):
                    yield _packed(held.iloc[: tree_rows(dim)], most)
                    held = held.iloc[tree_rows(dim) :] if len(held) > tree_rows(dim) else None
                    if held is None:
                        break
        if held is not None:
            yield _packed(held, most)

    sorted_rows = rows.select("dim", "lab", "ord", "u", "e").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sorted_rows.mapInPandas(run, _TREE)


class Tree:
    """One stored tree as arrays."""

    def __init__(self, row, most: float):
        get = lambda name, kind=np.int64: np.frombuffer(getattr(row, name), kind)
        self.u, self.ord, self.lab, self.radius = get("u"), get("ord"), get("lab"), get("radius", np.float64)
        self.e = get("e").reshape(int(row.rows), int(row.dim))
        self.x = self.e.astype(np.float64)
        for name in _NODE:
            setattr(self, name, get(name))
        self.most = most


class Searches:
    """Searches of anchors, each with windows of scores and the k best rows of every window.

    ``low`` and ``high`` have a row per search and a column per window; a window with low
    above high is none. Results are (score, ord, row), in order, by search * windows + window.
    """

    def __init__(self, q: np.ndarray, u: np.ndarray, lab: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.q, self.u, self.lab, self.low, self.high, self.k, self.same = q, u, lab, low, high, k, same
        self.x, self.qq = q.astype(np.float64), np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64))
        self.count = np.zeros(low.size, np.int64)
        self.score, self.ord, self.row = (np.zeros((low.size, k), np.int64) for _ in range(3))
        self.kth = np.where(low > high, np.inf, -np.inf)
        self.least = self.kth.min(axis=1)  # what a search still has to reach

    def add(self, who: np.ndarray, window: int, score: np.ndarray, order: np.ndarray, row: np.ndarray) -> None:
        """Rows of searches for one window; those below the window's k-th are left out."""
        keep = (score >= self.low[who, window]) & (score <= self.high[who, window]) & (score >= self.kth[who, window])
        if not keep.any():
            return
        asked, who = np.unique(who[keep], return_inverse=True)
        slot = asked * self.low.shape[1] + window
        old, at = np.nonzero(np.arange(self.k) < self.count[slot, None])
        who = np.concatenate((old, who))
        score, order, row = (np.concatenate((mine[slot[old], at], new[keep])) for mine, new in ((self.score, score), (self.ord, order), (self.row, row)))
        by = np.lexsort((row, order, -score, who))
        rank = np.arange(len(by)) - np.searchsorted(who[by], who[by])
        by, rank = by[rank < self.k], rank[rank < self.k]
        to = slot[who[by]], rank
        self.score[to], self.ord[to], self.row[to] = score[by], order[by], row[by]
        self.count[slot] = np.bincount(who[by], minlength=len(slot))
        full = rank == self.k - 1
        self.kth[asked[who[by[full]]], window] = score[by[full]]
        self.least[asked] = self.kth[asked].min(axis=1)

    def results(self) -> tuple[np.ndarray, ...]:
        """(search, window, score, ord, row) of all rows found."""
        slot, at = np.nonzero(np.arange(self.k) < self.count[:, None])
        return slot // self.low.shape[1], slot % self.low.shape[1], self.score[slot, at], self.ord[slot, at], self.row[slot, at]


def _spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which span, value) of all values of the spans first to first + size."""
    which = np.repeat(np.arange(len(first)), size)
    return which, np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))


def search(tree: Tree, s: Searches, part: slice) -> None:
    """Best-first descent of the searches in ``part``, which step together."""
    ids = np.arange(len(s.q))[part]
    open_ = np.full((len(ids), len(tree.centre)), -np.inf)
    total = s.qq + tree.most
    slack = 1e-9 * total + 1e-6

    def enter(i: np.ndarray, node: np.ndarray) -> None:
        """Open nodes of searches, with the highest score that the windows leave them."""
        of = ids[i]
        far = np.sqrt(np.maximum(total[of] - 2 * np.einsum("ij,ij->i", s.x[of], tree.x[tree.centre[node]]), 0.0))
        most = (total[of] - np.maximum(far - tree.radius[node], 0.0) ** 2) / 2 + slack[of]
        least = (total[of] - (far + tree.radius[node]) ** 2) / 2 - slack[of]
        lab, low, high = s.lab[of], tree.low_lab[node], tree.high_lab[node]
        wanted = (low <= lab) & (lab <= high) if s.same else (low != lab) | (high != lab)
        meets = (most[:, None] >= s.low[of]) & (least[:, None] <= s.high[of])
        best = np.where(meets, np.minimum(most[:, None], s.high[of]), -np.inf).max(axis=1)
        wanted &= best >= s.least[of]
        open_[i[wanted], node[wanted]] = best[wanted]

    exact = tree.most < _EXACT and bool((s.qq[part] < _EXACT).all())
    enter(np.arange(len(ids)), np.zeros(len(ids), np.int64))
    active = np.arange(len(ids))
    while True:
        pick = open_[active].argmax(axis=1)
        best = open_[active, pick]
        live = (best > -np.inf) & (best >= s.least[ids[active]])
        active, node = active[live], pick[live]
        if not len(active):
            return
        open_[active, node] = -np.inf
        inner = tree.children[node] > 0
        if inner.any():
            which, child = _spans(tree.first[node[inner]], tree.children[node[inner]])
            enter(active[inner][which], child)
        if not inner.all():
            leaf, who = node[~inner], ids[active[~inner]]
            which, point = _spans(tree.start[leaf], tree.stop[leaf] - tree.start[leaf])
            who = who[which]
            fits = (tree.lab[point] == s.lab[who]) == s.same
            fits &= tree.u[point] != s.u[who]
            who, point = who[fits], point[fits]
            score = np.einsum("ij,ij->i", s.x[who], tree.x[point]).astype(np.int64) if exact else np.einsum("ij,ij->i", s.q[who], tree.e[point])
            for window in range(s.low.shape[1]):
                s.add(who, window, score, tree.ord[point], tree.u[point])


_FOUND = "a long, p int, score long, ord long, u long"


def _best(trees: DataFrame, groups: int, wanted: DataFrame, blocks: int, k: int, same: bool, most: float) -> DataFrame:
    """The k best rows for every window of the anchors in ``wanted`` (block, a, dim, lab, e,
    low, high; the last two are arrays), with the window p and the rank n from 1."""

    def run(_, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, c in asked.groupby("dim"):
            width = int(c["low"].map(len).max())
            low, high = np.ones((len(c), width), np.int64), np.zeros((len(c), width), np.int64)
            for to, name in ((low, "low"), (high, "high")):
                for i, v in enumerate(c[name]):
                    to[i, : len(v)] = v
            s = Searches(np.stack([np.asarray(v, np.int64) for v in c["e"]]), c["a"].to_numpy(), c["lab"].to_numpy(), low, high, k, same)
            step = max(8, min(AT_ONCE, (AT_ONCE * 64) // max(int(dim), 1)))
            for row in held[held["dim"] == dim].itertuples():
                tree = Tree(row, most)
                for at in range(0, len(c), step):
                    search(tree, s, slice(at, at + step))
            who, p, score, order, u = s.results()
            out.append(pd.DataFrame({"a": c["a"].to_numpy()[who], "p": p, "score": score, "ord": order, "u": u}))
        return pd.concat(out) if out else pd.DataFrame({n: np.zeros(0, np.int64) for n in ("a", "p", "score", "ord", "u")})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.withColumn("g", every(groups)).groupBy("block", "g")
    right = trees.withColumn("block", every(blocks)).groupBy("block", "g")
    found = left.cogroup(right).applyInPandas(run, _FOUND)
    return found.withColumn("n", F.row_number().over(Window.partitionBy("a", "p").orderBy(F.desc("score"), "ord", "u"))).filter(F.col("n") <= k)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds, over all rows.

    A row's score is its integer inner product with the anchor, over components
    floor(scale * x). An anchor's positives are its first rows of the same label; negatives
    of a pair are the first rows of another label with low to high percent of the positive's
    score. Higher scores come first, ties by smaller vec_id; null ids come last and are no
    anchors unless the condition says so. Rows without a label or with a null, or non-finite,
    vector take no part; rows of different length never meet; an empty vector scores 0.
    Repeated rows are rows of their own, and a repeated anchor returns its rows again.
    Scores must fit a long. Other columns than vec_id, label and embedding are not read.
    """
    spark = vectors.sparkSession
    rows = saved(usable(vectors, anchors, scale), "candidates")
    squared = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, asked, most = rows.agg(F.count("*"), F.count_if("anchor"), F.max(squared)).first()
    if not asked:
        return spark.createDataFrame([], _RESULT)
    trees = saved(index(rows, most, count), "cover-trees")
    held = trees.count()
    groups = max(-(-held // TREES), min(held, spark.sparkContext.defaultParallelism))
    trees = trees.withColumn("g", F.pmod(F.xxhash64("u"), F.lit(groups)).cast("int"))
    blocks = -(-asked // ANCHORS)
    own = rows.filter("anchor").withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")).withColumnRenamed("u", "a")
    whole = own.select("block", "a", "dim", "lab", "e", F.array(F.lit(_NONE)).alias("low"), F.array(F.lit(_LAST)).alias("high"))
    first = saved(_best(trees, groups, whole, blocks, positives, True, most).select("a", (F.col("n") - 1).alias("p"), F.col("ord").alias("positive"), F.col("score").alias("ps")), "positives")
    ps = F.col("ps").cast("decimal(20,0)")
    window = first.select("a", "p", (-F.floor(-ps * low / 100)).cast("long").alias("low"), F.floor(ps * high / 100).cast("long").alias("high"))
    windows = window.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("p", "low", "high"))).alias("w"))  # at most ``positives`` of them
    pairs = own.select("block", "a", "dim", "lab", "e").join(windows, "a").select("block", "a", "dim", "lab", "e", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    second = _best(trees, groups, pairs, blocks, negatives, False, most).select("a", "p", "n", F.col("ord").alias("negative"), F.col("score").alias("ns"))
    named = second.join(first, ["a", "p"]).join(own.select("a", F.col("ord").alias("anchor_ord")), "a")
    back = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return named.select(
        back("anchor_ord").alias("anchor_id"), back("positive").alias("positive_id"), F.col("n").cast("int").alias("rank"), back("negative").alias("negative_id"),
        F.col("ps").alias("positive_score"), F.col("ns").alias("negative_score"),
    )
