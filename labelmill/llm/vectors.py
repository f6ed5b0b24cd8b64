"""Near-duplicate vectors by sorted projections.

Each vector is hashed with random hyperplanes and its bits are concatenated; sorting the
vectors of each label lexicographically by them puts similar ones near each other. The
sorted vectors are cut into blocks, and a block knows the box that its vectors take on some
orthonormal directions. Vectors at the threshold are no further apart than its chord, and no
closer than their projections, so two blocks whose boxes lie further apart hold no link. All
other pairs of blocks of a label are compared exactly, each pair in a task of its own, whatever
the label's size: no link is missed. Only counts and forests leave a task.

Vectors of one label and length are a group, and are hashed after the group's mean is
subtracted, so that planes part a label that is one dense cloud too; cosines are taken of
the raw vectors. Where boxes part nothing, as in one cloud of high dimension, all pairs of a
label's blocks are compared.

A caller may instead give a number of ``passes``, each with planes of its own, in which every
vector is only compared with a bounded window of the ones after it. This misses links;
``group_passes`` estimates from a first pass how many are needed to miss pairs at the
threshold with a probability of about ``MISS`` on average. The links of the components found
are then counted in full. Equal vectors are one vector with a number of copies throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from labelmill.llm.graph import components
from labelmill.llm.ranks import with_positions
from labelmill.llm.steps import saved

THRESHOLD, WINDOW, BITS, MISS, LEAST_PASSES = 0.98, 32, 60, 1e-3, 10
#: Vectors per sorted block, and per side of a pair of blocks.
RUN, SIDE = 2048, 512
#: Directions of a block's box.
DIRECTIONS = 16


def passes_for(chances: np.ndarray, weights: np.ndarray, miss: float = MISS) -> float:
    """Passes after which pairs are missed with probability ``miss`` on average, if one pass
    finds them with these chances; infinite if none is enough."""
    missed = lambda passes: float(weights @ (1 - chances) ** passes / weights.sum())
    most = 1 << 20
    if missed(most) > miss:
        return math.inf
    low, high = 0, most
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if missed(mid) <= miss else (mid, high)
    return max(LEAST_PASSES, high)


def _planes(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([number, dim]).standard_normal((BITS, dim))


def _unit(column: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in column])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _can_link():
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0.0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles), dim and cls of the vectors that can link."""
    v = vectors.filter(_can_link()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return v.withColumns({"dim": F.size("embedding"), "cls": F.xxhash64("label", "embedding")})


def _group_means(one: DataFrame) -> DataFrame:
    """grp, its number of vectors and the mean of their unit vectors."""

    def sums(batches):
        for pdf in batches:
            for grp, part in pdf.groupby("grp"):
                yield pd.DataFrame({"grp": [grp], "n": [len(part)], "s": [_unit(part["embedding"]).sum(0)]})

    part = one.select("grp", "embedding").mapInPandas(sums, "grp long, n long, s array<double>")
    at = part.select("grp", "n", F.posexplode("s").alias("i", "x")).groupBy("grp", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    found = at.groupBy("grp").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x")))).alias("m"))
    return found.select("grp", "n", F.col("m.x").alias("mean"))


def _keys(first: int):
    """Keys of the passes from ``first`` to the row's own number, and the distance from the
    group's mean."""

    def run(batches):
        for pdf in batches:
            for (dim, passes), part in pdf.groupby(["dim", "passes"]):
                centred = _unit(part["embedding"]) - np.stack(part["mean"].to_list())
                far = np.linalg.norm(centred, axis=1)
                for p in range(first, int(passes)):
                    bits = (centred @ _planes(p, int(dim)).T) > 0
                    key = np.zeros(len(part), np.int64)
                    for b in range(BITS):
                        key = (key << 1) | bits[:, b]
                    yield pd.DataFrame({"pass": p, "grp": part["grp"].to_numpy(), "key": key, "cls": part["cls"].to_numpy(), "far": far})

    return run


_KEYS = "pass int, grp long, key long, cls long, far double"
_PLACED = "pass int, grp long, key long, cls long, embedding array<double>, copies long, place array<double>"


def _key_and_place(batches):
    """The vectors with the key of the first pass and their projections on orthonormal
    directions, zeros where there are fewer."""
    for pdf in batches:
        for dim, part in pdf.groupby("dim"):
            planes, v = _planes(0, int(dim)), _unit(part["embedding"])
            bits = ((v - np.stack(part["mean"].to_list())) @ planes.T) > 0
            key = np.zeros(len(part), np.int64)
            for b in range(BITS):
                key = (key << 1) | bits[:, b]
            place = v @ np.linalg.qr(planes.T)[0][:, :DIRECTIONS]
            place = np.pad(place, ((0, 0), (0, DIRECTIONS - place.shape[1])))
            yield part[["grp", "cls", "embedding", "copies"]].assign(**{"pass": 0, "key": key, "place": list(place)})[[c.split()[0] for c in _PLACED.split(", ")]]


def _prefix_chances(window: int, threshold: float):
    """(grp, bucket, n): vectors by the chance that one pass finds a pair at the threshold,
    as whole quarters of its negative binary logarithm, rounded up.

    A pair is found if it agrees in so many bits that at most ``window`` others do. Centred
    vectors at distance ``far`` from the mean have a wider angle than raw ones.
    """
    chord = 2 - 2 * threshold

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for grp, c in pdf.groupby("grp", sort=False):
            c = c.sort_values("pos")
            key, far = c["key"].to_numpy(), np.maximum(c["far"].to_numpy(), 1e-9)
            need = np.ones(len(c))
            if len(c) > window:
                differ = key[window:] ^ key[:-window]
                shared = np.where(differ > 0, BITS - 1 - np.floor(np.log2(np.maximum(differ, 1))), np.inf)  # rows ``window`` apart
                for step in range(window + 1):
                    at = need[step : step + len(shared)]
                    np.maximum(at, shared + 1, out=at)
            agree = 1 - np.arccos(np.clip(1 - chord / (2 * far * far), -1, 1)) / math.pi
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(agree < 1, -np.log2(agree) * need, 0.0)
            bucket, n = np.unique(np.ceil(np.minimum(cost, 1000) * 4).astype(np.int64), return_counts=True)
            out.append(pd.DataFrame({"grp": grp, "bucket": bucket, "n": n}))
        return pd.concat(out)

    return run


def group_passes(one: DataFrame, groups: DataFrame, window: int, threshold: float) -> dict[int, int]:
    """An estimate of the passes that each group needs, for groups that passes send to fewer
    tasks than comparing all blocks: a row per group of more than LEAST_PASSES blocks reaches
    the driver."""
    large = groups.filter(F.col("n") > LEAST_PASSES * RUN)
    sizes = {r["grp"]: r["n"] for r in large.select("grp", "n").collect()}
    if not sizes:
        return {}
    first = one.join(large, "grp").withColumn("passes", F.lit(1))
    at = sorted_positions(first.select("cls", "grp", "dim", "embedding", "mean", "passes").mapInPandas(_keys(0), _KEYS))
    blocks = at.withColumn("block", F.floor(F.col("pos") / RUN)).groupBy("block")
    found = blocks.applyInPandas(_prefix_chances(window, threshold), "grp long, bucket long, n long").groupBy("grp", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for grp, c in found.groupby("grp"):
        passes = passes_for(2.0 ** (-c["bucket"].to_numpy() / 4), c["n"].to_numpy(float))
        if passes * RUN < sizes[grp]:
            out[int(grp)] = int(passes)
    return out


def sorted_positions(keys: DataFrame) -> DataFrame:
    """keys with ``pos``: the place of each row in the order by pass, group and key."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "grp", "key", "cls"]
    placed = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = saved(placed.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sorted-keys")
    sizes = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row per partition
    begin, at = [], 0
    for p in sorted(sizes):
        begin.append((p, at))
        at += sizes[p]
    offsets = placed.sparkSession.createDataFrame(begin, "_p int, _b long")
    return placed.join(F.broadcast(offsets), "_p").withColumn("pos", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def _forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """One edge per vector to the smallest vector that these links reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:  # smallest node reachable, by hooking and pointer jumping
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    far = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[far], "b": nodes[root[far]]})


def _window_links(window: int, threshold: float):
    """Links inside one block of the sorted order, as one edge per vector to the smallest
    vector that it reaches there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        grp, cls, pas = pdf["grp"].to_numpy(), pdf["cls"].to_numpy(), pdf["pass"].to_numpy()
        left, right = [], []
        for start in range(0, len(pdf), RUN):  # vectors of one length at a time
            stop = min(len(pdf), start + RUN + window)
            dims = pdf["embedding"].iloc[start:stop].map(len).to_numpy()
            v = np.zeros((stop - start, dims.max()))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v[at, :d] = _unit(pdf["embedding"].iloc[start:stop].iloc[at])
            for step in range(1, min(window, stop - start - 1) + 1):
                same = (grp[start : stop - step] == grp[start + step : stop]) & (pas[start : stop - step] == pas[start + step : stop])
                i = np.flatnonzero(same)
                i = i[np.einsum("ij,ij->i", v[i], v[i + step]) >= threshold]
                left.append(start + i)
                right.append(start + i + step)
        if not left:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return _forest(cls[np.concatenate(left)], cls[np.concatenate(right)])

    return run


def _block_links(threshold: float, edges: bool):
    """Links between two blocks of each set of a task: per vector their number in copies
    (cls, n), and with ``edges`` also as a forest (cls, to)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, found = [], []
        for _, c in pdf.groupby("root", sort=False):
            i, j = int(c["i"].iloc[0]), int(c["j"].iloc[0])
            for dim, part in c.groupby(c["embedding"].map(len), sort=False):
                v, k, q, cls = _unit(part["embedding"]), part["copies"].to_numpy(), part["q"].to_numpy(), part["cls"].to_numpy()
                a, b = np.flatnonzero(q == i), np.flatnonzero(q == j)
                for at in range(0, len(a), SIDE):
                    x = a[at : at + SIDE]
                    link = v[x] @ v[b].T >= threshold
                    if i == j:
                        link[np.arange(len(x)), at + np.arange(len(x))] = False
                        out.append((cls[x], link @ k[b]))
                    else:
                        out += [(cls[x], link @ k[b]), (cls[b], link.T @ k[x])]
                    if edges and link.any():
                        one, two = np.nonzero(link)
                        forest = _forest(cls[x][one], cls[b][two])
                        found.append(pd.DataFrame({"cls": forest["a"], "to": forest["b"], "n": 0}))
        ids, n = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        counts = pd.DataFrame({"cls": ids, "to": ids, "n": n.astype(np.int64)})
        return pd.concat([counts[counts["n"] > 0], *found])

    return run


def _compared(members: DataFrame, side: int, threshold: float, edges: bool) -> DataFrame:
    """(cls, to, n) of all pairs of blocks of ``side`` vectors within each root of
    ``members`` (root, cls, embedding, copies). Small sets share tasks."""
    spark = members.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    placed = with_positions(members, ["root"], ["cls"], "pos", max(8, tasks)).withColumn("q", F.floor(F.col("pos") / side))
    blocks = placed.groupBy("root").agg((F.max("q") + 1).alias("n"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: F.struct(F.least("q", j).alias("i"), F.greatest("q", j).alias("j")))
    sides = placed.join(blocks, "root").withColumn("ij", F.explode(pairs)).select("root", "cls", "embedding", "copies", "q", "ij.i", "ij.j", "n")
    return _links(sides, max(tasks, -(-members.count() // RUN)), threshold, edges)


def _links(sides: DataFrame, tasks: int, threshold: float, edges: bool) -> DataFrame:
    """(cls, to, n) of the pairs of blocks in ``sides``."""
    sides = sides.withColumn("task", F.when(F.col("n") > 1, F.xxhash64("root", "i", "j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(tasks))))
    return sides.groupBy("task", "i", "j").applyInPandas(_block_links(threshold, edges), "cls long, to long, n long")


def _near_blocks(at: DataFrame, threshold: float) -> DataFrame:
    """root, q, n (blocks of the root) and the pairs (i, j) of each block of ``at`` (root, q,
    place) with the blocks whose boxes are near enough for a link."""
    edge = lambda fn: F.array(*[fn(F.col("place")[k]) for k in range(DIRECTIONS)])
    boxes = saved(at.groupBy("root", "q").agg(edge(F.min).alias("low"), edge(F.max).alias("high")), "block-boxes")
    one, two = (boxes.select("root", *[F.col(c).alias(c + x) for c in ("q", "low", "high")]) for x in "ij")
    apart = lambda k: F.greatest(F.lit(0.0), F.col("lowi")[k] - F.col("highj")[k], F.col("lowj")[k] - F.col("highi")[k])
    gap = sum(apart(k) * apart(k) for k in range(DIRECTIONS))
    pairs = one.join(two, "root").filter("qi <= qj").filter(gap <= 2 - 2 * threshold + 1e-9)
    of = pairs.select("root", F.struct(F.col("qi").alias("i"), F.col("qj").alias("j")).alias("ij")).withColumn("q", F.explode(F.array_distinct(F.array("ij.i", "ij.j"))))
    blocks = boxes.groupBy("root").agg(F.count("*").alias("n"))
    return saved(of.groupBy("root", "q").agg(F.collect_list("ij").alias("pairs")).join(blocks, "root"), "near-blocks")


def _all_links(one: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(cls, to, n) of all links within the groups of ``one``."""
    hashed = one.join(groups.select("grp", "mean"), "grp").select("grp", "cls", "dim", "embedding", "copies", "mean")
    at = sorted_positions(hashed.mapInPandas(_key_and_place, _PLACED)).drop("pass", "key")
    begin = at.groupBy("grp").agg(F.min("pos").alias("begin"))
    at = at.join(begin, "grp").withColumn("q", F.floor((F.col("pos") - F.col("begin")) / RUN)).withColumnRenamed("grp", "root")
    near = _near_blocks(at, threshold)
    sides = at.join(near, ["root", "q"]).select("root", "cls", "embedding", "copies", "q", "n", F.explode("pairs").alias("ij"))
    tasks = max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4, -(-one.count() // RUN))
    return _links(sides.select("root", "cls", "embedding", "copies", "q", "ij.i", "ij.j", "n"), tasks, threshold, edges=True)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors link when their labels are equal and not null and their cosine in double
    precision reaches the threshold; vectors of different length never do. Null, zero and
    non-finite vectors have no link and are their own component. Repeated rows count as
    other vectors. Other columns than vec_id, label and embedding are not read. All links are
    found, whatever the size of a label, unless ``passes`` are given: then those of ``window``
    neighbours in so many passes are.
    """
    base = usable(vectors)
    one = saved(base.groupBy("cls").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.first("dim").alias("dim"), F.count("*").alias("copies")), "distinct-vectors")
    one = one.withColumn("grp", F.xxhash64("label", "dim"))
    groups = saved(_group_means(one), "vector-groups")
    if passes:
        large = one.withColumn("passes", F.lit(passes))
        keys = large.join(groups, "grp").select("cls", "grp", "dim", "embedding", "mean", "passes").mapInPandas(_keys(0), _KEYS)
        at = sorted_positions(keys.drop("far")).withColumn("block", F.floor(F.col("pos") / RUN))
        halo = F.when((F.col("pos") % RUN < window) & (F.col("block") > 0), F.array("block", F.col("block") - 1)).otherwise(F.array("block"))
        runs = at.select("pass", "grp", "cls", "pos", F.explode(halo).alias("block")).join(large.select("cls", "embedding"), "cls")
        links = runs.groupBy("block").applyInPandas(_window_links(window, threshold), "a long, b long")
    else:
        full = saved(_all_links(one, groups, threshold), "block-links")
        links, counts = full.filter("n = 0").select(F.col("cls").alias("a"), F.col("to").alias("b")), full.filter("n > 0")
    roots = saved(components(saved(links.distinct(), "window-links")), "vector-components")
    if passes:
        members = one.select("cls", "embedding", "copies").join(roots.withColumnRenamed("node", "cls"), "cls")
        counts = _compared(members, SIDE, threshold, edges=False)
    counted = counts.groupBy("cls").agg(F.sum("n").alias("others"))

    linked = base.select("vec_id", "cls").join(one.select("cls", "copies"), "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(counted, "cls", "left")
    linked = saved(linked.select("vec_id", F.coalesce("root", "cls").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "linked-vectors")
    least = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    good = linked.join(least, "root").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    lone = vectors.select("vec_id", "label", "embedding").withColumn("_ok", _can_link()).filter(~F.col("_ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
