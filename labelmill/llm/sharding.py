"""Byte-balanced shards by Karmarkar-Karp differencing.

Documents with equal texts form an indivisible group. A partial partition is a tuple of
one byte sum per shard; a group is one with a single sum above zero. Differencing takes
the two partial partitions of largest spread and adds them in opposite order, largest sum
to smallest, until one is left. Groups are dealt by hash into chunks of bounded size, each
chunk is differenced in one task, and the chunks' partial partitions are differenced again
by the same step, level by level, until one chunk remains. The small residues of a level
let the next one cancel them, so the result is as tight as that of one large run.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from labelmill.llm.ranks import position_blocks, with_positions
from labelmill.llm.steps import saved

#: Partial partitions that one task combines.
CHUNK = 2048


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of sums) into one.

    Returns, for each row and place, the place in the result, and the result's sums. The
    result's places are in descending order of their sum.
    """
    n, shards = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    current = {i: np.take_along_axis(sums[i], order[i], 0) for i in range(n)}
    # where[i]: rows combined into i and, per row, which original place stands at each place
    where = {i: [(i, order[i])] for i in range(n)}
    heap = [(-int(v[0] - v[-1]), i) for i, v in current.items()]
    heapq.heapify(heap)
    trace: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
    node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = current.pop(a) + current.pop(b)[::-1]
        by = np.argsort(-both, kind="stable")
        current[node] = both[by]
        trace.append((node, a, b, by, (shards - 1 - by)))
        heapq.heappush(heap, (-int(current[node][0] - current[node][-1]), node))
        node += 1
    (root,) = current
    place = {root: np.arange(shards)}
    for made, a, b, to_a, to_b in reversed(trace):  # child place to_a[j] is result place j
        up = place.pop(made)
        for child, to in ((a, to_a), (b, to_b)):
            at = np.empty(shards, int)
            at[to] = up
            place[child] = at
    out = np.empty((n, shards), int)
    for i in range(n):
        out[i, order[i]] = place[i]
    return out, current[root]


def _combine(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A chunk's partial partitions (child, place, bytes) as one: where each goes, and the new sums."""
        children, row = np.unique(pdf["child"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(children), shards), np.int64)
        sums[row, pdf["place"].to_numpy()] = pdf["bytes"].to_numpy()
        to, total = difference(sums)
        goes = to[row, pdf["place"].to_numpy()]
        return pd.DataFrame({"chunk": pdf["chunk"], "child": pdf["child"], "place": pdf["place"], "to": goes.astype(np.int32), "sum": total[goes]})

    return run


def balanced_groups(groups: DataFrame, shards: int, chunk: int = CHUNK) -> DataFrame:
    """grp and shard for a table of groups (grp long, bytes long)."""
    level = saved(groups.select(F.col("grp").alias("child"), F.lit(0).alias("place"), "bytes"), "groups")
    count, maps = level.select("child").distinct().count(), []
    while True:
        chunks = max(1, -(-count // chunk))
        dealt = level.withColumn("chunk", F.pmod(F.xxhash64(F.col("child"), F.lit(len(maps))), F.lit(chunks)))
        done = dealt.groupBy("chunk").applyInPandas(_combine(shards), "chunk long, child long, place int, to int, sum long")
        done = saved(done, "differenced")
        maps.append(done.select("child", "place", "chunk", "to"))
        if chunks == 1:
            break
        level = done.groupBy(F.col("chunk").alias("child"), F.col("to").alias("place")).agg(F.first("sum").alias("bytes"))
        count = chunks
    out = maps[0].select(F.col("child").alias("grp"), F.col("chunk").alias("child"), F.col("to").alias("place"))
    for m in maps[1:]:
        out = out.join(m, ["child", "place"]).select("grp", F.col("chunk").alias("child"), F.col("to").alias("place"))
    return out.select("grp", F.col("place").alias("shard"))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents with size, text_crc32, shard and slot; null texts are empty.

    size is the UTF-8 length plus 8. Equal texts stay in one shard. slot numbers a shard's
    rows from 0 without a gap. All columns of ``docs`` are kept; columns of these names are
    replaced. Groups are told apart by a 64-bit hash; a collision only joins two groups.
    """
    own = ["size", "text_crc32", "shard", "slot", "grp", "_row"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop(*own)
    base = docs.withColumns({"size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(F.encode(text, "UTF-8")), "grp": F.xxhash64(text, F.octet_length(text))})
    groups = base.groupBy("grp").agg(F.sum("size").alias("bytes"))
    where = saved(balanced_groups(groups, shards), "group-shards")
    rows = where.count()
    placed = base.join(where, "grp")
    return with_positions(placed, ["shard"], ["doc_id", "grp"], "slot", position_blocks(rows)).select(*docs.columns, "size", "text_crc32", "shard", "slot")
