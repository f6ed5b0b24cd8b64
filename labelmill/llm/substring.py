"""Substring deduplication by relative Lempel-Ziv parsing against block indexes.

Every run of ``window`` words is looked up in an index of the whole corpus. The index is
cut into reference blocks: a window belongs to the block of its minimizer (the smallest
hash of the short seeds inside it), so equal windows meet in one block and neighbouring
windows travel as runs. A block knows the first occurrence of each window and turns the
windows of a document that occur earlier into factors (start, length, source document,
source start), growing each while source and text advance together. A document is then
parsed greedily from its factors of all blocks; the words between are literals. Because
a factor begins wherever a window has another source, windows across the boundary of two
factors are looked up like any other.

Nothing is sampled. A passage in a third of all documents stays small: each slice of a
task keeps one occurrence of a window for the index and passes its repeats through, dealt
over all blocks. Memory per task is one block, whose number follows the text's size.
"""

from __future__ import annotations

from itertools import compress
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelmill.llm import words as W
from labelmill.llm.steps import arrow_schema, block_count, bounded_batches, give_back, id_key, lean, lean_group, text_bytes

U = np.uint64
WINDOW, SEED = 20, 8
_POST, _POST_ARROW = arrow_schema({"block": "int", "known": "boolean", "doc": "binary", "pos": "binary", "len": "binary", "win": "binary", "src": "binary", "src_pos": "binary"})
_FACTOR = "_id long, pos binary, len binary, src binary, src_pos binary"


def _runs(step: np.ndarray) -> np.ndarray:
    """Starts of runs and the end, where ``step`` marks entries that begin a run."""
    return np.append(np.flatnonzero(step), len(step))


def _posts(batch: pa.RecordBatch, window: int, seed: int, blocks: int):
    """Index postings of one slice of documents, as rows per block."""
    w = W.words(batch.column("text"))
    ids = batch.column("_id").to_numpy(zero_copy_only=False)
    n = len(w.hash)
    if n < window:
        return
    doc = w.doc
    at = np.arange(n - window + 1)
    ok = at + window <= w.first[1:][doc[: n - window + 1]]
    low = W.moving(W.windows(w.hash, seed), window - seed + 1, np.minimum)
    keep = np.flatnonzero(ok)
    win, low, d = W.windows(w.hash, window)[keep], low[keep], doc[keep]
    pos = keep - w.first[:-1][d]
    # the first occurrence in this slice is posted, later ones are known repeats of it
    order = np.lexsort((pos, ids[d], win))
    head = np.ones(len(order), bool)
    head[1:] = win[order][1:] != win[order][:-1]
    first = order[head][np.cumsum(head) - 1]
    known = np.zeros(len(win), bool)
    source = np.empty(len(win), np.int64)
    source[order] = first
    known[order] = (ids[d[order]] != ids[d[first]]) | (pos[order] != pos[first])
    drop = ~known & (source != np.arange(len(win)))  # the same row given twice
    for is_known in (False, True):
        sel = np.flatnonzero(known if is_known else ~known & ~drop)
        if not len(sel):
            continue
        step = np.ones(len(sel), bool)
        same = (np.diff(sel) == 1) & (d[sel][1:] == d[sel][:-1]) & (np.diff(pos[sel]) == 1)
        s_id, s_pos = ids[d[source[sel]]], pos[source[sel]]
        if is_known:
            step[1:] = ~(same & (s_id[1:] == s_id[:-1]) & (np.diff(s_pos) == 1))
        else:
            step[1:] = ~(same & (low[sel][1:] == low[sel][:-1]))
        bound = _runs(step)
        lead = sel[bound[:-1]]
        block = W.spread(W.mix(ids[d[lead]].astype(U) ^ U(77)) if is_known else W.mix(low[lead]), blocks)
        by = np.argsort(block, kind="stable")
        cut = np.searchsorted(block[by], np.arange(blocks + 1))
        size = np.diff(bound)[by]
        lead = lead[by]
        if is_known:
            wins, wcut = np.zeros(0, U), np.zeros(blocks + 1, int)
            src, spos = s_id[bound[:-1]][by], s_pos[bound[:-1]][by]
        else:
            begin = np.concatenate(([0], np.cumsum(size)))
            wins = win[sel[np.repeat(bound[:-1][by] - begin[:-1], size) + np.arange(begin[-1])]]
            wcut = begin[cut]
            src = spos = np.zeros(0, np.int64)
        scut = cut if is_known else np.zeros(blocks + 1, int)
        cols = [W.packed(ids[d[lead]], cut), W.packed(pos[lead].astype(np.int32), cut), W.packed(size.astype(np.int32), cut), W.packed(wins, wcut), W.packed(src, scut), W.packed(spos.astype(np.int32), scut)]
        full = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), is_known)), *[pa.array([c[i] for i in full], pa.binary()) for c in cols]], schema=_POST_ARROW)


def _joined(pdf: pd.DataFrame, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[name]), kind)


def _by_doc(doc, pos, size, src, src_pos) -> pd.DataFrame:
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    cut = _runs(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(1, int)
    parts = [W.packed(x[order], cut) for x in (pos.astype(np.int32), size.astype(np.int32), src, src_pos.astype(np.int32))]
    return pd.DataFrame({"_id": doc[cut[:-1]], **dict(zip(("pos", "len", "src", "src_pos"), parts))})


def _block_factors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Factors of one reference block: windows that occur earlier, grown into runs."""
    told, posted = pdf[pdf["known"]], pdf[~pdf["known"]]
    out = [tuple(_joined(told, n, k) for n, k in (("doc", np.int64), ("pos", np.int32), ("len", np.int32), ("src", np.int64), ("src_pos", np.int32)))]
    size = _joined(posted, "len", np.int32)
    if len(size):
        doc, key = np.repeat(_joined(posted, "doc", np.int64), size), _joined(posted, "win", U)
        begin = np.cumsum(size) - size
        pos = np.repeat(_joined(posted, "pos", np.int32) - begin, size) + np.arange(len(key))
        order = np.argsort(key, kind="stable")
        k = key[order]
        twin = np.zeros(len(k), bool)
        twin[1:] = k[1:] == k[:-1]
        twin[:-1] |= twin[1:].copy()
        order = order[twin]
        order = order[np.lexsort((pos[order], doc[order], key[order]))]
        k = key[order]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        first = order[head][np.cumsum(head) - 1] if len(k) else order
        later = (doc[order] != doc[first]) | (pos[order] != pos[first])
        order, first = order[later], first[later]
        again = np.lexsort((pos[order], doc[order]))
        order, first = order[again], first[again]
        d, p, sd, sp = doc[order], pos[order], doc[first], pos[first]
        step = np.ones(len(d), bool)
        step[1:] = (d[1:] != d[:-1]) | (np.diff(p) != 1) | (sd[1:] != sd[:-1]) | (np.diff(sp) != 1)
        cut = _runs(step)
        out.append((d[cut[:-1]], p[cut[:-1]], np.diff(cut), sd[cut[:-1]], sp[cut[:-1]]))
    return _by_doc(*[np.concatenate(x) for x in zip(*out)])


def parse(pos: np.ndarray, size: np.ndarray, src: np.ndarray, src_pos: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, source document, source start) of one document.

    Of the factors that cover the next uncovered word the one that reaches farthest is
    taken; parts of one source that touch are one factor.
    """
    order = np.lexsort((-size, pos))
    out: list[list[int]] = []
    for a, n, s, t in zip(pos[order].tolist(), size[order].tolist(), src[order].tolist(), src_pos[order].tolist()):
        end = a + n + window - 1
        if out and end <= out[-1][0] + out[-1][1]:
            continue
        if out and out[-1][2] == s and out[-1][3] - out[-1][0] == t - a and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = end - out[-1][0]
        else:
            out.append([a, end - a, s, t])
    return [tuple(x) for x in out]


def block_factors(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per document and reference block: packed factors (start, windows, source, source start)."""
    blocks = block_count(text_bytes(docs))

    @lean
    def post(batches):
        for batch in batches:
            for part in W.slices(batch):
                yield from _posts(part, window, seed, blocks)

    posts = bounded_batches(docs).select(id_key().alias("_id"), F.col("text").cast("string")).mapInArrow(post, _POST)
    return posts.groupBy("block").applyInPandas(lean_group(_block_factors), _FACTOR)


def deduplicate(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Documents with the words removed that lie in a window which also starts earlier.

    "Earlier" is a smaller doc_id, or a smaller start in the same document; rows with the
    same doc_id count as one document, a null doc_id as the smallest. Words are runs of
    bytes other than ASCII white space. All windows are judged on the input. Adds n_words,
    n_removed, kept_text (the kept words joined by one space) and factors (array of start,
    n_words, source_doc, source_start). Null and empty texts have no words; extra columns
    are kept. Columns of these names in the input are replaced.
    """
    parts = ("pos", "len", "src", "src_pos")
    own = ("n_words", "n_removed", "kept_text", "factors", "_id", "_f")
    docs = docs.drop(*own)
    found = block_factors(docs, window, seed).groupBy("_id").agg(F.collect_list(F.struct(*parts)).alias("_f"))
    base = docs.withColumn("_id", id_key())
    joined = base.join(found, "_id", "left").drop("_id")
    schema = f"n_words long, n_removed long, kept_text string, factors array<struct<start:long,n_words:long,source_doc:long,source_start:long>>"

    def cut_batch(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, f in zip(text, found):
            tokens = (t or "").encode().split()
            factors = []
            if f is not None and len(f):
                got = [b"".join(x[p] for x in f) for p in parts]
                factors = parse(*[np.frombuffer(g, k) for g, k in zip(got, (np.int32, np.int32, np.int64, np.int32))], window)
            kept = tokens
            if factors:
                keep = np.ones(len(tokens), bool)
                for a, n, _, _ in factors:
                    keep[a : a + n] = False
                kept = list(compress(tokens, keep.tolist()))
            rows.append((len(tokens), len(tokens) - len(kept), b" ".join(kept).decode(), [dict(zip(("start", "n_words", "source_doc", "source_start"), x)) for x in factors]))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text", "factors"])

    @F.pandas_udf(f"struct<{schema.replace(' long', ':long').replace(' string', ':string').replace('factors array', 'factors:array')}>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, found in batches:
            yield cut_batch(text, found)
        give_back()

    return joined.withColumn("_c", cut(F.col("text").cast("string"), "_f")).select(*[c for c in docs.columns], "_c.*")


