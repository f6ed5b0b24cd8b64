"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

Documents are dealt, in the order they are read, into index blocks: for every term that
some item asks for, a list of the block's documents by falling impact, and for every
document its places in these lists. Only counts that need the whole corpus (documents,
terms, documents per asked term) are gathered before.

For an item a block's lists are read from their tops in step. Each document met is looked
up in all of the item's other lists by direct access, which gives its whole score and its
place in each list. A list's best position is the end of its unbroken run of places seen by
either way; no document that is still unseen can score more in that list than the entry
there. The sum over the lists bounds all unseen documents, and reading stops when it is
strictly below the k-th score so far, which may come from blocks before. What is skipped
can neither beat nor tie the k best.

Terms are 64-bit hashes of their bytes. Items are searched in batches of bounded vocabulary,
each batch with a pass over all documents.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelmill.llm import words as W
from labelmill.llm.steps import arrow_schema, bounded_batches, lean, saved

TOP = 10
#: Terms of items (with repeats between items) per batch of items; postings and documents
#: per index block; entries that are first read from each list at once.
BATCH_TERMS, BLOCK_POSTINGS, BLOCK_DOCS, FIRST_STEP = 200_000, 1 << 20, 1 << 15, 8
_LAST = (1 << 63) - 1

#: Terms are runs of digits, letters and bytes beyond ASCII.
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_TERMS, _TERMS_ARROW = arrow_schema({"k": "long", "terms": "array<long>", "size": "long"})
_INDEX, _INDEX_ARROW = arrow_schema({"docs": "long", "n_docs": "long", "n_terms": "long", "ids": "binary", "sizes": "binary", "terms": "binary", "counts": "binary", "doc": "binary", "tf": "binary"})


def item_terms(items: DataFrame) -> DataFrame:
    """k, the distinct terms of its text as hashes, and their number."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = W.words(batch.column("text"), lower=True, separators=SEPARATORS)
            terms = [np.unique(w.hash[a:b]).view(np.int64) for a, b in zip(w.first[:-1], w.first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(terms, pa.list_(pa.int64())), pa.array([len(t) for t in terms], pa.int64())], schema=_TERMS_ARROW)

    return bounded_batches(items).select("k", "text").mapInArrow(run, _TERMS)


def index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Index blocks over (ord, text) of all documents for a sorted vocabulary of hashes."""

    def block(parts: list[tuple]) -> pa.RecordBatch:
        begin = np.cumsum([0, *(len(p[0]) for p in parts)])
        ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        term, tf = np.concatenate([p[2] for p in parts]), np.concatenate([p[4] for p in parts])
        doc = np.concatenate([p[3] + b for p, b in zip(parts, begin)])
        order = np.argsort(term, kind="stable")
        terms, counts = np.unique(term, return_counts=True)
        row = [len(ids), int((sizes > 0).sum()), int(sizes.sum()), ids.tobytes(), sizes.tobytes(), terms.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()]
        row += [doc[order].astype(np.int32).tobytes(), tf[order].astype(np.int32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _INDEX_ARROW)], schema=_INDEX_ARROW)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, postings, held = [], 0, 0
        for batch in batches:
            for part in W.slices(batch):
                w = W.words(part.column("text"), lower=True, separators=SEPARATORS)
                slot = np.searchsorted(vocabulary, w.hash)
                hit = vocabulary[np.minimum(slot, len(vocabulary) - 1)] == w.hash
                code, tf = np.unique(slot[hit] * part.num_rows + w.doc[hit], return_counts=True)
                parts.append((part.column("ord").to_numpy(), w.counts.astype(np.int64), code // part.num_rows, code % part.num_rows, tf))
                postings, held = postings + len(code), held + part.num_rows
                if postings >= BLOCK_POSTINGS or held >= BLOCK_DOCS:
                    yield block(parts)
                    parts, postings, held = [], 0, 0
        if parts:
            yield block(parts)

    return bounded_batches(docs).select("ord", "text").mapInArrow(run, _INDEX)


def document_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term: summed in the tasks, then over them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for pdf in batches:
            for t, n in zip(pdf["terms"], pdf["counts"]):
                total[np.frombuffer(t, np.int32)] += np.frombuffer(n, np.int32)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"t": at, "n": total[at]})

    found = blocks.select("terms", "counts").mapInPandas(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["t"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


class Block:
    """The lists of one index block by falling impact, and the places of each document."""

    def __init__(self, row, docs: int, terms: int):
        get = lambda name, kind: np.frombuffer(getattr(row, name), kind)
        self.ids, sizes, self.terms = get("ids", np.int64), get("sizes", np.int64), get("terms", np.int32)
        counts, doc, tf = get("counts", np.int32), get("doc", np.int32).astype(np.int64), get("tf", np.int32).astype(np.int64)
        m = 100 - 90 + (90 * sizes * docs) // max(terms, 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        self.start = np.concatenate(([0], np.cumsum(counts)))
        term = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((-impact, term))
        self.term, self.doc, self.impact = term, doc[order], impact[order]
        self.places = np.argsort(self.doc, kind="stable")
        self.place_start = np.searchsorted(self.doc[self.places], np.arange(len(self.ids) + 1))


class Best:
    """The k best documents of one item so far: higher scores, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.kth = k, 0
        self.score = self.ids = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = (score > 0) & (score >= self.kth)
        if good.any():
            score, ids = np.concatenate((self.score, score[good])), np.concatenate((self.ids, ids[good]))
            order = np.lexsort((ids, -score))[: self.k]
            self.score, self.ids = score[order], ids[order]
            self.kth = int(self.score[-1]) if len(self.score) == self.k else 0


def search(block: Block, lists: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Run one item over a block; ``lists`` are its terms' numbers in the block. Returns how
    many entries were read in sorted order."""
    begin, size = block.start[lists], block.start[lists + 1] - block.start[lists]
    weight_of = np.zeros(len(block.terms), np.int64)
    weight_of[lists] = weights
    asked = np.zeros(len(block.terms), bool)
    asked[lists] = True
    seen = np.zeros(len(block.ids), bool)
    passed = np.zeros(len(block.doc), bool)
    position, depth, step, read = np.zeros(len(lists), np.int64), 0, FIRST_STEP, 0
    while True:
        some = np.flatnonzero(size > depth)
        if not len(some):
            return read
        span = np.minimum(size[some] - depth, step)
        at = np.repeat(begin[some] + depth - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(int(span.sum()))
        read += len(at)
        docs = np.unique(block.doc[at])
        docs = docs[~seen[docs]]
        seen[docs] = True
        if len(docs):  # direct accesses: all places of the new documents
            held = block.place_start[docs + 1] - block.place_start[docs]
            which = np.repeat(np.arange(len(docs)), held)
            place = block.places[np.repeat(block.place_start[docs] - np.concatenate(([0], np.cumsum(held)[:-1])), held) + np.arange(int(held.sum()))]
            mine = asked[block.term[place]]
            which, place = which[mine], place[mine]
            passed[place] = True
            score = np.zeros(len(docs), np.int64)
            np.add.at(score, which, weight_of[block.term[place]] * block.impact[place])
            best.add(score, block.ids[docs])
        depth += step
        step *= 2
        bound = 0
        for i, (a, n) in enumerate(zip(begin, size)):
            if position[i] < n:
                rest = passed[a + position[i] : a + n]
                run = int(rest.argmin())
                position[i] += len(rest) if rest[run] else run
                if position[i] < n:
                    bound += int(weights[i]) * int(block.impact[a + max(position[i] - 1, 0)])
        if bound < best.kth or (position == size).all():
            return read


def _weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(n) + 1))) if n else 0 for n in df], np.int64)


def _search_all(blocks: DataFrame, items: dict[int, np.ndarray], weights: np.ndarray, docs: int, terms: int, k: int) -> DataFrame:
    """(k, ord, score): the best documents of each item in each task."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {i: Best(k) for i in items}
        for pdf in batches:
            for row in pdf.itertuples():
                block = Block(row, docs, terms)
                number = np.full(len(weights), -1, np.int64)
                number[block.terms] = np.arange(len(block.terms))
                for i, slots in items.items():
                    here = slots[number[slots] >= 0]
                    here = here[weights[here] > 0]
                    if len(here):
                        search(block, number[here], weights[here], best[i])
        for i, b in best.items():
            if len(b.ids):
                yield pd.DataFrame({"k": i, "ord": b.ids, "score": b.score})

    return blocks.mapInPandas(run, "k long, ord long, score long")


def rank(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score of each item's k best documents.

    Scores above 0 count; equal ones go by smaller doc_id, null ids last. Null and empty
    texts have no terms: such documents are never found, such items find nothing. An item's
    term counts once. Repeated rows of documents or items are rows of their own. Numbers
    are 64-bit integers. Other columns than doc_id, item_id and text are not read.
    """
    spark = documents.sparkSession
    named = saved(items.select(F.monotonically_increasing_id().alias("k"), "item_id", "text"), "items")
    asked = saved(item_terms(named).filter("size > 0"), "item-terms")
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"), "text")
    total = asked.agg(F.sum("size")).first()[0] or 0
    batches = -(-total // BATCH_TERMS)
    found = None
    for batch in range(batches):
        rows = asked.filter(F.pmod(F.xxhash64("k"), F.lit(batches)) == batch).select("k", "terms").collect()  # bounded: BATCH_TERMS terms on average
        if not rows:
            continue
        each = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
        vocabulary = np.unique(np.concatenate(each))
        blocks = saved(index(docs, vocabulary), "index-blocks")
        n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        weights = _weights(document_counts(blocks, len(vocabulary)), n_docs)
        places = {r["k"]: np.searchsorted(vocabulary, t) for r, t in zip(rows, each)}
        part = _search_all(blocks.select("ids", "sizes", "terms", "counts", "doc", "tf"), places, weights, n_docs, n_terms, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "k long, ord long, score long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), "ord"))).filter(F.col("rank") <= k)
    return best.join(named.select("k", "item_id"), "k").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("ord") != _LAST, F.col("ord")).alias("doc_id"), "score")
