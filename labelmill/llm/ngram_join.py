"""N-gram Jaccard self-join as a blocked sparse matrix product.

The matrix has a row per distinct shingle set and a column per shingle; entry counts of
its product with its transpose are overlaps. Columns are dealt into blocks by hash. A
first pass looks at half of the columns, by hash, and counts for every row how many of
those it has alone. Nobody can link with a row that has n - ceil(t * n) + 1 columns alone,
of its n, at a threshold of t; the others go on, through a bitmap of their texts' hashes
that may let a few more in but leaves none out. For those the second pass counts each
column's entries, which lets every row drop the
columns that it has alone and order the others from rare to frequent. A pair with a
Jaccard similarity of at least t shares one of the first n - ceil(t * n) + 1 columns of
either row in that order, so only this part of the matrix is multiplied; rows whose part
holds no shared column are done. Products accumulate the counts per pair and discard
pairs below the bounds that the sizes and positions set; the rest is counted in full.

Rows that are alike share many columns, and a group of them would yield all its pairs.
The product therefore runs twice: each column first pairs its rows only with the row that
has the least columns alone, which joins a group of near copies in linear time; then
columns whose rows still lie in several components yield the pairs between components. What is skipped can't
change a component. Equal sets are one row from the start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelmill.llm import words as W
from labelmill.llm.graph import components
from labelmill.llm.steps import BLOCK_BYTES, arrow_schema, block_count, bounded_batches, discard, lean, lean_group, saved, text_bytes

U = np.uint64
SHINGLE, PERCENT = 5, 80
#: Text bytes per bucket of documents, to which a block replies with one row.
BUCKET_BYTES = 1 << 20
#: A column with so many entries in one slice of a task counts as frequent without a count.
HOT_IN_SLICE = 64
#: One column in so many is looked at first, and so many entries of those make one posting.
SAMPLE, SAMPLE_ENTRIES = 2, 1 << 20
#: Bits of a set's place in a posting of the first pass, and so many sets make one as well.
_PLACE_BITS = U(18)
_PLACES, SAMPLE_SETS = (U(1) << _PLACE_BITS) - U(1), 1 << 17
#: Bits of the map of texts that go on: for each of them, and at most (4 MB).
BITS_EACH, BITS_MOST = 16, 1 << 25
_LOW48 = U((1 << 48) - 1)
_SETS, _SETS_ARROW = arrow_schema({"doc_id": "long", "row": "long", "n_shingles": "long", "n_sampled": "long", "cls": "long"})
_SEEN, _SEEN_ARROW = arrow_schema({"block": "int", "set": "binary", "count": "binary", "column": "binary", "shared": "binary", "told": "binary", "told_count": "binary"})
_FIRST, _FIRST_ARROW = f"{_SETS}, {_SEEN}", pa.schema([*_SETS_ARROW, *_SEEN_ARROW])
_POST, _POST_ARROW = arrow_schema({"block": "int", "cls": "binary", "size": "binary", "count": "binary", "low": "binary", "high": "binary", "told": "boolean"})
_ROW, _ROW_ARROW = arrow_schema({"cls": "long", "n": "long", "shared": "array<long>", "part": "array<long>", "first_pos": "long", "last": "long", "bits": "binary"})


def shingle_sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, bounds of each text's sorted distinct ones, set fingerprints)."""
    w = W.words(batch.column("text"), lower=True)
    counts = w.counts
    short = (counts > 0) & (counts < size)
    n = np.maximum(counts - size + 1, 0) + short
    at = np.append(0, np.cumsum(n))
    h = np.empty(at[-1], U)
    if len(w.hash) >= size:
        inside = np.arange(size, len(w.hash) + 1) <= np.repeat(w.first[1:], counts)[: len(w.hash) - size + 1]
        h[np.repeat(~short, n)] = W.windows(w.hash, size)[inside]
    for i in np.flatnonzero(short):
        h[at[i]] = W.whole(w.hash[w.first[i] : w.first[i + 1]])
    for a, b in zip(at[:-1][n > 1], at[1:][n > 1]):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][n > 0]] = True
    bounds = np.append(0, np.cumsum(new))[at]
    h = h[new]
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(W.mix(h ^ U(0x5DEECE66D)), out=sums[1:])
    return h, bounds, W.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U))


def _in_sample(h: np.ndarray) -> np.ndarray:
    return h % U(SAMPLE) == 0


def _sampled(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_sample`` of the texts of a batch."""
    return _sample(*shingle_sets(batch, size))


def _sample(h: np.ndarray, bounds: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries in sampled columns, how many each set has, sets) of one slice; sets without
    any are left out."""
    at = _in_sample(h)
    n = np.diff(np.append(0, np.cumsum(at))[bounds])
    return h[at], n[n > 0], cls[n > 0]


def _seen(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], blocks: int) -> pa.RecordBatch:
    """One posting of sampled entries: a row per column block.

    Of a column that several of these sets have, the block is told only that it is shared,
    and each set's count of such columns goes along as one number. So a block gets a column
    at most once from a posting, however frequent it is. An entry is sorted as one number,
    of its column's first 46 bits and its set's place here; a block tells columns apart by
    32 bits. Columns that are taken for one make a count too high, never too low.
    """
    g, n, cls = (np.concatenate(x) for x in zip(*parts))
    once = np.zeros(len(cls), bool)
    once[np.unique(cls, return_index=True)[1]] = True
    g, n, cls = g[np.repeat(once, n)], n[once], cls[once]
    key = (g & ~_PLACES) | np.repeat(np.arange(len(cls), dtype=U), n)
    key.sort()
    head = _runs(key >> _PLACE_BITS)
    times = np.diff(head)
    shared, many = key[head[:-1]][times > 1], np.repeat(times > 1, times)
    told, told_count = np.unique(key[many] & _PLACES, return_counts=True)
    key = key[~many]
    cut, shared_cut = (np.searchsorted(W.spread(x, blocks), np.arange(blocks + 1)) for x in (key, shared))
    key = ((key & _PLACES) << U(32)) | _column(key)
    for a, b in zip(cut[:-1], cut[1:]):
        key[a:b].sort()
    place, block = key >> U(32), np.repeat(np.arange(blocks), np.diff(cut))
    step = np.ones(len(key), bool)
    step[1:] = (block[1:] != block[:-1]) | (place[1:] != place[:-1])
    run = np.append(np.flatnonzero(step), len(key))
    lead = np.flatnonzero((np.arange(len(key)) - np.repeat(run[:-1], np.diff(run))) % 255 == 0)  # counts fit a byte
    lead_cut, told_cut = np.searchsorted(lead, cut), np.linspace(0, len(told), blocks + 1).astype(int)
    cols = [W.packed(cls[place[lead]], lead_cut), W.packed(np.diff(np.append(lead, len(key))).astype(np.uint8), lead_cut)]
    cols += [W.packed(key.astype(np.uint32), cut), W.packed(_column(shared).astype(np.uint32), shared_cut)]
    cols += [W.packed(cls[told], told_cut), W.packed(told_count.astype(np.int32), told_cut)]
    full = np.flatnonzero(np.diff(cut) + np.diff(shared_cut) + np.diff(told_cut))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array([c[i] for i in full], pa.binary()) for c in cols]], schema=_SEEN_ARROW)


def _column(g: np.ndarray) -> np.ndarray:
    """What tells columns apart within a block of the first pass."""
    return (g >> _PLACE_BITS) & U((1 << 32) - 1)


def _shared_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """cls and how many of its entries, in one block or told, lie in shared columns."""
    cls, place = np.unique(_join(pdf, "set", U), return_inverse=True)
    key = (_join(pdf, "column", np.uint32).astype(U) << U(32)) | np.repeat(place, _join(pdf, "count", np.uint8)).astype(U)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    head = _runs(key >> U(32))
    times, column = np.diff(head), key[head[:-1]] >> U(32)
    shared = np.repeat((times > 1) | np.isin(column, _join(pdf, "shared", np.uint32).astype(U)), times)
    count = np.bincount((key[shared] & U((1 << 32) - 1)).astype(int), minlength=len(cls))
    cls, count = np.append(cls[count > 0], _join(pdf, "told", U)), np.append(count[count > 0], _join(pdf, "told_count", np.int32))
    return pd.DataFrame({"cls": cls.view(np.int64), "shared": count.astype(np.int64)})


def first_pass(docs: DataFrame, size: int = SHINGLE, blocks: int = 0) -> DataFrame:
    """What one pass over the texts gives, in one table: the rows of ``document_sets``, and
    postings of sampled entries if there are ``blocks`` to send them to. Only postings have
    a block."""

    @lean
    def run(batches):
        parts, entries, sets = [], 0, 0
        for batch in batches:
            for part in W.slices(batch):
                h, bounds, cls = shingle_sets(part, size)
                sampled = np.append(0, np.cumsum(_in_sample(h)))[bounds]
                yield _padded(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(np.diff(bounds), pa.int64()), pa.array(np.diff(sampled), pa.int64()), pa.array(cls.view(np.int64))], schema=_SETS_ARROW), _FIRST_ARROW)
                if not blocks:
                    continue
                parts.append(_sample(h, bounds, cls))
                entries, sets = entries + len(parts[-1][0]), sets + len(parts[-1][2])
                if entries >= SAMPLE_ENTRIES or sets >= SAMPLE_SETS:
                    yield _padded(_seen(parts, blocks), _FIRST_ARROW)
                    parts, entries, sets = [], 0, 0
        if entries:
            yield _padded(_seen(parts, blocks), _FIRST_ARROW)

    text = F.col("text").cast("string")
    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row"), text.alias("text")).mapInArrow(run, _FIRST)


def _padded(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The same rows with nulls in the columns that they lack."""
    own = set(batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in own else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def _sets_of(first: DataFrame) -> DataFrame:
    return first.filter("block is null").select(*_SETS_ARROW.names)


def document_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, n_sampled (those in sampled columns)
    and cls, the fingerprint of the set."""
    return _sets_of(first_pass(docs, size))


def _candidates(first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``may_link`` from the postings of the first pass."""
    entries = first.filter("block is not null").select(*_SEEN_ARROW.names)
    shared = entries.groupBy("block").applyInPandas(lean_group(_shared_counts), "cls long, shared long").groupBy("cls").agg(F.sum("shared").alias("shared"))
    alone = F.col("n_sampled") - F.coalesce("shared", F.lit(0))
    least = F.expr(f"({percent} * n_shingles + 99) div 100")
    texts = sets.filter("n_shingles > 0").groupBy("row", "cls", "n_shingles", "n_sampled").agg(F.sum("n_shingles").alias("n"))
    return texts.join(shared, "cls", "left").filter(alone < F.col("n_shingles") - least + 1).select("row", "n")


def may_link(docs: DataFrame, sets: DataFrame, total: int, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """row of the texts that may have a partner, from ``document_sets``, and the shingles of
    all documents with this text. ``total`` are the bytes of all texts.

    Left out is who has so many sampled columns alone that the rest is below the threshold
    with anyone. Where a count is too high (a set that is repeated), more go on.
    """
    return _candidates(first_pass(docs, size, _sample_blocks(total)), sets, percent)


def _sample_blocks(total: int) -> int:
    return block_count(total, SAMPLE * BLOCK_BYTES)


def _row_bits(chosen: DataFrame) -> np.ndarray:
    """A bitmap of the rows of ``chosen`` by the low bits of their hash."""
    bits, least = 1 << 15, BITS_EACH * chosen.count()
    while bits < BITS_MOST and bits < least:
        bits *= 2
    at = F.pmod("row", F.lit(bits)) + 1  # Spark's bitmaps count from 1
    pages = chosen.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for x in pages:
        out[(x.page - 1) << 12 : x.page << 12] = np.frombuffer(x.bits, np.uint8)
    return out


def _has(row: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = row.view(U) & U(8 * len(bits) - 1)
    return (bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def _having(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(_has(batch.column("row").to_numpy(), bits)))


def _one_batch(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _posts(batch: pa.RecordBatch, size: int, blocks: int):
    """Matrix entries of one slice, packed per column block."""
    h, bounds, cls = shingle_sets(batch, size)
    n = np.diff(bounds)
    _, once = np.unique(cls, return_index=True)
    once = once[n[once] > 0]
    if not len(once):
        return
    doc = np.repeat(np.arange(len(n)), n)
    keep = np.zeros(len(n), bool)
    keep[once] = True
    sel = keep[doc]
    h, doc = h[sel], doc[sel]
    hs = np.sort(h)
    head = _runs(hs)
    marks = hs[head[:-1]][np.diff(head) >= HOT_IN_SLICE]
    hot = np.isin(h, marks) if len(marks) else np.zeros(len(h), bool)
    for told in (False, True):
        pick = np.flatnonzero(hot == told)
        g, d = h[pick], doc[pick]
        block = W.spread(g, blocks)
        by = np.argsort(block, kind="stable")  # d is in order
        g, d, block = g[by], d[by], block[by]
        # known frequent columns need no count: their entries go back by way of any block
        to = (block + d) % blocks if told else block
        if told:
            by = np.lexsort((block, d, to))
            g, d, block, to = g[by], d[by], block[by], to[by]
        step = np.ones(len(g), bool)
        step[1:] = (to[1:] != to[:-1]) | (d[1:] != d[:-1]) | (block[1:] != block[:-1])
        run = np.append(np.flatnonzero(step), len(g))
        cut = np.searchsorted(to, np.arange(blocks + 1))
        rcut = np.searchsorted(run[:-1], cut)
        lead = run[:-1]
        cols = [W.packed(cls[d[lead]], rcut), W.packed(n[d[lead]].astype(np.int32), rcut)]
        if told:  # size, count and then the column's own block
            cols.append(W.packed(np.stack([np.diff(run), block[lead]], 1).astype(np.int32), rcut))
        else:
            cols.append(W.packed(np.diff(run).astype(np.int32), rcut))
        cols += [W.packed(g.astype(np.uint32), cut), W.packed((g >> U(32)).astype(np.uint16), cut)]
        full = np.flatnonzero(np.diff(cut))
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array([c[i] for i in full], pa.binary()) for c in cols], pa.array(np.full(len(full), told))], schema=_POST_ARROW)
    if len(marks):  # tells the block that a column is frequent
        block = W.spread(marks, blocks)
        by = np.argsort(block, kind="stable")
        marks, block = marks[by], block[by]
        for b in np.unique(block):
            g = marks[block == b]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([g.astype(np.uint32).tobytes()], pa.binary()), pa.array([(g >> U(32)).astype(np.uint16).tobytes()], pa.binary()), pa.array([False])], schema=_POST_ARROW)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.append(np.flatnonzero(new), len(sorted_values))


def _join(pdf: pd.DataFrame, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[name]), kind)


def _grams(pdf: pd.DataFrame) -> np.ndarray:
    return _join(pdf, "low", np.uint32).astype(U) | (_join(pdf, "high", np.uint16).astype(U) << U(32))


_REPLY = "bucket int, block int, cls binary, size binary, count binary, low binary, high binary, df binary"


def _replies(cls, n, block, g, df, buckets: int) -> pd.DataFrame:
    """A row per bucket of documents and block; inside, a run of entries per document."""
    bucket = W.spread(cls, buckets)
    order = np.lexsort((cls, block, bucket))
    bucket, cls, n, block, g, df = (x[order] for x in (bucket, cls, n, block, g, df))
    step = np.ones(len(cls), bool)
    step[1:] = (cls[1:] != cls[:-1]) | (block[1:] != block[:-1])
    cut = np.append(np.flatnonzero(step), len(cls))
    lead = cut[:-1]
    row = np.ones(len(lead), bool)
    row[1:] = (bucket[lead][1:] != bucket[lead][:-1]) | (block[lead][1:] != block[lead][:-1])
    runs = np.append(np.flatnonzero(row), len(lead))
    first, bounds = lead[runs[:-1]], cut[runs]
    out = {"bucket": bucket[first].astype(np.int32), "block": block[first].astype(np.int32)}
    out |= {k: W.packed(x, runs) for k, x in (("cls", cls[lead]), ("size", n[lead].astype(np.int32)), ("count", np.diff(cut).astype(np.int32)))}
    out |= {k: W.packed(x, bounds) for k, x in (("low", g.astype(np.uint32)), ("high", (g >> U(32)).astype(np.uint16)), ("df", df))}
    return pd.DataFrame(out)


def _block_counts(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Entries of the columns of one block that more than one row has, with a rank of
    how frequent the column is (255: very)."""
    b = int(pdf["block"].iloc[0])
    own, told = pdf[(~pdf["told"]) & (pdf["cls"].str.len() > 0)], pdf[pdf["told"]]
    marked = np.unique(_grams(pdf[(~pdf["told"]) & (pdf["cls"].str.len() == 0)]))
    parts = []
    count = _join(own, "count", np.int32)
    cls, n, g = np.repeat(_join(own, "cls", U), count), np.repeat(_join(own, "size", np.int32), count), _grams(own)
    order = np.argsort(g)
    head = _runs(g[order])
    times = np.repeat(np.diff(head), np.diff(head))
    hot = np.isin(g[order], marked)
    order = order[(times > 1) | hot]
    order = order[np.lexsort((cls[order], g[order]))]
    if len(order):
        gs, cs = g[order], cls[order]
        new = np.ones(len(gs), bool)
        new[1:] = (gs[1:] != gs[:-1]) | (cs[1:] != cs[:-1])
        order = order[new]
        head = _runs(g[order])
        times = np.repeat(np.diff(head), np.diff(head))
        hot = np.isin(g[order], marked)
        keep = (times > 1) | hot
        order, times, hot = order[keep], times[keep], hot[keep]
        rank = np.where(hot, 255, np.minimum(254, np.log2(np.maximum(times, 1)) * 8)).astype(np.uint8)
        parts.append((cls[order], n[order], np.full(len(order), b), g[order], rank))
    if len(told):
        pair = _join(told, "count", np.int32).reshape(-1, 2)
        count = pair[:, 0]
        g = _grams(told)
        parts.append((np.repeat(_join(told, "cls", U), count), np.repeat(_join(told, "size", np.int32), count), np.repeat(pair[:, 1], count), g, np.full(len(g), 255, np.uint8)))
    if not parts:
        return pd.DataFrame({c.split()[0]: [] for c in _REPLY.split(", ")})
    return _replies(*[np.concatenate(x) for x in zip(*parts)], buckets)


#: Bits of a row's column signature: at least four per column up to this many.
MOST_BITS = 4096


def column_bits(columns: np.ndarray) -> bytes:
    """A bit set by column hash, of a power of two so that longer ones fold into shorter."""
    size = 64
    while size < MOST_BITS and size < 4 * len(columns):
        size *= 2
    out = np.zeros(size, np.uint8)
    out[(columns % U(size)).astype(int)] = 1
    return np.packbits(out).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Signatures, which have ``size`` bytes or more, as rows of words of that many bytes in all."""
    out, length = np.empty((len(bits), size // 8), U), np.array([len(x) for x in bits])
    for n in np.unique(length):
        rows = np.frombuffer(b"".join(bits[length == n]), U).reshape(-1, n // size, size // 8)
        out[length == n] = np.bitwise_or.reduce(rows, axis=1)
    return out


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _document_rows(got: list[dict], percent: int):
    """Rows of the matrix from all replies to one bucket of documents."""
    joined = lambda name, kind: np.frombuffer(b"".join(x[name] for x in got), kind)
    count = joined("count", np.int32)
    entries = [len(x["df"]) for x in got]
    cls, size = np.repeat(joined("cls", U), count), np.repeat(joined("size", np.int32), count)
    g = joined("low", np.uint32).astype(U) | (joined("high", np.uint16).astype(U) << U(32))
    g = W.mix(g) ^ W.mix(np.repeat(np.array([x["block"] for x in got], U), entries) ^ U(0xB10C))
    rank = joined("df", np.uint8)
    by = np.lexsort((g, cls))
    cls, size, g, rank = (x[by] for x in (cls, size, g, rank))
    new = np.ones(len(g), bool)  # copies in several slices answer more than once
    new[1:] = (g[1:] != g[:-1]) | (cls[1:] != cls[:-1])
    cls, size, g, rank = (x[new] for x in (cls, size, g, rank))
    cut = _runs(cls)
    for a, b in zip(cut[:-1], cut[1:]):
        n, own, ranks = int(size[a]), g[a:b], rank[a:b]
        alone, part = n - len(own), n - _least_overlap(n, percent) + 1
        if alone < part:
            at = np.lexsort((own >> U(8), ranks))[: part - alone]
            lead, last = own[at], (int(ranks[at[-1]]) << 55) | (int(own[at[-1]]) >> 9)
            yield cls[a].view(np.int64), n, own.view(np.int64), lead.view(np.int64), alone, last, column_bits(lead)


def matrix_rows(docs: DataFrame, chosen: DataFrame, all_shingles: int, total: int, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows that may have a partner: cls, n, shared columns, the part to multiply in
    order from rare to frequent, and the position of that part's first column. ``chosen``
    is a written table of ``may_link``, ``all_shingles`` the count of every text."""
    bits, n = _row_bits(chosen), chosen.agg(F.sum("n")).first()[0] or 0
    total = total * n // max(1, all_shingles)
    blocks, buckets = block_count(total), block_count(total, BUCKET_BYTES)

    @lean
    def post(batches):
        held, size_held = [], 0
        for batch in batches:
            for part in W.slices(_having(batch, bits)):
                held.append(part)
                size_held += part.nbytes
                if size_held >= W.SLICE_BYTES:
                    yield from _posts(_one_batch(held), size, blocks)
                    held, size_held = [], 0
        if held:
            yield from _posts(_one_batch(held), size, blocks)

    text = F.col("text").cast("string")
    entries = bounded_batches(docs).select(text.alias("text"), F.xxhash64(text).alias("row")).mapInArrow(post, _POST)
    replies = entries.groupBy("block").applyInPandas(lean_group(lambda pdf: _block_counts(pdf, buckets)), _REPLY)
    whole = replies.groupBy("bucket").agg(F.collect_list(F.struct("block", "cls", "size", "count", "low", "high", "df")).alias("got")).select("got")

    @lean
    def order(batches):
        for batch in batches:
            for got in batch.column("got"):
                out = list(_document_rows(got.as_py(), percent))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _ROW_ARROW)], schema=_ROW_ARROW)

    return whole.mapInArrow(order, _ROW)


def _bounded(x, y, percent: int):
    """SQL for: sizes and positions allow the threshold if this is the first shared column."""
    need = f"ceil({percent} * ({x}n + {y}n) / {100 + percent})"
    reach = f"1 + least({x}n - 1 - {x}pos, {y}n - 1 - {y}pos)"
    return f"100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n) and {reach} >= {need}"


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole rows overlap enough."""
    one = rows.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("shared").alias("ag"))
    two = rows.select(F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("shared").alias("bg"))
    both = F.size(F.array_intersect("ag", "bg"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.filter(100 * both >= percent * (F.col("an") + F.col("bn") - both)).select("a", "b")


#: Pairs that are looked at at once, and those whose signatures are compared at once.
_PAIRS, _SIGNED = 1 << 19, 1 << 15


def _cross_pairs(percent: int):
    """Pairs of a column whose components differ, for all columns of a group.

    A pair is needed once, at its first shared column, so the position bound is that of a
    first column. Of the row whose part ends earlier, every column of the part that the
    other part lacks is missing in the whole other row; the signatures count such columns
    from below, and pairs with more of them than the sizes allow are discarded.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, at, row = np.unique(pdf["cls"].to_numpy(), return_index=True, return_inverse=True)
        n, root, alone, last, bits = (pdf[x].to_numpy()[at] for x in ("n", "root", "first_pos", "last", "bits"))
        length = np.array([len(x) for x in bits])
        pos = pdf["pos"].to_numpy()
        column = np.unique(pdf["g"].to_numpy(), return_inverse=True)[1]
        found = np.zeros(0, np.int64)
        for x, y, px, py in _column_pairs(column, row, pos, n, root, percent):
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            ok = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            ok &= 1 + np.minimum(n[x] - 1 - px, n[y] - 1 - py) >= need
            pair = np.unique(np.minimum(x, y)[ok] * len(cls) + np.maximum(x, y)[ok])
            x, y = pair // len(cls), pair % len(cls)
            need, keep = -(-percent * (n[x] + n[y]) // (100 + percent)), np.zeros(len(pair), bool)
            shorter = np.minimum(length[x], length[y])
            for size in np.unique(shorter):
                use = np.unique(np.concatenate((x[shorter == size], y[shorter == size])))
                signs = _folded(bits[use], size)
                ones = np.bitwise_count(signs).sum(1, dtype=np.int64)
                of = np.flatnonzero(shorter == size)
                for i in range(0, len(of), _SIGNED):
                    k = of[i : i + _SIGNED]
                    a, b = np.searchsorted(use, x[k]), np.searchsorted(use, y[k])
                    both = np.bitwise_count(signs[a] & signs[b]).sum(1, dtype=np.int64)
                    far_x = alone[x[k]] + ones[a] - both > n[x[k]] - need[k]
                    far_y = alone[y[k]] + ones[b] - both > n[y[k]] - need[k]
                    keep[k] = ~((last[x[k]] <= last[y[k]]) & far_x) & ~((last[x[k]] >= last[y[k]]) & far_y)
            found = np.union1d(found, pair[keep])
        a, b = cls[found // max(1, len(cls))], cls[found % max(1, len(cls))]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _column_pairs(column, row, pos, n, root, percent: int):
    """Batches (x, y, position of x, of y) of the pairs of rows in each column.

    A column's rows are ordered either by size, and each is paired with those after it that
    are not too large, or by component, and each is paired with those of later components:
    whichever makes fewer pairs. So a column whose rows are nearly all of one component
    costs about as many pairs as it has rows, and one of very many sizes few for each.
    """

    def reach(order, first, end):
        """Per entry of an order where its partners begin and end, and of its column the count."""
        return end, np.bincount(column[order], (end - first).astype(float), minlength=column.max(initial=-1) + 1)

    here = np.arange(len(column))
    by_size = np.lexsort((n[row], column))
    span = np.int64(1) << 33
    size_key = column[by_size] * span + n[row[by_size]]
    size_first = here + 1
    size_end, size_cost = reach(by_size, size_first, np.searchsorted(size_key, column[by_size] * span + 100 * n[row[by_size]] // percent, "right"))
    by_root = np.lexsort((root[row], column))
    c, r = column[by_root], root[row[by_root]]
    column_cut = _runs(c)
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
    root_cut = np.append(np.flatnonzero(new), len(c))
    root_first = np.repeat(root_cut[1:], np.diff(root_cut))
    root_end, root_cost = reach(by_root, root_first, np.repeat(column_cut[1:], np.diff(column_cut)))
    better = size_cost <= root_cost
    for order, first, end, take in ((by_size, size_first, size_end, better), (by_root, root_first, root_end, ~better)):
        use = np.flatnonzero(take[column[order]] & (end > first))
        count = (end - first)[use]
        total = np.append(0, np.cumsum(count))
        i = 0
        while i < len(use):
            j = max(i + 1, int(np.searchsorted(total, total[i] + _PAIRS, "right")) - 1)
            k = count[i:j]
            x = np.repeat(use[i:j], k)
            y = np.repeat(first[use[i:j]], k) + np.arange(len(x)) - np.repeat(total[i:j] - total[i], k)
            x, y = order[x], order[y]
            yield row[x], row[y], pos[x], pos[y]
            i = j


def link_rows(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between rows that give the components of the Jaccard join."""
    spark = rows.sparkSession
    entry = rows.select("cls", "n", F.posexplode("part").alias("i", "g"), "first_pos").select("g", "cls", "n", "first_pos", (F.col("i") + F.col("first_pos")).alias("pos"))
    centre = entry.groupBy("g").agg(F.min(F.struct((F.col("first_pos") / F.col("n")).alias("alone"), "n", "cls", "pos")).alias("c"), F.count("*").alias("k")).filter("k > 1")
    star = entry.join(centre, "g").select("g", "cls", "n", "pos", F.col("c.cls").alias("c_cls"), F.col("c.n").alias("c_n"), F.col("c.pos").alias("c_pos"))
    star = star.filter("cls <> c_cls").filter(_bounded("", "c_", percent)).groupBy(F.col("cls").alias("a"), F.col("c_cls").alias("b")).agg(F.count("*").alias("shared_part"))
    star = saved(star, "star-pairs")
    links = saved(_verified(star.select("a", "b"), rows, percent), "star-links")
    roots = components(links)
    placed = entry.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = placed.groupBy("g").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("g")
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    open_columns = placed.join(mixed, "g").join(rows.select("cls", "last", "bits"), "cls").withColumn("block", F.pmod(F.hash("g"), F.lit(blocks)))
    pairs = open_columns.groupBy("block").applyInPandas(lean_group(_cross_pairs(percent)), "a long, b long").distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = saved(pairs.join(tried, ["a", "b"], "left_anti"), "cross-pairs")
    return links.unionByName(_verified(pairs, rows, percent))


def _named_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, row, n_shingles, cls and root, the component's fingerprint, of every document."""
    total = text_bytes(docs)
    first = saved(first_pass(docs, size, _sample_blocks(total)), "first-pass")
    sets = saved(_sets_of(first), "sets")
    chosen = saved(_candidates(first, sets, percent), "may-link")
    discard(first)
    shingles = sets.agg(F.sum("n_shingles")).first()[0] or 0
    rows = saved(matrix_rows(docs, chosen, shingles, total, size, percent), "matrix-rows")
    roots = components(saved(link_rows(rows, percent), "links"))
    named = sets.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return saved(named, "named-sets")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, cls (fingerprint of the set) and component_id of every document.

    Documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct
    ``size``-word shingles (A-Z lower-cased; fewer words make one shingle). component_id is
    the smallest doc_id reachable. Null, empty and blank texts have no shingles and are
    linked with nothing: their component is their own doc_id. A null doc_id is kept and
    loses to any other id. Columns other than doc_id and text are not read.
    """
    named = _named_sets(docs, size, percent)
    first = named.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("_first"))
    out = named.join(first, "root", "left")
    linked = F.when(F.col("n_shingles") > 0, F.col("_first")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "cls", F.coalesce(linked, "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component of the join the row
    with the smallest doc_id stays (null ids last, then by a hash of the text), once if it is
    repeated. Rows without words stay. Rows are told apart by id and text, so a null or
    repeated id never takes another text with it.

    Rows that are alone in their component stay where they are; only the others, which a
    bitmap of their texts' hashes tells, are joined with those that stay."""
    named = _named_sets(docs.select("doc_id", "text"), size, percent).filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = named.groupBy("root").agg(F.min(order).alias("k"), F.count("*").alias("_members")).filter("_members > 1")
    first = saved(first.select("root", F.col("k.doc_id").alias("_first"), F.col("k.row").alias("_row")), "first-rows")
    bits = _row_bits(saved(named.join(first.select("root"), "root").select("row").distinct(), "grouped-rows"))

    @F.pandas_udf("boolean")
    def grouped(row: pd.Series) -> pd.Series:
        return pd.Series(_has(row.to_numpy(), bits))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = bounded_batches(docs).withColumns({"_row": F.xxhash64(F.col("text").cast("string")), "_doc": F.col("doc_id").cast("long")})
    keyed = keyed.withColumn("_grouped", grouped("_row") & text.rlike(r"[^\x20\x09-\x0D]"))
    found = named.join(first.select("root"), "root", "left_anti").select(F.col("row").alias("_row"), F.col("doc_id").alias("_first"))
    stay = first.select("_row", "_first").unionByName(found)
    kept = keyed.filter("_grouped").join(stay, "_row").filter(F.col("_doc").eqNullSafe(F.col("_first"))).dropDuplicates(["_doc", "_row"])
    return keyed.filter("not _grouped").select(*docs.columns).unionByName(kept.select(*docs.columns))
