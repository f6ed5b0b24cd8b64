"""Code lengths by context-tree weighting over binary-decomposed bytes.

A text is its bytes with A-Z in lower case and an end mark; its context before the first
byte is a start mark. A byte is coded as eight binary decisions, each with the decisions
before it in the byte; every such node has a tree of contexts: the last 0, 1, ... DEPTH
bytes. A node of the tree holds the zeros and ones seen there in the training texts and
their Krichevsky-Trofimov probability Pe. Weighting mixes all depths: Pw = Pe at the deepest,
else Pw = (Pe + product of the children's Pw) / 2. The model that results is fixed: along
a context path, a node keeps the share b / (b + 1) of what its ancestors left, with b = Pe /
product of the children's Pw, and predicts (ones + 1/2) / (zeros + ones + 1).

Everything the model needs are counts of byte strings of DEPTH + 1 bytes, and of tokens for
the base. Documents are packed into slices, a written table. A slice yields each of its
strings and tokens once with counts; one shuffle adds them up over the corpus. Strings are then
dealt by the last two bytes of their contexts: the trees of longer contexts are whole in
their buckets, and only the nodes of contexts of one byte (at most 65,280) go through the
driver. A join by string or token brings the results back to the slices, which add them up
per document. No table of all strings or tokens meets in one task.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelmill.llm import words as W
from labelmill.llm.steps import arrow_schema, bounded_batches, discard, give_back, lean, saved

U = np.uint64
DEPTH = 5
#: Bytes of whole texts per slice, and of those that are worked on at once. Marks are bytes
#: that UTF-8 never holds.
SLICE, RUN, START, END = 32 << 20, 1 << 20, 0xFE, 0xFF
#: Tokens and strings have keys of their own; the end mark counts as a token.
TOKEN, STRING = 0, 1
END_TOKEN = int(W.mix(np.array([0x454E44], U)).view(np.int64)[0])

_SLICES, _SLICES_ARROW = arrow_schema({"slice": "long", "ids": "array<long>", "known_id": "binary", "held": "binary", "sizes": "binary", "bytes": "long", "text": "binary"})
_KEYS, _KEYS_ARROW = arrow_schema({"slice": "long", "kind": "int", "key": "long", "n": "long"})
_RESULT, _RESULT_ARROW = arrow_schema({"doc_id": "long", "held_out": "boolean", "n_tokens": "long", "n_known": "long", "n_bytes": "long", "base_nats": "double", "score": "double"})


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept out of the training texts; null ids are not."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(7)) == 2, F.lit(False))


def slices(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held) packed into rows of about SLICE bytes of compressed whole texts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        codec = pa.Codec("zstd", compression_level=1)

        def out() -> pa.RecordBatch:
            first, ids, known, flags, sizes, plain = zip(*held)
            joined = b"".join(plain)
            row = [first[0], np.concatenate(ids), np.concatenate(known).tobytes(), np.concatenate(flags).tobytes(), np.concatenate(sizes).tobytes(), len(joined), codec.compress(joined, asbytes=True)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SLICES_ARROW)], schema=_SLICES_ARROW)

        def entry(part: pa.RecordBatch) -> tuple:
            buf, offsets = W.text_bytes(part.column("text"))
            ids = part.column("doc_id").cast(pa.int64())
            known, flags = (np.asarray(f.to_numpy(zero_copy_only=False), bool) for f in (ids.is_valid(), part.column("held")))
            return part.column("first")[0].as_py(), ids.fill_null(0).to_numpy(), known, flags, np.diff(offsets).astype(np.int64), W.ascii_lower(buf).tobytes()

        for batch in batches:
            for part in W.slices(batch):
                new = entry(part)
                if held and size + len(new[-1]) > SLICE:
                    yield out()
                    held, size = [], 0
                held.append(new)
                size += len(new[-1])
        if held:
            yield out()

    numbered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held", F.monotonically_increasing_id().alias("first"))
    return bounded_batches(numbered).mapInArrow(run, _SLICES)


class Slice:
    """One slice as arrays; ``text`` ends every document with the END mark."""

    def __init__(self, row: dict):
        flag = lambda name: np.frombuffer(row[name], bool)
        sizes = np.frombuffer(row["sizes"], np.int64)
        plain = pa.Codec("zstd").decompress(row["text"], decompressed_size=row["bytes"], asbytes=True) if row["bytes"] else b""
        self.ids, self.known_id, self.held = row["ids"], flag("known_id"), flag("held")
        self.learn = ~self.held
        self.plain, self.offsets = np.frombuffer(plain, np.uint8), np.concatenate(([0], np.cumsum(sizes)))

    def tokens(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, document) of all words of documents first to last, as signed hashes; ends
        are not among them."""
        offsets = self.offsets[first : last + 1]
        column = pa.LargeStringArray.from_buffers(last - first, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(self.plain[offsets[0] : offsets[-1]]))
        w = W.words(column)
        return w.hash.view(np.int64), w.doc

    def strings(self, first: int, last: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of every byte and end mark of documents first to last with the ``depth``
        bytes before it, and where each document begins among them."""
        sizes = np.diff(self.offsets[first : last + 1])
        begin = np.concatenate(([0], np.cumsum(sizes + depth + 1)))
        buf = np.full(int(begin[-1]), START, np.uint8)
        buf[begin[1:] - 1] = END
        inside = np.ones(len(buf), bool)
        inside[begin[1:] - 1] = False
        inside[(begin[:-1, None] + np.arange(depth)).ravel()] = False
        buf[inside] = self.plain[self.offsets[first] : self.offsets[last]]
        key = np.zeros(len(buf) - depth, np.int64)
        for d in range(depth + 1):
            key = (key << 8) | buf[d : len(buf) - depth + d]
        keep = np.ones(len(key), bool)  # those that start in a document's last bytes would span two
        keep[(begin[1:-1, None] + np.arange(-depth, 0)).ravel()] = False
        return key[keep], np.concatenate(([0], np.cumsum(sizes + 1)))

    def runs(self) -> Iterator[tuple[int, int]]:
        """Runs of whole documents of about RUN bytes."""
        first = 0
        while first < len(self.offsets) - 1:
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + RUN, "right")) - 1)
            yield first, last
            first = last


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*parts))
    key, at = np.unique(keys, return_inverse=True)
    return key, np.bincount(at, counts, len(key)).astype(np.int64)


def _weighted(key: np.ndarray, learn: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their count where ``learn`` holds, and those elsewhere with 0."""
    known, n = np.unique(key[learn], return_counts=True)
    other = np.unique(key[~learn])
    return [(known, n), (other, np.zeros(len(other), np.int64))]


def counted(parts: DataFrame, depth: int) -> DataFrame:
    """(slice, kind, key, n): every token and string of a slice, with its training count."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Slice(row)
                found = {TOKEN: [(np.array([END_TOKEN]), np.array([int(s.learn.sum())]))], STRING: []}
                for first, last in s.runs():
                    learn = s.learn[first:last]
                    token, doc = s.tokens(first, last)
                    key, begin = s.strings(first, last, depth)
                    for kind, new in ((TOKEN, _weighted(token, learn[doc])), (STRING, _weighted(key, np.repeat(learn, np.diff(begin))))):
                        found[kind] += new
                        if len(found[kind]) > 6:
                            found[kind] = [_added(found[kind])]
                for kind, added in found.items():
                    key, n = _added(added)
                    for at in range(0, len(key), 1 << 17):
                        k = key[at : at + (1 << 17)]
                        columns = [pa.array(np.full(len(k), row["slice"])), pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + (1 << 17)])]
                        yield pa.RecordBatch.from_arrays(columns, schema=_KEYS_ARROW)

    return parts.mapInArrow(run, _KEYS)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1/2: Stirling's series at x + 8, taken back by the recurrence."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    back = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - back


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of the zeros and ones."""
    some = zeros + ones > 0
    out = log_gamma(ones + 0.5) + log_gamma(zeros + 0.5) - log_gamma(zeros + ones + 1.0) - 1.1447298858494002
    return np.where(some, out, 0.0)


class Level:
    """The nodes of one depth: ``code`` is context * 256 + node of the byte's decisions."""

    def __init__(self, code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.code, self.zeros, self.ones = code, zeros, ones
        pe = estimate(zeros, ones)
        self.kt = (ones + 0.5) / (zeros + ones + 1.0)
        if below is None:
            self.pw, self.kept = pe, np.ones(len(code))
        else:
            self.pw = np.logaddexp(pe, below) - np.log(2)
            self.kept = 1 / (1 + np.exp(np.clip(below - pe, -700, 700)))  # b / (b + 1)

    def parents(self, depth: int) -> tuple["Level", np.ndarray]:
        """The level at the smaller ``depth``, and the place there of each of these nodes."""
        short = ((self.code >> 8) & ((1 << (8 * depth)) - 1)) << 8 | (self.code & 255)
        code, at = np.unique(short, return_inverse=True)
        add = lambda v: np.bincount(at, v, len(code))
        return Level(code, add(self.zeros), add(self.ones), add(self.pw)), at


def decisions(key: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """(context * 256 + node, outcome) of one decision of each string's last byte. Node 1 to
    255 are the bits so far behind a leading one."""
    symbol = key & 255
    return (key >> 8) << 8 | (symbol >> (8 - bit)) + (1 << bit), (symbol >> (7 - bit)) & 1


def subtree(key: np.ndarray, n: np.ndarray, bit: int, depth: int, top: int) -> tuple[Level, np.ndarray, np.ndarray]:
    """One decision over the depths from ``top`` on: the level at ``top``, and per string its
    outcome's node there and the probability of a one that these depths give."""
    code, one = decisions(key, bit)
    code, at = np.unique(code, return_inverse=True)
    level = Level(code, np.bincount(at, n * (1 - one), len(code)), np.bincount(at, n * one, len(code)), None)
    chance, place = level.kt, np.arange(len(code))
    for d in range(depth - 1, top - 1, -1):
        level, up = level.parents(d)
        place = up[place]
        chance = level.kept[place] * level.kt[place] + (1 - level.kept[place]) * chance
    return level, level.code[place[at]], chance[at]


def _tops(depth: int, top: int):
    """Nodes at depth ``top`` of all strings of a bucket, added up to the depth before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n = pdf["key"].to_numpy(), pdf["n"].to_numpy(float)
        out = []
        for bit in range(8):
            level, _, _ = subtree(key, n, bit, depth, top)
            out.append(pd.DataFrame({"code": ((level.code >> 8) & ((1 << (8 * (top - 1))) - 1)) << 8 | (level.code & 255), "zeros": level.zeros, "ones": level.ones, "below": level.pw}))
        return pd.concat(out).groupby("code", as_index=False).sum()

    return run


def _path(first: pd.DataFrame, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, p, rest) at depth ``top`` - 1: the probability of a one that the depths so far
    give, and the share that they leave to longer contexts."""
    first = first.sort_values("code")
    level = Level(*(first[c].to_numpy() for c in ("code", "zeros", "ones", "below")))
    code, p, rest = level.code, np.zeros(len(level.code)), np.ones(len(level.code))
    levels, place = [(level, np.arange(len(code)))], np.arange(len(code))
    for d in range(top - 2, -1, -1):
        level, up = level.parents(d)
        place = up[place]
        levels.append((level, place))
    for level, place in reversed(levels):
        p += rest * level.kept[place] * level.kt[place]
        rest *= 1 - level.kept[place]
    return code, p, rest


def _coded(depth: int, top: int, code: np.ndarray, p: np.ndarray, rest: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n = pdf["key"].to_numpy(), pdf["n"].to_numpy(float)
        ln = np.zeros(len(key))
        for bit in range(8):
            _, node, chance = subtree(key, n, bit, depth, top)
            if top:
                at = np.searchsorted(code, ((node >> 8) & ((1 << (8 * (top - 1))) - 1)) << 8 | (node & 255))
                chance = p[at] + rest[at] * chance
            ln += np.log(np.where(decisions(key, bit)[1] == 1, chance, 1 - chance))
        return pd.DataFrame({"key": key, "ln": ln})

    return run


#: Context bytes by which strings are dealt: what is shorter is one small table.
TOP = 2
#: Strings per bucket, on average.
BUCKET = 200_000


def string_scores(strings: DataFrame, depth: int) -> DataFrame:
    """(key, ln): the log probability of each string's last byte after the bytes before.

    ``strings`` has every string once (key, n) with its training count, which may be 0. They
    are dealt by the last TOP bytes of their contexts, so every longer context is whole in one
    bucket; a first pass adds their nodes up to the contexts of one byte (at most 65,280 rows),
    a second one mixes both.
    """
    top = min(TOP, depth)
    own = F.expr("shiftright(key, 8)").bitwiseAND((1 << (8 * top)) - 1)
    buckets = max(8, -(-strings.count() // BUCKET))
    dealt = strings.select("key", "n", F.pmod(F.xxhash64(own), F.lit(buckets)).alias("bucket")).groupBy("bucket")
    none = np.zeros(0)
    code, p, rest = np.zeros(0, np.int64), none, none
    if top:
        tops = dealt.applyInPandas(_tops(depth, top), "code long, zeros double, ones double, below double")
        first = tops.groupBy("code").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas()
        code, p, rest = _path(first, top)
    return dealt.applyInPandas(_coded(depth, top, code, p, rest), "key long, ln double")


class Lookup:
    """values[i] for keys[i], by open addressing; all keys asked for must exist."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.bits = keys, values, max(10, int(2 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), self.place(keys)
        while len(rest):  # linear probing, all keys at once
            free = self.table[at] < 0
            self.table[at[free]] = rest[free]
            lost = self.table[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & (len(self.table) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        out = np.empty(len(wanted), self.values.dtype)
        for i in range(0, len(wanted), 1 << 18):
            w = wanted[i : i + (1 << 18)]
            spot = self.place(w)
            found = self.table[spot]
            off = np.flatnonzero(self.keys[found] != w)
            while len(off):
                if (found[off] < 0).any():
                    raise KeyError("a string or token without a value")
                spot[off] = (spot[off] + 1) & (len(self.table) - 1)
                found[off] = self.table[spot[off]]
                off = off[self.keys[found[off]] != w[off]]
            out[i : i + (1 << 18)] = self.values[found]
        return out


def _scored(depth: int, total: int, distinct: int):
    def run(text: pa.Table, known: pa.Table) -> pa.Table:
        kind, key, value = (known.column(c).to_numpy() for c in ("kind", "key", "value"))
        count, ln = Lookup(key[kind == TOKEN], value[kind == TOKEN]), Lookup(key[kind == STRING], value[kind == STRING])
        del kind, key, value
        out = []
        for row in text.to_pylist():
            s = Slice(row)
            end = count(np.array([END_TOKEN]))[0]
            for first, last in s.runs():
                docs = last - first
                token, doc = s.tokens(first, last)
                c = count(token)
                n = np.bincount(doc, minlength=docs) + 1
                base = np.bincount(doc, np.log(c + 1), docs) + np.log(end + 1) - n * np.log(total + distinct + 1)
                n_known = np.bincount(doc, c > 0, docs).astype(np.int64) + int(end > 0)
                wanted, begin = s.strings(first, last, depth)
                score = np.add.reduceat(ln(wanted), begin[:-1]) / np.log(10)
                columns = [
                    pa.array(np.array(s.ids[first:last], np.int64), mask=~s.known_id[first:last]), pa.array(s.held[first:last]), pa.array(n.astype(np.int64)), pa.array(n_known),
                    pa.array(np.diff(s.offsets[first : last + 1]) + 1), pa.array(base), pa.array(score),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, schema=_RESULT_ARROW))
        give_back()
        return pa.Table.from_batches(out, schema=_RESULT_ARROW)

    return run


def score(docs: DataFrame, held: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model and the base learn from the documents that are not held out. ``score`` is the
    log10 probability of the lower-cased bytes and the end mark; ``base_score`` the sum over
    tokens of log10((c + 1) / (N + V + 1)). A null text is an empty one, which is scored by
    its end mark alone. Repeated rows count and are returned as often as they occur. Without
    training texts every bit has probability 1/2. Other columns than doc_id and text are
    not read. Tokens are compared by 64-bit hashes.
    """
    if not 0 <= depth <= 6:
        raise ValueError("depth must be 0 to 6: strings are packed into a long")
    rule = held_out() if held is None else held
    parts = saved(slices(docs.select("doc_id", "text", rule.alias("held"))), "slices")
    keys = saved(counted(bounded_batches(parts), depth), "slice-keys")
    totals = saved(keys.groupBy("kind", "key").agg(F.sum("n").alias("n")), "key-counts")
    tokens = totals.filter(f"kind = {TOKEN}")
    total, distinct = tokens.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    strings = string_scores(totals.filter(f"kind = {STRING}").select("key", "n"), depth)
    values = tokens.select("kind", "key", F.col("n").cast("double").alias("value")).unionByName(strings.select(F.lit(STRING).alias("kind"), "key", F.col("ln").alias("value")))
    values = saved(values, "key-values")
    known = saved(keys.select("slice", "kind", "key").join(values, ["kind", "key"]), "slice-values")
    discard(keys, totals, values)
    found = parts.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(_scored(depth, total, distinct), _RESULT)
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base_nats") / float(np.log(10))).alias("base_score"), "score",
        (-F.col("score") / (float(np.log10(2)) * F.col("n_bytes"))).alias("bits_per_byte"),
    )
