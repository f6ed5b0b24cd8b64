"""Best-fit packing by minimum bin slack.

Documents become token ids once, in Arrow batches; from then on only piece lengths are
packed. Equal lengths are interchangeable, so the state of the packing is the number of
pieces per length: a table of at most ``capacity`` rows whatever the corpus holds, which
is why it may be planned in one place. For each bin the longest open length is placed
first; then a subset-sum dynamic program over the available lengths, on the bits of one
integer per step, finds the fullest feasible combination, which is removed as often as
the counts allow. Pieces then learn their bin by their position among the pieces of their
length: a join of distributed positions with the plan's ranges.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelmill.llm.ranks import position_blocks, with_positions
from labelmill.llm.steps import arrow_schema, bounded_batches, lean, saved

CAPACITY, END_ID = 2048, 0
#: Entries of a task's cache of tokenized words.
CACHE_WORDS = 150_000
_PIECE, _PIECE_ARROW = arrow_schema({"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"})


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Fixed value: how the byte-level BPE family cuts a text before merging.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _token_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


_SPACES = re.compile(r" (?:\s|\Z)")


def _packed(ids: list[int]) -> bytes:
    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


def _ranked(spec: dict):
    """A fast encoder for a tokenizer file whose ids are the order of its merges, else None."""
    import tiktoken

    vocab, merges = spec["model"].get("vocab"), spec["model"].get("merges") or []
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or any(vocab.get("".join(p)) != 256 + i for i, p in enumerate(pairs)):
        return None
    byte, special = _token_bytes(), {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("ranked", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Cache(dict):
    """Ids of known words; ``extra`` answers for words that found no room."""

    extra: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.extra[word]


class ByteLevelEncoder:
    """Ids of texts for a byte-level BPE whose pre-tokenizer keeps a space with the word
    after it. A text then splits before every space that a visible character follows, and
    each word is encoded by itself: once while the cache has room, else once per batch.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = _ranked(spec)
        self.cache = _Cache()

    @cached_property
    def tokenizer(self):
        """The plain tokenizer, for texts with special tokens and other kinds of files."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, parts: list[str], fast: bool = True) -> list[bytes]:
        if self.fast and fast:
            ids = map(self.fast, parts)
        else:
            ids = (e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False))
        return [_packed(x) for x in ids]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out, cut, marked, rest, words = [b""] * len(texts), {}, [], [], set()
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                marked.append(i)
            elif text[:1] == " " or _SPACES.search(text):
                rest.append(i)  # runs of white space: encoded whole
            else:
                first, *parts = text.split(" ")
                cut[i] = first, parts
                words.update(parts)
        fresh = [w for w in words if w not in self.cache]
        known = dict(zip(fresh, self._encode([" " + w for w in fresh])))
        self.cache.update(islice(known.items(), max(0, CACHE_WORDS - len(self.cache))))
        self.cache.extra = known
        get = self.cache.__getitem__
        for (i, (_, parts)), head in zip(cut.items(), self._encode([first for first, _ in cut.values()])):
            out[i] = head + b"".join(map(get, parts))
        self.cache.extra = {}
        for rows, fast in ((rest, True), (marked, False)):
            for i, ids in zip(rows, self._encode([texts[i] for i in rows], fast)):
                out[i] = ids
        return out


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    """One encoder per Python worker; tasks empty its cache when they end."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Piece lengths of a document: full ones, the first takes the remainder."""
    full, rest = divmod(total, capacity)
    return ([rest] if rest else []) + [capacity] * full


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    path = path or tokenizer_path()
    end = np.asarray([end_id], "<u4").tobytes()

    @lean
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            row = 0
            texts = batch.column("text").to_pylist()
            size = np.cumsum([0] + [len(t or "") for t in texts])
            while row < len(texts):  # about a million characters at a time
                stop = max(row + 1, int(np.searchsorted(size, size[row] + (1 << 20), "right")) - 1)
                for doc, data in zip(ids[row:stop], enc.encode([t or "" for t in texts[row:stop]])):
                    data += end
                    start = 0
                    for k, n in enumerate(cut_lengths(len(data) // 4, capacity)):
                        rows.append((doc, k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])))
                        start += n
                row = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _PIECE_ARROW)], schema=_PIECE_ARROW)
        enc.cache.clear()  # later operators share the worker

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECE)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """A multiset of available lengths with the largest sum up to ``room``.

    Bit s of an integer says that sum s can be reached. Longer lengths come first, so that
    short ones, which fit anywhere, are kept for later bins where there is a choice.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left > 0:  # copies in powers of two
            take = min(batch, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, batch = left - take, batch * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, their content as length -> pieces), longest lengths first."""
    counts = {k: v for k, v in counts.items() if v}
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        content = fullest({k: v for k, v in counts.items() if v}, capacity - longest)
        counts[longest] += 1
        content[longest] = content.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in content.items())
        for k, n in content.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        plan.append((times, content))
    return plan


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A document is its token ids and one end id; a null or empty text is the end id alone.
    Only documents longer than ``capacity`` are cut. Rows with one doc_id are packed each.
    Other columns are not read. sequence_id numbers the bins from 0; offset is the place in
    the bin, and a bin's pieces follow each other without a gap.
    """
    spark = docs.sparkSession
    pieces = saved(token_pieces(docs, path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    ranges, used, bins = [], dict.fromkeys(counts, 0), 0
    for times, content in plan_bins(counts, capacity):
        offset = 0
        for length in sorted(content, reverse=True):
            n = content[length]
            ranges.append((length, used[length], used[length] + n * times, n, bins, offset))
            used[length] += n * times
            offset += length * n
        bins += times
    plan = spark.createDataFrame(ranges, "length long, lo long, hi long, per_bin int, first_bin long, first_offset long")
    lookup = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "per_bin", "first_bin", "first_offset"))).alias("r"))
    placed = with_positions(pieces, ["length"], ["doc_id", "piece"], "_i", position_blocks(sum(counts.values())))
    found = placed.join(lookup, "length").withColumn("_r", F.element_at(F.filter("r", lambda x: (x["lo"] <= F.col("_i")) & (F.col("_i") < x["hi"])), 1))
    k = F.col("_i") - F.col("_r.lo")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_r.first_bin") + F.floor(k / F.col("_r.per_bin"))).alias("sequence_id"),
        (F.col("_r.first_offset") + F.pmod(k, F.col("_r.per_bin")) * F.col("length")).alias("offset"),
    )
