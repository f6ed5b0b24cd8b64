"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each cell is a 64-bit mask with a bit per
language, an n-gram owns ``HASHES`` cells, and the AND of its cells is the set of languages
that contain it. A text is looked up n-gram by n-gram; the bits are counted per language,
corrected for the filter's false positives, and the language with most n-grams wins.

An n-gram belongs to a language if it is not rare there and not far rarer than in the
language that uses it most: quotations of other languages then leave no trace.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelmill.llm.steps import arrow_schema, bounded_batches, give_back, lean, saved
from labelmill.llm.words import mix

U = np.uint64
UNKNOWN = "und"
SIZES, HASHES = (3, 4), 3
#: Texts per language that the filters are learned from.
SAMPLE_PER_LANGUAGE = 3000
MAX_LANGUAGES = 64
#: Least uses of an n-gram in a language, and least share of its highest relative frequency.
LEAST_USES, LEAST_SHARE = 3, 0.15
#: Cells per n-gram of the filter; its size follows what the bounded sample holds.
CELLS_PER_GRAM = 8
#: Standard deviations of the false positives that an n-gram count must exceed.
NOISE = 3.0
#: Characters of whole texts that are worked on at once.
CHARS = 1 << 18
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, text of each, letters per text) of lower-cased letter runs.

    Runs are parted by one mark, the first has one before it; inner places of an n-gram
    are letters.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\0" + "".join(t + "\0" for t in lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    owner = np.concatenate(([0], np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the mark after a run
    keep[0] = True
    count = np.bincount(owner[letter], minlength=len(texts))
    code, letter, owner = np.where(letter, codes, 0)[keep].astype(U), letter[keep], owner[keep]
    hashes, docs = [], []
    for size in SIZES:
        n = len(code) - size + 1
        if n <= 0:
            continue
        inner = letter[1 : 1 + n].copy()
        for k in range(2, size - 1):
            inner &= letter[k : k + n]
        h = np.full(n, size, U)
        for k in range(size):
            h = h * U(0x2545F4914F6CDD1D) + code[k : k + n]
        at = np.flatnonzero(inner)
        hashes.append(mix(h[at]))
        docs.append(owner[1 : 1 + n][at])
    return (np.concatenate(hashes), np.concatenate(docs), count) if hashes else (np.zeros(0, U), np.zeros(0, int), count)


def _parts(texts: list[str]):
    row, size = 0, np.cumsum([0] + [len(t) for t in texts])
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(size, size[row] + CHARS, "right")) - 1)
        yield texts[row:stop]
        row = stop


@dataclass
class Filters:
    languages: list[str]
    cells: np.ndarray
    false_positive: np.ndarray

    def places(self, h: np.ndarray):
        step = mix(h ^ U(0xA5A5)) | U(1)
        for k in range(HASHES):
            yield ((h + step * U(k)) % U(len(self.cells))).astype(np.int64)

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """Masks of the languages that contain each n-gram."""
        out = None
        for at in self.places(h):
            out = self.cells[at] if out is None else out & self.cells[at]
        return out

    @staticmethod
    def build(languages: list[str], grams: np.ndarray, masks: np.ndarray) -> "Filters":
        size = 1 << max(10, int(CELLS_PER_GRAM * max(1, len(grams))).bit_length())
        out = Filters(languages, np.zeros(size, U), np.zeros(len(languages)))
        for at in out.places(grams):
            np.bitwise_or.at(out.cells, at, masks)
        fill = np.array([((out.cells >> U(i)) & U(1)).mean() for i in range(len(languages))])
        out.false_positive = fill**HASHES
        width = next(w for w in (8, 16, 32, 64) if w >= len(languages))
        out.cells = out.cells.astype(f"uint{width}")  # a worker holds one copy
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, evidence) of each text: the language with the highest corrected
        count, the first by name of equal ones, and its part of the counts of the two best.
        Only text without letters is unknown, with score 0. Evidence is whether some language
        holds more n-grams than the filter's false positives explain."""
        names, scores, evidence = [], [], []
        for part in _parts(texts):
            h, doc, count = text_grams(part)
            total = np.bincount(doc, minlength=len(part)).astype(float)
            mask = self.languages_of(h)
            hits = np.empty((len(self.languages), len(part)))
            known = np.zeros(len(part), bool)
            for i, fp in enumerate(self.false_positive):
                got = np.bincount(doc, ((mask >> mask.dtype.type(i)) & mask.dtype.type(1)).astype(float), minlength=len(part))
                hits[i] = np.maximum(0, (got - total * fp) / (1 - fp))
                known |= got - total * fp > NOISE * np.sqrt(total * fp * (1 - fp))
            best = hits.argmax(0)
            top = np.sort(hits, 0)[::-1]
            both = top[0] + (top[1] if len(top) > 1 else 0)
            score = np.where(both > 0, top[0] / np.maximum(both, 1e-9), 0.0)
            names += [self.languages[b] if k else UNKNOWN for b, k in zip(best, count > 0)]
            scores.append(np.where(count > 0, score, 0.0))
            evidence.append(known & (count > 0))
        return names, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(evidence) if evidence else np.zeros(0, bool)


def held_out(modulus: int = 3, rest: int = 1) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from a table of text and lang.

    Uses about ``per_language`` texts of each language, whole ones, chosen by hash of the
    text; a language with fewer gives all. At most 64 languages.
    """
    rows = labelled.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if not sizes:
        return Filters.build([], np.zeros(0, U), np.zeros(0, U))
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / v)))])
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    fields, schema = arrow_schema({"lang": "string", "h": "array<long>", "n": "array<long>"})

    @lean
    def count(batches):
        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                for part in _parts([texts[i] for i in np.flatnonzero(langs == lang)]):
                    h, n = np.unique(text_grams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([h.view(np.int64)]), pa.array([n])], schema=schema)

    uses = bounded_batches(chosen).mapInArrow(count, fields).select("lang", F.explode(F.arrays_zip("h", "n")).alias("x")).groupBy("lang", F.col("x.h").alias("h")).agg(F.sum("x.n").alias("n"))
    uses = saved(uses, "gram-uses")
    totals = {r["lang"]: r["t"] for r in uses.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    rate = F.col("n") / F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("lang")]
    bit = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])[F.col("lang")]
    uses = uses.filter(f"n >= {LEAST_USES}").withColumns({"rate": rate, "bit": bit})
    grams = uses.groupBy("h").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate")).alias("by"))
    mask = F.aggregate(F.filter("by", lambda x: x["rate"] >= F.col("top") * LEAST_SHARE), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"])))
    got = grams.select("h", mask.alias("mask")).toPandas()  # bounded by the sample
    return Filters.build(names, got["h"].to_numpy(np.int64).view(U), got["mask"].to_numpy(np.int64).view(U))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and lang_evidence (replacing columns of
    these names).

    Reads text only. Null text and text without a letter get "und" and score 0; without any
    learned language every text does. lang_evidence is false for these, and for texts of
    which no language holds more n-grams than chance explains.
    """
    docs = bounded_batches(docs.drop("lang_pred", "score", "lang_evidence"))
    known = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the learning sample

    @F.pandas_udf("struct<lang_pred:string,score:double,lang_evidence:boolean>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = known.value
        for text in batches:
            texts = [t or "" for t in text]
            names, score, evidence = model.predict(texts) if model.languages else ([UNKNOWN] * len(texts), 0.0, False)
            yield pd.DataFrame({"lang_pred": names, "score": score, "lang_evidence": evidence})
        give_back()

    return docs.withColumn("_p", predict(F.col("text").cast("string"))).select(*docs.columns, "_p.*")
