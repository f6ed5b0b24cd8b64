"""Records that may span lines, read from files by as many tasks as there are blocks.

A reader that starts in the middle of a file doesn't know whether it stands inside quotes.
Here every block is first read under both assumptions, in one pass that keeps no text, and
yields a row: what state it ends in under each, and how many records begin in it. States of
consecutive blocks compose, so a fold over one such row per block gives every block its true
state and the number of its first record. A second pass then cuts the records, each in the
block where it begins; the few that cross a block's end are put together by their number.

CSV: pieces are lines, a state is inside quotes or not. JSON arrays: pieces end with a closing
brace, a state is inside a string or not, with the depth of brackets as a sum.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelmill.session import materialize

#: Rows of a table per block or file that are broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 100_000


class CsvScanner:
    """Rules of quoted cells: a quote opens a cell only at its start, '""' is a quote inside,
    a closing quote ends the cell. Anything else breaks the record, which ends with its line."""

    separator = "\n"

    def begin(self, inside: bool) -> tuple[bool, int]:
        return inside, 0

    @staticmethod
    def _close(line: str, at: int) -> int:
        """Place behind the quote that closes, or -1."""
        while True:
            at = line.find('"', at)
            if at < 0:
                return -1
            if line[at + 1 : at + 2] != '"':
                return at + 1
            at += 2

    def line(self, inside: bool, line: str) -> tuple[bool, bool]:
        """(inside quotes after the line, broken)"""
        if '"' not in line:
            return inside, False
        at = 0
        while True:
            if inside:
                at = self._close(line, at)
                if at < 0:
                    return True, False
                if at == len(line):
                    return False, False
                if line[at] != ",":
                    return False, True
                at += 1
                inside = False
            elif line[at : at + 1] == '"':
                inside, at = True, at + 1
            else:
                end = line.find(",", at)
                if '"' in line[at : len(line) if end < 0 else end]:
                    return False, True
                if end < 0:
                    return False, False
                at = end + 1

    def scan(self, state: tuple[bool, int], piece: str, seen: dict[int, int]) -> tuple[bool, int]:
        line = piece.removesuffix("\r")
        if not state[0] and line:
            seen[0] = seen.get(0, 0) + 1
        return self.line(state[0], line)[0], 0

    def is_open(self, state: tuple[bool, int]) -> bool:
        return state[0]

    def cut(self, state: tuple[bool, int], piece: str, at_start: bool, at_end: bool) -> tuple[tuple[bool, int], str | None, bool]:
        """(state after, the piece's part of a record or None, broken)"""
        line = piece.removesuffix("\r")
        if at_start:
            line = line.removeprefix("﻿")
        if not state[0] and not line:
            return state, None, False
        inside, broken = self.line(state[0], line)
        return (inside, 0), line, broken

    glue = "\n"


_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)', re.DOTALL)
_REST_OF_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)', re.DOTALL)
_BRACKET = re.compile(r"[\[\]{]")


class JsonScanner:
    """Objects of a top-level array. Every piece but the last ended with a closing brace."""

    separator = "}"
    glue = "}"

    def begin(self, inside: bool) -> tuple[bool, int]:
        return inside, 0

    def _plain(self, inside: bool, piece: str) -> tuple[bool, str]:
        """(inside a string at the piece's end, the piece with blanks for its strings)"""
        out, at = [], 0
        if inside:
            at = _REST_OF_STRING.match(piece).end()
            if at == len(piece) and not self._ended(piece, 0):
                return True, " " * at
            out.append(" " * at)
        while True:
            found = _STRING.search(piece, at)
            if not found:
                out.append(piece[at:])
                return False, "".join(out)
            out += [piece[at : found.start()], " " * (found.end() - found.start())]
            at = found.end()
            if at == len(piece) and not self._ended(piece, found.start() + 1):
                return True, "".join(out)

    @staticmethod
    def _ended(piece: str, begin: int) -> bool:
        """Whether the string part from ``begin`` to the piece's end has its closing quote."""
        if not piece.endswith('"') or len(piece) <= begin:
            return False
        slashes = len(piece) - 1 - len(piece[begin:-1].rstrip("\\")) - begin
        return slashes % 2 == 0

    def scan(self, state: tuple[bool, int], piece: str, seen: dict[int, int]) -> tuple[bool, int]:
        inside, plain = self._plain(state[0], piece)
        depth = state[1]
        for c in _BRACKET.findall(plain):
            if c == "]":
                depth -= 1
            else:
                if c == "{":
                    seen[depth] = seen.get(depth, 0) + 1
                depth += 1
        return inside, depth - (not inside)

    def is_open(self, state: tuple[bool, int]) -> bool:
        return state[1] >= 2 or state[0]

    def cut(self, state: tuple[bool, int], piece: str, at_start: bool, at_end: bool) -> tuple[tuple[bool, int], str | None, bool]:
        if at_start:
            piece = piece.removeprefix("﻿")
        after = self.scan(state, piece, {})
        if at_end:  # what follows the last brace of the file
            after = (after[0], after[1] + (not after[0]))
        if self.is_open(state):
            return after, piece, False
        head, brace, rest = piece.partition("{")
        ahead = "[" if state[1] == 0 else ","
        if not brace:
            closing = "".join(head.split())
            if closing != ("[]" if state[1] == 0 else "]") or not at_end:
                raise ValueError("JSON input must be an array of objects")
            return after, None, False
        if head.strip() != ahead:
            raise ValueError("JSON input must be an array of objects")
        return after, brace + rest, False


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


_SUMMARY = "file string, start long, pieces long, " + ", ".join(f"inside{h} boolean, delta{h} int, levels{h} array<int>, begun{h} array<long>" for h in (0, 1))


def _summaries(scanner):
    """A row per block: how it ends under both assumptions, and records begun by depth."""

    def row(key, n, states, seen):
        out = {"file": key[0], "start": key[1], "pieces": n}
        for h in (0, 1):
            out |= {f"inside{h}": states[h][0], f"delta{h}": states[h][1], f"levels{h}": list(seen[h]), f"begun{h}": list(seen[h].values())}
        return pd.DataFrame([out])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for pdf in batches:
            for file, start, value in zip(pdf["file"], pdf["start"], pdf["value"]):
                if (file, start) != key:
                    if key:
                        yield row(key, n, states, seen)
                    key, n = (file, start), 0
                    states, seen = [scanner.begin(False), scanner.begin(True)], [{}, {}]
                n += 1
                for h in (0, 1):
                    states[h] = scanner.scan(states[h], value, seen[h])
        if key:
            yield row(key, n, states, seen)

    return run


_BLOCK = "file string, start long, pieces long, inside boolean, depth int, first long, is_first boolean, is_last boolean, end_inside boolean, end_depth int, records long"


def _fold(level: int):
    """True states and first record numbers of a file's blocks, in order. ``level`` is the
    depth at which records begin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inside, depth, first, out = False, 0, 0, []
        pdf = pdf.sort_values("start")
        for k, r in enumerate(pdf.to_dict("records")):
            h = int(inside)
            last = k == len(pdf) - 1
            begun = sum(int(n) for at, n in zip(r[f"levels{h}"], r[f"begun{h}"]) if at + depth == level)
            end = bool(r[f"inside{h}"]), depth + int(r[f"delta{h}"])
            out.append((r["file"], r["start"], r["pieces"], inside, depth, first, k == 0, last, *end, begun))
            inside, depth, first = *end, first + begun
        return pd.DataFrame(out, columns=[c.split()[0] for c in _BLOCK.split(", ")])

    return run


_CUT = "file string, number long, part long, text string, broken boolean"


def _cuts(scanner):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, number = None, [], 0
        for pdf in batches:
            out = []
            for file, start, value, inside, depth, first, is_first, is_last, pieces in zip(*(pdf[c] for c in ("file", "start", "value", "inside", "depth", "first", "is_first", "is_last", "pieces"))):
                if (file, start) != key:
                    key, state, n, held, broke = (file, start), (bool(inside), int(depth)), 0, [], False
                    crossed = scanner.is_open(state)
                    number = int(first) - crossed
                n += 1
                state, text, broken = scanner.cut(state, value, bool(is_first) and n == 1, bool(is_last) and n == pieces)
                if text is not None:
                    held.append(text)
                    broke |= broken
                    if not scanner.is_open(state) or n == pieces:
                        still = scanner.is_open(state)
                        body = scanner.glue.join(held) + (scanner.glue if scanner.glue == "}" and not still else "")
                        # a record that crosses blocks has a part for each, by the block's start
                        part = start if crossed or still and not is_last else -1
                        out.append((file, number, part, body, broke or bool(still and is_last)))
                        number, held, broke, crossed = number + 1, [], False, False
            yield pd.DataFrame(out, columns=["file", "number", "part", "text", "broken"])

    return run


@dataclass
class Records:
    """Records of some files: ``rows`` has file, number (in the file, from 0), text, broken."""

    rows: DataFrame
    blocks: DataFrame
    files: DataFrame = field(repr=False)


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most so many rows, hinted for broadcast up to MOST_BROADCAST."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def records(spark: SparkSession, path: str, scanner, level: int) -> Records:
    """Cut the files below ``path`` into records, with a task per block in both passes.

    ``blocks`` is a written table with a row per block, ``files`` one with a row per file
    (file, records). Broken records keep their numbers.
    """
    pieces = _pieces(spark, path, scanner.separator)
    summaries = pieces.mapInPandas(_summaries(scanner), _SUMMARY)
    blocks = materialize(summaries.groupBy("file").applyInPandas(_fold(level), _BLOCK), "file-blocks")
    files = blocks.groupBy("file").agg(F.sum("records").alias("records"), F.max_by(F.struct("end_inside", "end_depth"), "start").alias("end"))
    held = blocks.count()

    def cut(of: DataFrame) -> DataFrame:
        if held <= MOST_BROADCAST:  # a broadcast join leaves the pieces in their order
            joined = pieces.join(few(of, held), ["file", "start"])
        else:
            joined = pieces.withColumn("_i", F.monotonically_increasing_id()).join(of, ["file", "start"]).sortWithinPartitions("file", "start", "_i")
        return joined.select("file", "start", "value", "inside", "depth", "first", "is_first", "is_last", "pieces").mapInPandas(_cuts(scanner), _CUT)

    use = blocks.drop("end_inside", "end_depth", "records")
    rows = cut(use).filter("part < 0").drop("part")
    crossing = "end_inside" if isinstance(scanner, CsvScanner) else "(end_inside OR end_depth >= 2)"
    starts_open = "inside" if isinstance(scanner, CsvScanner) else "(inside OR depth >= 2)"
    crossed = blocks.filter(f"({crossing} AND NOT is_last) OR {starts_open}")
    if not crossed.isEmpty():
        parts = cut(crossed.select(*use.columns)).filter("part >= 0").groupBy("file", "number")
        joined = parts.agg(F.sort_array(F.collect_list(F.struct("part", "text", "broken"))).alias("p"))
        rows = rows.unionByName(joined.select("file", "number", F.array_join("p.text", scanner.glue).alias("text"), F.exists("p.broken", lambda b: b).alias("broken")))
    return Records(rows, blocks, files)


def positions(files: DataFrame, count) -> DataFrame:
    """(file, shift): rows in the files before, by path; one small row per file."""
    ahead = F.sum(count).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return few(files.select("file", F.coalesce(ahead, F.lit(0)).alias("shift")), files.count())
