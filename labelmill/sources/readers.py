"""Input tables: CSV, JSON, Parquet and workbooks, with row positions and a text column."""

from __future__ import annotations

import io
import os
import zipfile
from typing import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from labelmill.sources import split_scan

ROW = "row_index"


def _blocks_to_index(df: DataFrame, extra_drop: list[str] = ()) -> DataFrame:
    """0-based position over all files in path order, without a one-task window.

    Inside a task ids grow by one per row, so a row's place in its file block is its id
    minus the block's first id. Block sizes give the offsets: one small row per block,
    broadcast up to a checked number of them.
    """
    rows = df.withColumn("_id", F.monotonically_increasing_id())
    blocks = rows.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("_file", "_start", (F.coalesce(ahead, F.lit(0)) - F.col("_first")).alias("_shift"))
    blocks_at_most = len(df.inputFiles()) + df.rdd.getNumPartitions()
    out = rows.join(split_scan.few(offsets, blocks_at_most), ["_file", "_start"]).withColumn(ROW, F.col("_id") + F.col("_shift"))
    return out.drop("_id", "_shift", "_file", "_start", *extra_drop)


def _with_file(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))


def load_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every column as text. Rows with too few, too many or broken cells are skipped but
    keep their position. Every file must have the columns of the first in the same order;
    another header raises. Files are cut into records by a task per block, also where cells
    hold line breaks (``split_scan``). ``multi_line=False`` takes every line for a row, which
    saves the scan for the states of quotes.
    """
    base = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    names = base.csv(path).columns
    # Spark gives blank and repeated header cells names of its own, which no header matches.
    header = spark.read.option("escape", '"').option("multiLine", multi_line).csv(path).first()
    same = header is not None and list(header) == names
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_corrupt", T.StringType())])
    if multi_line:
        return _whole_rows(_csv_records(spark, path, names, schema, same), names)
    raw = (
        base.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("columnPruning", False).option("enforceSchema", not same).csv(path)
    )
    # Spark refuses to read the corrupt-record column alone, which a plain count would
    # ask for; the second condition always holds and keeps a real column in the scan.
    good = F.col("_corrupt").isNull() & (F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0)
    return _whole_rows(_blocks_to_index(_with_file(raw)).filter(good).drop("_corrupt"), names)


def _whole_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    if rows.isEmpty():
        raise ValueError("CSV file must have at least one valid data row")
    # A cell is always text; Spark reads an empty unquoted one as null.
    return rows.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], ROW)


def _csv_records(spark: SparkSession, path: str, names: list[str], schema: T.StructType, same: bool) -> DataFrame:
    found = split_scan.records(spark, path, split_scan.CsvScanner(), 0)
    ddl = ", ".join("`" + f.name.replace("`", "``") + "` STRING" for f in schema)
    cells = F.from_csv("text", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"'})
    shift = split_scan.positions(found.files, F.col("records") - 1)
    rows = found.rows.withColumn("cells", cells).join(shift, "file")
    good = ~F.col("broken") & F.col("cells._corrupt").isNull()
    if same:
        matches = F.lit(True)
        for n in names:
            matches &= F.lower(F.col("cells").getField(n)).eqNullSafe(n.lower())
        message = F.concat(F.lit("CSV header of another file differs: "), "file")
        header = F.when(good & matches, F.lit(False)).otherwise(F.raise_error(message).cast("boolean"))
    else:
        header = F.lit(False)
    rows = rows.filter(F.when(F.col("number") == 0, header).otherwise(good))
    return rows.select(*[F.col("cells").getField(n).alias(n) for n in names], (F.col("number") - 1 + F.col("shift")).alias(ROW))


def load_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Arrays of objects, or JSON Lines; broken input and single objects raise. Arrays are
    cut between their elements by a task per block (``split_scan``)."""
    if lines:
        return _blocks_to_index(_with_file(spark.read.option("mode", "FAILFAST").json(path)))
    found = split_scan.records(spark, path, split_scan.JsonScanner(), 1)
    # The scan takes a closing brace for granted behind the file's last piece.
    if not found.files.filter("end.end_inside OR end.end_depth <> -1").isEmpty():
        raise PySparkValueError(message="JSON input must be an array of objects")
    schema = spark.read.option("mode", "FAILFAST").json(found.rows.select("text").rdd.map(lambda r: r[0])).schema
    if not len(schema):
        if not found.rows.isEmpty():
            return found.rows.join(split_scan.positions(found.files, F.col("records")), "file").select((F.col("number") + F.col("shift")).alias(ROW))
        return spark.createDataFrame([], f"{ROW} long")
    element = F.from_json("text", schema, {"mode": "FAILFAST"})
    rows = found.rows.withColumn("element", element).join(split_scan.positions(found.files, F.col("records")), "file")
    return rows.select(*[F.col("element").getField(f.name).alias(f.name) for f in schema], (F.col("number") + F.col("shift")).alias(ROW))


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Types are kept; the position comes from the reader, so nothing extra is scanned
    for a single file and only row counts for several."""
    raw = spark.read.parquet(path)
    if raw.isEmpty():
        raise ValueError("parquet file is empty")
    position = F.col("_metadata.row_index")
    if len(raw.inputFiles()) == 1:
        return raw.select("*", position.alias(ROW))
    rows = raw.select("*", position.alias("_pos"), F.col("_metadata.file_path").alias("_file"))
    sizes = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_file", F.coalesce(ahead, F.lit(0)).alias("_off"))
    return rows.join(split_scan.few(offsets, len(raw.inputFiles())), "_file").withColumn(ROW, F.col("_pos") + F.col("_off")).drop("_pos", "_off", "_file")


_CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """(number from 0, cells) of the first sheet's rows as they are read; absent cells are ''.

    Sheets are parsed as a stream, and a row is dropped when it has been given out.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, si in ElementTree.iterparse(f):
                    if si.tag == _CELL + "si":
                        shared.append("".join(t.text or "" for t in si.iter(_CELL + "t")))
                        si.clear()
        sheets = [n for n in names if n.startswith("xl/worksheets/sheet")]
        with z.open(min(sheets, key=lambda n: (len(n), n))) as f:
            number = -1
            for _, row in ElementTree.iterparse(f):
                if row.tag != _CELL + "row":
                    continue
                number = int(row.get("r", number + 2)) - 1
                cells: list[str] = []
                for c in row.iter(_CELL + "c"):
                    at = 0
                    for ch in c.get("r", ""):
                        if ch.isalpha():
                            at = at * 26 + ord(ch.upper()) - 64
                    value = c.findtext(_CELL + "v") or "".join(t.text or "" for t in c.iter(_CELL + "t"))
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    cells += [""] * (at - 1 - len(cells)) + [value]
                row.clear()
                yield number, cells


#: Rows of a workbook that leave a task at once.
_SHEET_BATCH = 5000


def read_workbooks(books: DataFrame) -> DataFrame:
    """Rows of workbooks given as (path, content): file, row_index, cells (name -> text), text.

    First sheet, first row is the header; empty rows are skipped but keep their position,
    blank header cells are ignored, short rows are allowed. A workbook without a header and a
    data row raises.
    """
    def resolved(named: dict[str, str], cells: list[str]) -> str:
        text = ""
        for k, v in named.items():
            if k in ("text", "content"):
                text = v
        return text or cells[0]

    def read(batches):
        columns = ["file", ROW, "cells", "text"]
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                header, out, last = None, [], 0
                for number, cells in _sheet_rows(content):
                    last = number
                    if header is None:
                        header = cells if number == 0 else []
                    if number and cells:
                        named = {h: v for h, v in zip(header, cells) if h}
                        out.append((file, number - 1, named, resolved(named, cells)))
                    if len(out) == _SHEET_BATCH:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                if last < 1:
                    raise ValueError(f"{file}: needs a header and one data row")
                yield pd.DataFrame(out, columns=columns)

    return books.select("path", "content").mapInPandas(read, f"file string, {ROW} bigint, cells map<string,string>, text string")


def load_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """A folder of workbooks, one task per file (``read_workbooks``)."""
    return read_workbooks(spark.read.format("binaryFile").load(path))


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by file extension, any case."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    readers = {
        ".csv": load_csv, ".json": load_json, ".parquet": load_parquet, ".xlsx": load_workbooks,
        ".jsonl": lambda s, p, **o: load_json(s, p, lines=True, **o),
    }
    if ext not in readers:
        raise ValueError(f"unsupported file format: {ext}")
    return readers[ext](spark, path, **options)


def resolve_text(schema: T.StructType, kind: str) -> Column:
    """The text of a row by the rules of its source kind, decided from the schema.

    csv, workbook: the later of ``text`` and ``content``, else the first column.
    json: ``text``, else ``content``, else the first string above 10 bytes.
    parquet: the last non-null of ``text``, ``content``, ``REVIEW`` in column order, and
    if that is '' the first string above 10 bytes.
    """
    strings = [f.name for f in schema if isinstance(f.dataType, T.StringType) and f.name != ROW]
    col = lambda n: F.col(f"`{n}`")
    long_one = [F.when(F.octet_length(col(n)) > 10, col(n)) for n in strings]
    any_long = F.coalesce(*long_one, F.lit("")) if long_one else F.lit("")
    if kind in ("csv", "workbook"):
        named = [n for n in strings if n in ("text", "content")]
        chosen = F.coalesce(col(named[-1]), F.lit("")) if named else F.lit("")
        first = next(f.name for f in schema if f.name != ROW)
        return F.when(chosen == "", F.coalesce(col(first).cast("string"), F.lit(""))).otherwise(chosen)
    if kind == "json":
        named = [col(n) for n in ("text", "content") if n in strings]
        return F.coalesce(*named, any_long)
    if kind == "parquet":
        named = [col(n) for n in reversed(strings) if n in ("text", "content", "REVIEW")]
        chosen = F.coalesce(*named, F.lit("")) if named else F.lit("")
        return F.when(chosen == "", any_long).otherwise(chosen)
    raise ValueError(f"unknown source kind: {kind}")


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in file order; a filter on the position, so it is deterministic."""
    return df.filter(F.col(ROW) < n) if n > 0 else df


def join_ground_truth(df: DataFrame, reference: DataFrame, index_column: str, column: str, key: str = ROW) -> DataFrame:
    """Labels from another table. The join kind is left to Spark, which knows the sizes."""
    labels = reference.select(F.col(index_column).alias("_ref"), F.col(column).cast("string").alias("reference_label"))
    return df.join(labels, df[key] == labels["_ref"], "left").drop("_ref")
