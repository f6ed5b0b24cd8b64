"""Written intermediate tables and sizes shared by the operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelmill.session import bounded_batches, materialize, scratch_root  # noqa: F401

#: Text bytes per block of an index: bounds the rows that one block gathers.
BLOCK_BYTES = 8 << 20
NO_ID = -(1 << 63)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    The steps before it are then finished: collecting the driver's garbage lets Spark
    drop their shuffle files, so that disk use is that of the largest step, not the sum.
    """
    out = materialize(df, label)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more. Only folders made by ``saved``,
    below the shared one, are touched."""
    for table in tables:
        spark, root = table.sparkSession, scratch_root(table.sparkSession)
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            own = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/labelmill")
            system = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if system.makeQualified(path.getParent()).equals(system.makeQualified(own)):
                system.delete(path, True)


def give_back() -> None:
    """Return freed memory to the system.

    Spark reuses Python workers, and an idle one would keep what its largest batch took,
    beside the memory of the stages that follow.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(work: Callable) -> Callable:
    """A function over a task's batches that gives its memory back when it is done."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def lean_group(work: Callable) -> Callable:
    """A function over one group's rows that gives its working memory back."""

    @functools.wraps(work)
    def run(rows):
        try:
            return work(rows)
        finally:
            give_back()

    return run


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one narrow pass over the column."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def block_count(size: int, block_bytes: int = BLOCK_BYTES, least: int = 16) -> int:
    return max(least, -(-size // block_bytes))


def id_key(column: str = "doc_id") -> Column:
    """Row identity as a long; null sorts before every other id."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def arrow_schema(fields: dict[str, str]) -> tuple[str, pa.Schema]:
    """The same fields for Spark and for Arrow."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return ", ".join(f"{k} {v}" for k, v in fields.items()), pa.schema([(k, kinds[v]) for k, v in fields.items()])
