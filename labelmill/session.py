"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "labelmill", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks.

    A cluster session is made by spark-submit; nothing in this package depends on
    these settings except UTC and ANSI mode, both of which are Spark's usual ones.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(table: DataFrame) -> DataFrame:
    """Give a freshly read table at least one partition per core.

    Meant for costly per-row work on an input of few files. A table with as many splits
    as there are cores, and so every large one, is returned as it is: no shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be given, because other machines cannot see a local
    one. Only a local-mode session without the setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="labelmill-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/labelmill/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage and keeps costly steps from running twice.

    Unlike an executor cache the written table survives the loss of executors, which
    matters after model calls: a recomputed call costs money and may answer differently.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of text that Python gets at once, on top of what Spark would send.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession | None) -> None:
    """Bound the session's Arrow batches for whole texts.

    Spark counts rows, and ten thousand rows of long texts are more than a worker should
    hold. Settings that are already tighter stay.
    """
    if spark is None:
        return
    conf = spark.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key, None)
        now = int(re.sub(r"\D", "", now) or 0) if now and re.fullmatch(r"-?\d+b?", now.lower()) and not now.startswith("-") else 0
        if not 0 < now <= most:
            conf.set(key, str(most))


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same table, with the session's Arrow batches bounded."""
    bound_batches(df.sparkSession)
    return df
