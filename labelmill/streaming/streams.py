"""Results as they complete: Structured Streaming versions of the batch operators.

A run is a file stream with a checkpoint. Stopping and starting it again continues
after the last committed batch, which is how an interrupted run resumes.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelmill.operators import consensus, metrics
from labelmill.schema import RESULT_COLUMNS
from labelmill.sinks.writers import csv_projection

STREAM_FORMATS = ["json", "csv", "parquet"]


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def stream_projection(results: DataFrame, fmt: str, with_thinking: bool = False) -> DataFrame:
    """Columns of the streamed file: Parquet keeps the originals as one JSON text."""
    originals = [c for c in results.columns if c not in RESULT_COLUMNS]
    if fmt == "csv":
        return csv_projection(results, with_thinking=with_thinking)
    if fmt == "json":
        return results
    if fmt != "parquet":
        raise ValueError(f"unsupported streaming format: {fmt}")
    data = F.to_json(F.struct(*originals)) if originals else F.lit("")
    return results.select(
        F.col("row_index").alias("index"), "input_text", "ground_truth", "final_answer", F.col("success").alias("inference_success"),
        F.col("response_time_ms").alias("response_time"), "thinking_content", "raw_response", data.alias("original_data_json"),
    )


def stream_results(results: DataFrame, path: str, checkpoint: str, fmt: str = "json", with_thinking: bool = False) -> StreamingQuery:
    """Append each batch of results as new files; the format is checked before any work."""
    if fmt not in STREAM_FORMATS:
        raise ValueError(f"unsupported streaming format: {fmt}")
    writer = stream_projection(results, fmt, with_thinking).writeStream.format(fmt).option("checkpointLocation", checkpoint)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", "\"").option("quoteAll", True)
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return writer.option("path", path).outputMode("append").trigger(availableNow=True).start()


def _each_batch(df: DataFrame, checkpoint: str, mode: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(work).start()
    )


def stream_metric(results: DataFrame, checkpoint: str, out: str, metric: str, classes: list[str], average: str = "") -> StreamingQuery:
    """The live metric after every batch, one row per batch.

    State is the confusion table, so it is as small as the label set squared. A batch
    that is run again overwrites its own folder.
    """
    cells = metrics.confusion_counts(metrics.live_pairs(results))

    def work(batch: DataFrame, number: int) -> None:
        value = metrics.live_metric_from_cells(batch, metric, classes, average).withColumn("batch", F.lit(number).cast("long"))
        value.write.mode("overwrite").parquet(f"{out}/run={number}")

    return _each_batch(cells, checkpoint, "complete", work)


def stream_counters(results: DataFrame, checkpoint: str, out: str, expected_total: int | None = None) -> StreamingQuery:
    """processed, succeeded and failed after every batch; percent when the total is known."""
    counts = results.agg(
        F.count("*").alias("processed"), F.count_if(F.col("success")).alias("succeeded"), F.count_if(~F.col("success")).alias("failed")
    )

    def work(batch: DataFrame, number: int) -> None:
        share = F.col("processed") * 100.0 / F.lit(expected_total) if expected_total else F.lit(None).cast("double")
        batch.withColumn("percent", share).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/run={number}")

    return _each_batch(counts, checkpoint, "complete", work)


def rate_and_eta(query: StreamingQuery, processed: int, total: int) -> tuple[float, float | None]:
    """Rows per second of the last batch, and seconds left at that rate."""
    progress = query.lastProgress
    rate = float(progress["processedRowsPerSecond"]) if progress else 0.0
    return rate, (total - processed) / rate if rate > 0 else None


VOTE_SCHEMA = "row_index bigint, final_answer string, count bigint, total bigint, ratio double"
_ATTEMPT = ["row_index", "attempt_no", "answer", "success"]
_STATE = "row_index array<bigint>, attempt_no array<int>, answer array<string>, success array<boolean>"


def _votes(finished: pd.DataFrame, dropna: bool = True) -> pd.DataFrame:
    """Winner per row: most votes, then the answer given first; null is an answer unless dropped."""
    good = finished[finished["success"].astype(bool)]
    tally = good.groupby(["row_index", "answer"], as_index=False, dropna=dropna).agg(count=("attempt_no", "size"), first=("attempt_no", "min"))
    tally["total"] = tally.groupby("row_index")["count"].transform("sum")
    best = tally.sort_values(["row_index", "count", "first"], ascending=[True, False, True]).drop_duplicates("row_index")
    best = best.rename(columns={"answer": "final_answer"}).assign(ratio=lambda t: t["count"] / t["total"])
    return best[["row_index", "final_answer", "count", "total", "ratio"]]


def vote_when_complete(repeat: int) -> Callable:
    """State function over a bucket of rows: hold the attempts of unfinished rows, emit
    the votes of rows whose last attempt has come in."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pd.DataFrame(dict(zip(_ATTEMPT, map(list, state.get))))] if state.exists else []
        rows = pd.concat(held + [b[_ATTEMPT] for b in batches], ignore_index=True)
        rows = rows.drop_duplicates(["row_index", "attempt_no"])  # an attempt may be delivered twice
        complete = rows.groupby("row_index")["attempt_no"].transform("size") >= repeat
        rest = rows[~complete]
        if len(rest):
            state.update((
                [int(x) for x in rest["row_index"]], [int(x) for x in rest["attempt_no"]],
                rest["answer"].tolist(), [bool(x) for x in rest["success"]],
            ))
        elif state.exists:
            state.remove()
        votes = _votes(rows[complete])
        if len(votes):
            yield votes

    return step


#: Of a bucket: its rows with what each waits for (-1: null key), and the attempts of those
#: that have not voted, by the number of their row.
_TIMED_STATE = (
    "row_index array<bigint>, no_key array<boolean>, latest array<bigint>, until array<bigint>, voted array<boolean>, "
    "row array<int>, attempt_no array<int>, answer array<string>, success array<boolean>"
)


def vote_or_expire(repeat: int, wait_ms: int) -> Callable:
    """State function over a bucket of rows, each with a timer: a row votes when its last attempt
    is in, or when none has come for ``wait_ms`` of event time. A row that has voted is
    remembered for as long again, so that attempts that come later don't make it vote twice,
    and is then forgotten. The bucket's timer is that of its first row to expire."""
    keys = ["row_index", "no_key"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pd.Series(x, dtype=t) for x, t in zip(state.get, _TIMED_TYPES)] if state.exists else [pd.Series([], dtype=t) for t in _TIMED_TYPES]
        rows = pd.DataFrame(dict(zip([*keys, "latest", "until", "voted"], held[:5])))
        tries = pd.DataFrame(dict(zip(["row", *_ATTEMPT[1:]], held[5:])))
        watermark = max(state.getCurrentWatermarkMs(), 0)
        came = pd.DataFrame() if state.hasTimedOut else pd.concat(list(batches), ignore_index=True)
        fresh = np.zeros(len(rows), bool)
        if len(came):
            new = came.assign(attempt_no=came["attempt_no"].astype("int64"), success=came["success"].eq(True))
            seen = new.groupby(keys, sort=False, as_index=False)["ms"].max()
            rows = rows.merge(seen, on=keys, how="outer", sort=False)
            fresh = rows["ms"].notna().to_numpy()
            latest = rows[["latest", "ms"]].max(axis=1).astype("int64")
            until = rows["until"].where(~fresh, latest + wait_ms).astype("int64")
            rows = rows.assign(latest=latest, until=until, voted=rows["voted"].eq(True))[[*keys, "latest", "until", "voted"]]
            number = rows[keys].assign(row=np.arange(len(rows)))
            if len(tries):  # the merge may have moved rows
                old = pd.DataFrame({"row_index": held[0], "no_key": held[1]}).merge(number, on=keys, how="left")["row"].to_numpy()
                tries = tries.assign(row=old[tries["row"].to_numpy()])
            new = new.merge(number, on=keys)[tries.columns]
            tries = pd.concat([tries, new], ignore_index=True).drop_duplicates(["row", "attempt_no"])  # an attempt may be delivered twice
        voted = rows["voted"].to_numpy(bool)
        have = np.bincount(tries["row"].to_numpy(), minlength=len(rows))
        expired = ~fresh & (rows["until"].to_numpy() < watermark)
        complete = fresh & ~voted & (have >= repeat)
        voting = complete | (expired & ~voted)
        votes = _votes(tries[voting[tries["row"].to_numpy()]].rename(columns={"row": "row_index"}), dropna=False)
        if len(votes):
            own = rows.iloc[votes["row_index"]]
            yield votes.assign(row_index=own["row_index"].astype("Int64").mask(own["no_key"]).array)
        rows["until"] = rows["until"].where(~(expired & ~voted), watermark + wait_ms)
        rows["voted"] = voted | voting
        rest = rows[~(expired & voted)]
        tries = tries[~(voted | voting)[tries["row"].to_numpy()]]
        if not len(rest):
            state.remove()
            return
        place = np.zeros(len(rows), int)
        place[rest.index] = np.arange(len(rest))
        tries = tries.assign(row=place[tries["row"].to_numpy()])
        state.update(tuple(part[c].tolist() for part, names in ((rest, rest.columns), (tries, tries.columns)) for c in names))
        state.setTimeoutTimestamp(max(int(rest["until"].min()), watermark, 1))

    return step


_TIMED_TYPES = ["int64", "bool", "int64", "int64", "bool", "int64", "int64", "object", "bool"]


def stream_consensus(
    attempts: DataFrame, repeat: int, key: str = "row_index", buckets: int = 256, time: str | None = None, wait: str = "10 minutes", delay: str = "0 seconds",
) -> DataFrame:
    """Votes as a stream. ``attempts`` needs key, attempt_no, answer and success.

    With an event-time column ``time`` every row has a timer of its own: it votes when all
    attempts are in, or on those it has once event time has gone ``wait`` beyond its latest
    one; ``delay`` is how late attempts may be delivered. Without it a row waits for all its
    attempts. Rows are hashed into buckets, so one Python call handles many rows, and a
    bucket's state is the attempts of its unfinished rows (and the keys of those that voted
    lately, with ``time``).
    """
    if time is not None:
        timed = attempts.select(F.col(key).alias("row_index"), F.col("attempt_no").cast("int"), "answer", "success", F.col(time).cast("timestamp").alias("at"))
        wait_ms = pd.Timedelta(wait) // pd.Timedelta(milliseconds=1)
        timed = timed.withWatermark("at", delay).withColumns({
            "bucket": F.pmod(F.xxhash64("row_index"), F.lit(buckets)), "row_index": F.coalesce(F.col("row_index").cast("long"), F.lit(-1)), "no_key": F.col("row_index").isNull(),
            "ms": F.coalesce(F.greatest(F.unix_millis("at"), F.lit(0)), F.lit(0)),
        })
        return timed.groupBy("bucket").applyInPandasWithState(
            vote_or_expire(repeat, wait_ms), VOTE_SCHEMA, _TIMED_STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    slim = attempts.select(F.col(key).alias("row_index"), F.col("attempt_no").cast("int"), "answer", "success")
    slim = slim.withColumn("bucket", F.pmod(F.xxhash64("row_index"), F.lit(buckets)))
    return slim.groupBy("bucket").applyInPandasWithState(
        vote_when_complete(repeat), VOTE_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def votes_at_end(attempts: DataFrame, voted: DataFrame) -> DataFrame:
    """Votes of the rows that a finished stream left without one, from what has come.

    ``attempts`` is the table that the stream read, ``voted`` what it wrote. An attempt
    delivered twice counts once; rows without a successful attempt get no vote.
    """
    left = attempts.join(voted.select("row_index"), "row_index", "left_anti").dropDuplicates(["row_index", "attempt_no"])
    return consensus.consensus(left).select(*voted.columns)


def write_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
