"""File-arrival streams with the same definitions as the batch plans.

What a micro-batch yields goes into a folder of its own, named by the batch's number and overwritten when the batch runs
again after a loss; so each arrival counts once, also when the stream is stopped and started in the middle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talentloom.functions import score as S


def read_arrivals(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder or a glob, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, plan: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str, output_mode: str = "append") -> None:
    """Process what has arrived, then stop: ``plan(batch, number)`` of each micro-batch is written below ``out``, once a number."""
    def write(batch: DataFrame, number: int) -> None:
        plan(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()


def score_arrivals(arrivals: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Apply a batch plan - projections and joins with tables at rest - to the rows of each micro-batch."""
    run_batches(arrivals, lambda batch, _: plan(batch), out, checkpoint)


def content_key(*parts: Column) -> Column:
    """Key of one analysis: same name, size, opening and options give the same key."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def _earliest(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The smallest (ts, id) of a key is its state; it is told whenever it falls, and forgotten by the timer."""
    if state.hasTimedOut:
        state.remove()
        return
    best = known = tuple(state.get) if state.exists else None
    latest = 0
    for part in rows:
        first = part.sort_values(["ts_us", "row_id"]).iloc[0]
        found = (int(first["ts_us"]), int(first["row_id"]))
        latest = max(latest, int(part["ts_us"].max()))
        best = found if best is None or found < best else best
    state.update(best)
    state.setTimeoutTimestamp(max(latest // 1000, state.getCurrentWatermarkMs()) + 1 + _HORIZON_MS)
    if best != known:
        yield pd.DataFrame({"upload_key": [key[0]], "ts_us": [best[0]], "row_id": [best[1]]})


#: A key that has not come again for so long leaves the state.
_HORIZON_MS = 24 * 3600 * 1000


def dedup_uploads(arrivals: DataFrame, ts: str, row_id: str, key: Column, delay: str = "1 day") -> DataFrame:
    """(upload_key, ts_us, row_id): for each key and day the earliest row so far, again whenever rows of that key and day arrive.

    The survivor is the smallest (ts, id), whatever the order of batches. The state is a running minimum that Spark keeps for a key and a day until
    the watermark, which lags by ``delay``, has passed that day; rows of a day that has passed are dropped. Rows without a time have no
    state and are told as they come. :func:`survivors` reads the last word of each key.
    """
    rows = _uploads(arrivals, ts, row_id, key)
    told = ["upload_key", "ts_us", "row_id"]
    best = rows.withWatermark("ts", delay).groupBy("upload_key", F.window("ts", "1 day")).agg(F.min(F.struct("ts_us", "row_id")).alias("best"))
    return best.select("upload_key", "best.ts_us", "best.row_id").unionByName(rows.filter("ts IS NULL").select(*told))


def dedup_uploads_by_timer(arrivals: DataFrame, ts: str, row_id: str, key: Column, delay: str = "1 day") -> DataFrame:
    """:func:`dedup_uploads` with a timer for each key, which the key's rows put off: a call of Python for each key of a batch.

    State lasts a day beyond the watermark; rows older than it are dropped.
    """
    kept = _uploads(arrivals, ts, row_id, key).withWatermark("ts", delay).groupBy("upload_key")
    return kept.applyInPandasWithState(_earliest, "upload_key string, ts_us long, row_id long", "ts_us long, row_id long", "update", GroupStateTimeout.EventTimeTimeout)


def _uploads(arrivals: DataFrame, ts: str, row_id: str, key: Column) -> DataFrame:
    return arrivals.select(key.alias("upload_key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("ts_us"), F.col(row_id).cast("long").alias("row_id"))


def survivors(told: DataFrame) -> DataFrame:
    """One row a key of what :func:`dedup_uploads` has told: the smallest of all, one without a time only where none has a time."""
    best = told.groupBy("upload_key").agg(F.min(F.struct(F.col("ts_us").isNull(), "ts_us", "row_id")).alias("best"))
    return best.select("upload_key", F.col("best.row_id").alias("row_id"), F.timestamp_micros("best.ts_us").alias("ts"))


def bands(rows: DataFrame, ts: str, score: str, window: str = "1 day") -> DataFrame:
    """(window_start, window_end, band, rows) of a table."""
    return (
        rows.groupBy(F.window(ts, window).alias("w"), S.band(F.col(score)).alias("band")).agg(F.count("*").alias("rows"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "band", "rows")
    )


def run_bands(arrivals: DataFrame, ts: str, score: str, out: str, checkpoint: str, window: str = "1 day", delay: str = "1 hour") -> None:
    """Count each micro-batch by window and band; rows whose window was closed before their batch are counted apart, as late.

    The watermark of a batch is the latest event of the batches before it, less ``delay``; it is read from their
    counts, so a batch that runs again meets the same one. A batch leaves a row for each window and band, not its events.
    """
    spark = arrivals.sparkSession

    def plan(batch: DataFrame, number: int) -> DataFrame:
        marked = batch.select(ts, score, F.window(ts, window)["end"].alias("end"))
        before = watermark(read_bands(spark, out).filter(F.col("batch") < number), delay) if number else None
        is_late = F.coalesce(F.col("end") <= F.lit(before), F.lit(False)) if before is not None else F.lit(False)
        counted = marked.groupBy("end", S.band(F.col(score)).alias("band"), is_late.alias("late")).agg(F.count("*").alias("rows"), F.max(ts).alias("latest"))
        return counted.select("end", "band", "late", "rows", "latest")

    run_batches(arrivals, plan, out, checkpoint)


def read_bands(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("end timestamp, band int, late boolean, rows long, latest timestamp, batch int").parquet(out)


def watermark(counted: DataFrame, delay: str):
    """The latest event counted, less ``delay``: one value."""
    return counted.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("mark")).first()["mark"]


def running_bands(counted: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window_start, band, rows, late, final): closed windows are final, open ones provisional, both in one result."""
    mark = counted.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("mark")).scalar()
    late = F.sum(F.when(F.col("late"), F.col("rows")).otherwise(0))
    summed = counted.groupBy("end", "band").agg((F.sum("rows") - late).alias("rows"), late.alias("late"))
    return summed.select((F.col("end") - F.expr(f"INTERVAL {window}")).alias("window_start"), "band", "rows", "late", (F.col("end") <= mark).alias("final"))
