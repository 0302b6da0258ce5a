"""Structured Streaming variants of batch operators (STM-1..3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from factloom.operators.tables import insert_missing


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """STM-1: files (path, length, sha256) as they arrive; empty ones are left out."""
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return f.filter("length > 0").select("path", "length", F.sha2("content", 256).alias("sha256"))


def archive_new(files: DataFrame, table: str, checkpoint: str):
    """STM-1: append files (with sha256) whose hash the table at ``table`` hasn't; returns the query."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            have = spark.read.parquet(table)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            have = batch.limit(0)
        insert_missing(batch, have, ["sha256"], ["path"]).write.mode("append").parquet(table)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counters(events: DataFrame, ts: str = "occurred_at", kind: str = "event_type", late: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """STM-2: counts by window and type; events later than the watermark are dropped, and counted by ``count_late``."""
    e = events.withWatermark(ts, late)
    return e.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


COUNTED = "event_type string, shard int, on_time long, late long"


def count_late(events: DataFrame, path: str, checkpoint: str, ts: str = "occurred_at", kind: str = "event_type", late: str = "2 hours", window: str = "1 hour", shards: int = 16):
    """STM-2: how many events of each kind came in time and how many after ``event_counters`` had closed their window; returns the query.

    The counts are the operator's own state, a row for each kind and shard (so that a frequent kind isn't one task), kept
    in the checkpoint and carried over restarts. Each batch writes the rows it changed to its own folder below ``path``.
    """
    size = events.sparkSession.range(1).select(F.expr(f"cast(interval {window} as interval day to second)").alias("w")).first().w.total_seconds() * 1000

    def tally(key, frames, state):
        on_time, over = state.get if state.exists else (0, 0)
        closed = state.getCurrentWatermarkMs()
        for f in frames:
            gone = int((f["end"] <= closed).sum())
            on_time, over = on_time + len(f) - gone, over + gone
        state.update((on_time, over))
        yield pd.DataFrame({"event_type": [key[0]], "shard": [key[1]], "on_time": [on_time], "late": [over]})

    at = F.unix_millis(F.col(ts).cast("timestamp"))
    e = events.withWatermark(ts, late).select(ts, F.col(kind).alias("event_type"), F.pmod(F.xxhash64(ts), F.lit(shards)).cast("int").alias("shard"), (F.floor(at / size) * size + size).cast("long").alias("end"))
    counted = e.groupBy("event_type", "shard").applyInPandasWithState(tally, COUNTED, "on_time long, late long", "update", GroupStateTimeout.NoTimeout)
    each = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    return counted.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_events(spark: SparkSession, path: str) -> DataFrame:
    """STM-2: (event_type, on_time, late) as of the last batch of ``count_late``."""
    last = spark.read.schema(COUNTED + ", batch long").parquet(path).groupBy("event_type", "shard").agg(F.max_by(F.struct("on_time", "late"), "batch").alias("n"))
    return last.groupBy("event_type").agg(F.sum("n.on_time").alias("on_time"), F.sum("n.late").alias("late"))


def judge_runs(staging: DataFrame, judge, sink: str, checkpoint: str, key: str = "staging_id"):
    """STM-3: the batch validation of rows as they arrive, one folder a batch, so that a repeated batch writes the same place.

    Each staged row is judged once, by its ``key``. ``judge(rows, promoted)`` is given what earlier batches promoted (null
    where nothing was judged yet), so that the later rows of a run, and other runs, are held against it.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            have = spark.read.parquet(sink).filter(F.col("batch") != number)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            have = None
        new = batch.dropDuplicates([key])
        new = new.join(have.select(key), key, "left_anti") if have is not None else new
        judge(new, have.filter("decision <> 'block'").drop("batch") if have is not None else None).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return staging.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
