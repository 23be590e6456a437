"""Structured Streaming forms of the session rules and the monthly rollup.

* ``idle_sessions_stream``: T1 as ``session_window(ts, 30 minutes)`` with a
  watermark; append mode emits each session once it can no longer grow.
* ``sessions_stream``: T1 + T2, for events in any order: the same windows with
  the event times of each session that may still grow in their state; once the
  watermark closes one, the age rule cuts its times.
* ``customer_month_stream``: the customer-month rollup as a streaming
  aggregate keyed by the month start, evicted by the watermark.

``run_to_parquet`` drives a stream over the available input with
``availableNow``. Only when all data has been read does an end-of-input marker
(a single far-future row) appear in a second watched folder, and a further run
of the same checkpointed query reads it, so that the final sessions are closed
and emitted without making any data late.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.functions import columns as C
from recurra.functions.constants import SESSION_IDLE_SECONDS, SESSION_MAX_AGE_SECONDS
from recurra.session import shared_path

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
# Far enough ahead to close every real session, and inside pandas' range.
END_MARKER_TS = "2200-01-01 00:00:00"
END_MARKER_USER = -1
SESSION_OUT = "user_id long, session_start timestamp, session_end timestamp, n_events long"


def idle_sessions_stream(events: DataFrame, idle_seconds: int = SESSION_IDLE_SECONDS,
                         watermark: str = "1 hour") -> DataFrame:
    """T1 on a stream. A gap of exactly the idle limit stays in the session
    (session windows merge when the next event is not after the window end)."""
    gap = f"{idle_seconds} seconds"
    return (events.withWatermark("ts", watermark)
                  .groupBy("user_id", F.session_window("ts", gap).alias("w"))
                  .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
                       F.count(F.lit(1)).alias("n_events")))


def _cut_by_age(max_age_us: int):
    """Closed idle sessions (user_id, times in order) to sessions: where one is longer than the limit, each starts
    with the first event more than the limit after the start before it."""
    def run(batches):
        for b in batches:
            lists = b.column("times")
            at, t = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            first, end = at[:-1], at[1:]
            row, start, stop = [], [], []
            for k in np.flatnonzero(t[end - 1] - t[first] > max_age_us).tolist():
                i = int(first[k])
                while i < end[k]:
                    j = i + int(np.searchsorted(t[i:end[k]], t[i] + max_age_us, "right"))
                    row.append(k), start.append(i), stop.append(j)
                    i = j
            whole = np.flatnonzero(t[end - 1] - t[first] <= max_age_us)
            row = np.concatenate([whole, np.array(row, np.int64)])
            start = np.concatenate([first[whole], np.array(start, np.int64)])
            stop = np.concatenate([end[whole], np.array(stop, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column("user_id").take(pa.array(row)), pa.array(t[start]), pa.array(t[stop - 1]), pa.array(stop - start)],
                                             ["user_id", "start_us", "end_us", "n_events"])
    return run


def sessions_stream(events: DataFrame, idle_seconds: int = SESSION_IDLE_SECONDS,
                    max_age_seconds: int = SESSION_MAX_AGE_SECONDS, watermark: str = "1 hour") -> DataFrame:
    """T1 + T2 on a stream of events in any order.

    Events that the watermark has passed by the idle limit when they come are left
    out by Spark and counted in the query's progress (``late_rows``; events of a user
    with equal time that one task read count once).
    """
    keyed = events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", watermark)
    closed = (keyed.groupBy("user_id", F.session_window("ts", f"{idle_seconds} seconds").alias("w"))
                   .agg(F.sort_array(F.collect_list("t")).alias("times")).select("user_id", "times"))
    out = closed.mapInArrow(_cut_by_age(max_age_seconds * 1_000_000), "user_id long, start_us long, end_us long, n_events long")
    return out.select("user_id", F.timestamp_micros("start_us").alias("session_start"), F.timestamp_micros("end_us").alias("session_end"), "n_events")


def late_rows(progress: list) -> int:
    """Rows that came after the watermark had passed them, over all micro-batches of a query."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p["stateOperators"])


def customer_month_stream(subs: DataFrame, watermark: str = "31 days") -> DataFrame:
    """The customer-month rollup on a stream of clean facts (dated rows)."""
    paying = C.is_paying()
    amt = C.money(F.col("amount"))
    return (subs.where(F.col("date").isNotNull())
                .withColumn("month_start", F.date_trunc("month", F.col("date").cast("timestamp")))
                .withWatermark("month_start", watermark)
                .groupBy("tenant_id", "customer_id", "month_start")
                .agg(F.sum(F.when(paying, amt)).alias("paying_amt"),
                     F.count_if(paying).alias("n_paying_rows"),
                     F.count_if(F.col("status") == "active").alias("n_active_status"),
                     F.sum(F.when(F.col("amount") < 0, -amt)).alias("refund_abs"),
                     F.count(F.lit(1)).alias("n_rows")))


#: State beyond the executors' heap lies on disk in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_parquet(spark: SparkSession, build, source: str, schema: str, marker_row: dict,
                   name: str, max_bytes: str | None = None, progress: list | None = None) -> DataFrame:
    """Run ``build(stream_df)`` over ``source`` (all available files) into a
    parquet sink under the shared folder and return the sink as a batch
    DataFrame.

    Without ``max_bytes`` all files are read in one micro-batch. With it, files
    are read batch by batch in order of their modification time, and the
    watermark delay of ``build`` must cover how far files are out of event-time
    order; what is later still is counted in ``progress`` (``late_rows``).
    """
    base = shared_path(spark, f"stream-{name}-{uuid.uuid4().hex[:8]}")
    marker = os.path.join(base, "end-marker")
    spark.createDataFrame([], schema).write.parquet(marker)
    reader = spark.readStream.schema(schema)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if source.endswith(".parquet") and _is_file(spark, source):
        # A single-file table: watch its folder, admit only that file name.
        folder, fname = os.path.split(source.rstrip("/"))
        data = reader.option("pathGlobFilter", fname).parquet(folder)
    else:
        data = reader.parquet(source)
    end = spark.readStream.schema(schema).parquet(marker)
    out = build(data.unionByName(end))

    def run():
        q = (out.writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", os.path.join(base, "checkpoint"))
                .option("path", os.path.join(base, "sink"))
                .trigger(availableNow=True).start())
        q.awaitTermination()
        if progress is not None:
            progress.extend(q.recentProgress)

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        run()
        spark.createDataFrame([marker_row], schema).coalesce(1).write.mode("append").parquet(marker)
        run()  # reads the marker: the watermark passes every real event
        run()  # evicts what that watermark closes
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(out.schema).parquet(os.path.join(base, "sink"))


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
