"""Structured Streaming versions of enrichment, call monitoring, routing shares and streak alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.attributes import extract_attributes_v1
from ..operators.joins import price_calls
from ..session import fresh_path


def enrich_stream(products: DataFrame, event_time: str, delay: str = "10 minutes", key: str = "product_id") -> DataFrame:
    """Attributes of arriving products; repeats of a product inside the watermark are ignored."""
    once = products.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return extract_attributes_v1(once)


def call_log_stream(calls: DataFrame, event_time: str, window: str = "1 hour", slide: str | None = None,
                    delay: str = "10 minutes") -> DataFrame:
    """Calls, errors, mean latency and cost per model and window; rows behind the watermark are dropped."""
    w = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return price_calls(calls.withWatermark(event_time, delay)).groupBy(w, "model").agg(
        F.count("*").alias("calls"), F.count(F.when(~F.col("success"), 1)).alias("errors"),
        F.avg("latency_ms").alias("avg_latency_ms"), F.sum("cost").alias("cost"))


def routing_stats_stream(routed: DataFrame, event_time: str, window: str = "1 day", delay: str = "1 hour",
                         tiers: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Rows and share of each tier per window, in one aggregation."""
    n = F.count("*")
    shares = [F.round(100.0 * F.count(F.when(F.col("routing_tier") == t, 1)) / n, 4).alias(f"tier{t}_pct") for t in tiers]
    return routed.withWatermark(event_time, delay).groupBy(F.window(event_time, window)).agg(n.alias("n"), *shares)


def streak_alerts(log: DataFrame, key: str, sequence: str, failed: str, n: int = 15) -> DataFrame:
    """An alert row at every n-th consecutive failure of a key; the count survives across batches.

    State is one integer per key.  Rows of a key are ordered inside a micro-batch, whose
    size the source limits; only (sequence, failed) pairs are held for that.
    """
    def scan(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        parts = [(c[sequence].to_numpy(), c[failed].to_numpy(bool)) for c in chunks]  # nine bytes a row
        order, bads = (np.concatenate(x) for x in zip(*parts))
        place = np.argsort(order, kind="stable")
        alerts = []
        for s, bad in zip(order[place].tolist(), bads[place].tolist()):
            run = run + 1 if bad else 0
            if run == n:
                alerts.append(s)
                run = 0
        state.update((run,))
        yield pd.DataFrame({key: [k[0]] * len(alerts), sequence: alerts, "streak": [n] * len(alerts)})
    return log.select(key, sequence, failed).groupBy(key).applyInPandasWithState(
        scan, f"{key} long, {sequence} long, streak long", "run long", "append", GroupStateTimeout.NoTimeout)


class StreakProcessor(StatefulProcessor):
    """Counts consecutive failures of a key in event time.

    Arriving rows are packed into the key's buckets of event time, chunk by chunk. When the watermark passes the end of a
    bucket, its timer puts the bucket's rows in order, counts on from the run so far and drops the bucket. A second timer
    drops the run of a key that has been idle. Held are one run and the open buckets of each active key.
    """

    ROW = np.dtype([("at", "<i8"), ("sequence", "<i8"), ("failed", "?")])

    def __init__(self, key: str, sequence: str, n: int, bucket_ms: int, idle_ms: int):
        self.key, self.sequence, self.n, self.bucket_ms, self.idle_ms = key, sequence, n, bucket_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "length long, until long")
        self.open = handle.getMapState("open", "bucket long", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        for chunk in rows:
            packed = np.empty(len(chunk), self.ROW)
            packed["at"], packed["sequence"], packed["failed"] = chunk["event_ms"], chunk[self.sequence], chunk["is_failed"]
            end = packed["at"] // self.bucket_ms * self.bucket_ms + self.bucket_ms
            for e in np.unique(end[end > closed]).tolist():  # a row of a closed bucket is late and left out
                held = self.open.getValue((e,))[0] if self.open.containsKey((e,)) else b""
                self.open.updateValue((e,), (held + packed[end == e].tobytes(),))
                if not held:
                    self.handle.registerTimer(e)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        length, until = self.run.get() if self.run.exists() else (0, 0)
        if not self.open.containsKey((now,)):
            if now >= until:
                self.run.clear()
            return
        rows = np.sort(np.frombuffer(self.open.getValue((now,))[0], self.ROW), order=["at", "sequence"])
        self.open.removeKey((now,))
        if now - self.bucket_ms >= until:  # the key was idle before this bucket
            length = 0
        alerts = []
        for s, bad in zip(rows["sequence"].tolist(), rows["failed"].tolist()):
            length = length + 1 if bad else 0
            if length == self.n:
                alerts.append(s)
                length = 0
        until = now + self.idle_ms
        if until <= timerValues.getCurrentWatermarkInMs() and not self.open.exists():
            self.run.clear()
        else:
            self.run.update((length, until))
            self.handle.registerTimer(until)
        if alerts:
            yield pd.DataFrame({self.key: [key[0]] * len(alerts), self.sequence: alerts, "streak": [self.n] * len(alerts)})

    def close(self) -> None:
        pass


def timed_streak_alerts(log: DataFrame, key: str, sequence: str, failed: str, event_time: str, n: int = 15, bucket: str = "1 hour",
                        idle: str = "7 days", delay: str = "10 minutes") -> DataFrame:
    """Streak alerts in order of event time (then `sequence`), across micro-batches in any order of arrival.

    Alerts of a bucket appear when the watermark passes its end; rows that arrive after that are late and ignored, and
    the count goes on without them. A key without rows for `idle` starts again from nothing and holds no state. State with
    a time to live exists for processing time only, so event-time timers do it. Needs the RocksDB state store
    (`state_store`); `key` and `sequence` are longs.
    """
    span = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    rows = log.withWatermark(event_time, delay).select(key, sequence, event_time, F.unix_millis(event_time).alias("event_ms"), F.coalesce(failed, F.lit(False)).alias("is_failed"))
    processor = StreakProcessor(key, sequence, n, span(bucket), span(idle))
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} long, {sequence} long, streak long", "Append", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on disk with checkpointed changes, not in the executors' heaps."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def file_stream(spark: SparkSession, folder: str, table: str, max_files: int | None = None) -> DataFrame:
    """Stream over the parquet file(s) of a table."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{table}.parquet").schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{folder}/{table}.parque[t]")  # a glob may name a file or a folder


def drain_steps(spark: SparkSession, steps: Iterable[DataFrame], job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Append each step's rows to a folder and process what is new there, stopping and restarting the job from its
    checkpoint after every step; returns the sink's rows. The steps must have the same columns."""
    source, out, log = (fresh_path(spark, f"{name}-{part}") for part in ("in", "out", "log"))
    result = None
    with state_store(spark):
        for step in steps:
            step.write.mode("append").parquet(source)
            result = job(spark.readStream.schema(step.schema).parquet(source))
            result.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(
                availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available into a parquet sink with a checkpoint and return the sink's rows."""
    spark = stream.sparkSession
    out, log = fresh_path(spark, name), fresh_path(spark, f"{name}-log")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
