"""Structured Streaming: windowed bars, live signals and the streaming form of the folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.operators.fold import recent
from strandline.streaming.fold_state import FoldProcessor

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Ticks as a stream: (series_id, ts, value, event_id)."""
    src = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return src.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")


def windowed_bars(ticks: DataFrame, width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Mean, count and range per tumbling or sliding window; late rows beyond the watermark are dropped."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = ticks.withWatermark("ts", lateness).groupBy("series_id", win.alias("w")).agg(
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias("value"),
        F.count("*").alias("volume"), F.max("value").alias("high"), F.min("value").alias("low"),
    )
    return out.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "volume", "high", "low")


def session_bars(ticks: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Count and sum per session of ticks no further apart than ``gap``."""
    out = ticks.withWatermark("ts", lateness).groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("volume"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )
    return out.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "volume", "total")


class RollingSignal:
    """Sign of the value against the mean of the last n values, from a ring buffer.

    The sign is that of the difference rounded to nine digits: a value that equals the mean gives
    0, whatever the last bits of the mean.
    """

    def __init__(self, n: int):
        self.n, self.x = n, []

    def row(self, x):
        if x is None or x != x:
            return None
        recent(self.x, self.n - 1)
        self.x.append(float(x))
        if len(self.x) < self.n:
            return None
        mean = math.fsum(self.x) / self.n
        above = round(x - mean, 9)
        return (mean, 1.0 if above > 0 else -1.0 if above < 0 else 0.0)


def stream_fold(ticks: DataFrame, make: Callable[[dict], object], inputs: Sequence[str], outputs: str, keys: Sequence[str] = ("series_id",), lateness: str = "1 hour", keep: Sequence[str] = (), bucket_ms: int = 3_600_000) -> DataFrame:
    """``fold.ordered_fold`` over a stream, with the same step classes.

    Rows wait until the watermark has passed them and are then folded in time
    order, so a late row inside the lateness bound changes nothing; one beyond it
    is dropped, because a recursion cannot be rewound.  Rows of one time are folded
    in the order of their ``keep`` columns, then of their inputs (nulls last), whatever
    order they came in.  State per key is the step object and the waiting rows in buckets
    of ``bucket_ms``, of which a task holds one at a time (``fold_state.FoldProcessor``).
    Such state needs the RocksDB store, which is set if the session names another.
    """
    spark = ticks.sparkSession
    if spark.conf.get(STORE, None) != ROCKSDB:
        spark.conf.set(STORE, ROCKSDB)
    keys, inputs, keep = list(keys), list(inputs), [k for k in keep if k not in keys]
    cols = list(dict.fromkeys(["ts", *inputs, *keep]))
    src = ticks.select(*keys, *cols).withWatermark("ts", lateness)
    fields = src.schema
    names = [p.strip().split(" ")[0] for p in outputs.split(",")]
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in [*keys, "ts", *keep]) + ", " + outputs
    at = cols.index
    fold = FoldProcessor(make, keys, cols, [at(c) for c in inputs], [at(c) for c in keep], [at(c) for c in dict.fromkeys([*keep, *inputs])], names, bucket_ms)
    return src.groupBy(*keys).transformWithStateInPandas(fold, schema, "Append", "EventTime")


def live_signal(ticks: DataFrame, n: int, lateness: str = "1 hour") -> DataFrame:
    """Per-row rolling-mean signal on a stream."""
    return stream_fold(ticks, lambda k: RollingSignal(n), ["value"], "mean double, signal double", lateness=lateness, keep=["event_id", "value"])


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is available into a parquet table and stop."""
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
