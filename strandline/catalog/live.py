"""Streaming queries, run over the files available and read back from the table they write.

A stream emits what its watermark has closed: the latest tick less the lateness.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog.registry import query
from strandline.session import shared_dir
from strandline.streaming import live as lv


def run(spark, path, build):
    ticks = lv.event_stream(spark, path)
    made = build(ticks)
    base = shared_dir(spark)
    lv.drain(made, f"{base}/table", f"{base}/checkpoint")
    return spark.read.schema(made.schema).parquet(f"{base}/table")


@query("L4_tumbling_bars", """
select event_type as series_id, date_trunc('day', ts) as "start", cast(sum(cast(value as decimal(18,2))) as double) / count(*) as value, count(*) as volume, max(value) as high, min(value) as low
from events group by 1, 2 having date_trunc('day', min(ts)) + interval 1 day <= (select max(ts) - interval 1 hour from events)""".replace("cast(sum(cast(value as decimal(18,2))) as double) / count(*) as value", "round(cast(sum(cast(value as decimal(18,2))) as double) / count(*), 6) as value"))
def _(spark, path):
    return run(spark, path, lambda t: lv.windowed_bars(t, "1 day")).select("series_id", F.col("start").cast("timestamp_ntz").alias("start"), "value", "volume", "high", "low")


@query("L4_sliding_bars", """
with w as (select event_type as series_id, value, unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) as s from events)
select series_id, s as "start", round(cast(sum(cast(value as decimal(18,2))) as double) / count(*), 6) as value, count(*) as volume from w group by 1, 2
having s + interval 12 hour <= (select max(ts) - interval 1 hour from events)""")
def _(spark, path):
    return run(spark, path, lambda t: lv.windowed_bars(t, "12 hours", "6 hours")).select("series_id", F.col("start").cast("timestamp_ntz").alias("start"), "value", "volume")


@query("L4_session_bars", """
with e as (select event_type as series_id, ts, value, (ts - lag(ts) over (partition by event_type order by ts) <= interval 30 minute)::int as same from events),
s as (select *, sum(1 - coalesce(same, 0)) over (partition by series_id order by ts) as sid from e)
select series_id, min(ts) as "start", count(*) as volume, round(cast(sum(cast(value as decimal(18,2))) as double), 6) as total from s group by series_id, sid
having max(ts) + interval 30 minute <= (select max(ts) - interval 1 hour from events)""")
def _(spark, path):
    return run(spark, path, lambda t: lv.session_bars(t, "30 minutes")).select("series_id", F.col("start").cast("timestamp_ntz").alias("start"), "volume", "total")


@query("L1_live_signal", """
with m as (select event_type as series_id, event_id, ts, value, case when count(*) over w = 20 then avg(value) over w end as mean from events window w as (partition by event_type order by ts rows between 19 preceding and current row))
select series_id, event_id, round(mean, 6) as mean, sign(round(value - mean, 9)) as signal from m where mean is not null and ts <= (select date_trunc('milliseconds', max(ts) - interval 1 hour) from events)""")
def _(spark, path):
    return run(spark, path, lambda t: lv.live_signal(t, 20)).select("series_id", "event_id", "mean", "signal")


@query("L2_live_online_kernel")
def _(spark, path):
    from strandline.operators.recursive import KERNEL, OnlineKernel

    made = run(spark, path, lambda t: lv.stream_fold(t, lambda k: OnlineKernel(), ["value"], KERNEL, keep=["event_id"]))
    return made.select("series_id", "event_id", "forecast", "signal", "error", "entropy")
