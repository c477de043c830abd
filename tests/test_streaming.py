"""Streams against their batch form: order, lateness, restarts."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import recursive as rc, window as win
from strandline.operators.fold import ordered_fold
from strandline.streaming import live as lv

T0 = dt.datetime(2024, 1, 1)


def write(folder, name, rows):
    """One JSON file per trigger: (series, minute, value)."""
    f = folder / name
    f.write_text("\n".join(json.dumps({"series_id": s, "ts": (T0 + dt.timedelta(minutes=m)).isoformat(), "value": float(v), "event_id": i}) for i, (s, m, v) in enumerate(rows)))
    # the file source reads in order of modification time: make that the order of names
    stamp = 1_700_000_000 + 10 * int(name.split(".")[0])
    os.utime(f, (stamp, stamp))


def source(spark, folder):
    return spark.readStream.schema("series_id string, ts timestamp, value double, event_id long").option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.fixture
def files(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    return src


def collect(spark, stream, tmp_path, name="out"):
    lv.drain(stream, str(tmp_path / name), str(tmp_path / f"{name}-ck"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()


def test_out_of_order_rows_within_the_lateness_change_nothing(spark, files, tmp_path):
    rows = [("a", m, (m * 7) % 11) for m in range(12)] + [("b", m, m) for m in range(12)]
    late = [("a", 3, 21 % 11)]
    write(files, "0.json", [r for r in rows[:6] + rows[12:18] if r not in late])
    write(files, "1.json", late + rows[6:12] + rows[18:])
    write(files, "2.json", [("a", 500, 0), ("b", 500, 0)])
    stream = lv.stream_fold(source(spark, files), lambda k: rc.Ewma(3.0), ["value"], "ewma double", lateness="30 minutes")
    got = sorted((r["series_id"], r["ts"], round(r["ewma"], 9)) for r in collect(spark, stream, tmp_path))
    batch = spark.createDataFrame([(s, T0 + dt.timedelta(minutes=m), float(v)) for s, m, v in rows], "series_id string, ts timestamp, value double")
    want = sorted((r["series_id"], r["ts"], round(r["ewma"], 9)) for r in ordered_fold(batch, lambda k: rc.Ewma(3.0), ["value"], "ewma double").collect())
    assert got == want


def test_rows_of_one_time_are_folded_in_the_order_of_their_ids(spark, tmp_path):
    rows = [{"series_id": "a", "ts": T0.isoformat(), "value": float(v) if v != 3 else None, "event_id": v} for v in range(6)]
    last = [{"series_id": "a", "ts": (T0 + dt.timedelta(days=1)).isoformat(), "value": 0.0, "event_id": 9}]
    got = []
    for n, some in enumerate((rows, rows[::-1])):
        src = tmp_path / f"in{n}"
        src.mkdir()
        for k, part in enumerate((some, last)):
            (src / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
            os.utime(src / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)
        stream = lv.live_signal(source(spark, src), 2, "10 minutes")
        got.append(sorted((r["event_id"], r["mean"]) for r in collect(spark, stream, tmp_path, f"out{n}")))
    assert got == [[(1, 0.5), (2, 1.5), (4, 3.0), (5, 4.5)]] * 2


def test_rows_beyond_the_watermark_are_dropped(spark, files, tmp_path):
    write(files, "0.json", [("a", m, 1) for m in range(100)])
    write(files, "1.json", [("a", 200, 1)])
    write(files, "2.json", [("a", 5, 1000), ("a", 400, 1)])
    write(files, "3.json", [("a", 900, 1)])
    got = collect(spark, lv.live_signal(source(spark, files), 3, "10 minutes"), tmp_path)
    assert got and all(r["mean"] == 1 for r in got)


def test_live_signal_equals_batch_rolling(spark, files, tmp_path):
    values = [(i * 37) % 23 for i in range(60)]
    for f in range(4):
        write(files, f"{f}.json", [("a", m, values[m]) for m in range(15 * f, 15 * f + 15)])
    write(files, "9.json", [("a", 5000, 0)])
    got = {r["ts"]: (round(r["mean"], 9), r["signal"]) for r in collect(spark, lv.live_signal(source(spark, files), 5, "1 minute"), tmp_path)}
    df = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=m), float(v)) for m, v in enumerate(values)], "series_id string, ts timestamp, value double")
    want = {r["ts"]: (round(r["mean"], 9), r["s"]) for r in win.rolling(df, "value", 5, ["mean"]).withColumn("s", F.signum(F.col("value") - F.col("mean"))).filter("mean is not null").collect()}
    assert got == want


def test_a_value_equal_to_the_mean_gives_no_signal():
    """As in the SQL of L1_live_signal: the last bits of a mean of equal values are no signal."""
    step = lv.RollingSignal(20)
    made = [step.row(x) for x in [58.37] * 40 + [29.44] * 20]
    assert made[:19] == [None] * 19
    assert [m[1] for m in made[19:40]] == [0.0] * 21
    assert [m[1] for m in made[40:]] == [-1.0] * 19 + [0.0]


def test_many_values_at_once_give_what_single_ones_give():
    """Kernel and entropy in blocks, across cuts, missing values and constant stretches."""
    rng = np.random.default_rng(7)
    x = np.round(rng.exponential(50, 700), 2)
    x[[3, 90, 91]] = np.nan
    x[300:307] = x[300]
    for memory in (2, 5):
        one, many = rc.OnlineKernel(memory=memory), rc.OnlineKernel(memory=memory)
        want = {i: made for i, v in enumerate(x.tolist()) if (made := one.row(v)) is not None}
        got = {}
        for a, b in ((0, 1), (1, 4), (4, 4), (4, 200), (200, 700)):
            at, columns = many.rows(x[a:b], most=64)
            got |= {a + int(i): made for i, *made in zip(at, *columns, strict=True)} if len(at) else {}
        assert list(got) == list(want)
        assert np.array_equal(np.array([*got.values()], float), np.array([*want.values()], float), equal_nan=True)


def test_ids_beyond_doubles_and_missing_ones_keep_their_order(spark, files, tmp_path):
    """Waiting rows of one time lie in two chunks, one of them with a null id (nulls last)."""
    big = 1 << 60
    at = lambda m: (T0 + dt.timedelta(minutes=m)).isoformat()
    for k, rows in enumerate(([(0, big + 1, 2.0)], [(0, None, 9.0)], [(0, big, 1.0)], [(500, 0, 0.0)])):
        (files / f"{k}.json").write_text("\n".join(json.dumps({"series_id": "a", "ts": at(m), "value": v, "event_id": i}) for m, i, v in rows))
        os.utime(files / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)
    stream = lv.stream_fold(source(spark, files), lambda k: lv.RollingSignal(1), ["value"], "mean double, signal double", lateness="1 hour", keep=["event_id", "value"])
    got = collect(spark, stream, tmp_path)
    assert sorted((r["event_id"] or 0, r["mean"]) for r in got) == [(0, 9.0), (big, 1.0), (big + 1, 2.0)]


def test_restart_continues_from_the_checkpoint(spark, files, tmp_path):
    make = lambda: lv.stream_fold(source(spark, files), lambda k: rc.OnlineKernel(memory=3), ["value"], rc.KERNEL, lateness="1 minute")
    write(files, "0.json", [("a", m, m % 5) for m in range(20)])
    lv.drain(make(), str(tmp_path / "o"), str(tmp_path / "ck"))
    write(files, "1.json", [("a", m, m % 5) for m in range(20, 40)] + [("a", 900, 0)])
    lv.drain(make(), str(tmp_path / "o"), str(tmp_path / "ck"))
    got = sorted((r["ts"], round(r["forecast"], 9)) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    df = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=m), float(m % 5)) for m in range(40)], "series_id string, ts timestamp, value double")
    want = sorted((r["ts"], round(r["forecast"], 9)) for r in rc.online_kernel(df, "value", memory=3).collect())
    assert got == want


def test_windowed_and_session_bars(spark, files, tmp_path):
    write(files, "0.json", [("a", m, m) for m in (0, 5, 12, 40, 41)])
    write(files, "1.json", [("a", 600, 0)])
    bars = {r["start"]: r["volume"] for r in collect(spark, lv.windowed_bars(source(spark, files), "10 minutes", lateness="1 minute"), tmp_path)}
    at = lambda m: T0 + dt.timedelta(minutes=m)
    assert bars == {at(0): 2, at(10): 1, at(40): 2}
    sessions = {r["start"]: r["volume"] for r in collect(spark, lv.session_bars(source(spark, files), "15 minutes", "1 minute"), tmp_path, "s")}
    assert sessions == {at(0): 3, at(40): 2}


def test_a_backlog_of_one_key_in_one_file_with_ties_and_a_restart(spark, files, tmp_path):
    """Many hours wait in one batch; rows of one time, and a bucket cut by the watermark, come out as in batch."""
    minutes = [(i * 7) % 600 for i in range(400)]
    write(files, "0.json", [("a", m, i % 9) for i, m in enumerate(minutes)])
    make = lambda: lv.stream_fold(source(spark, files), lambda k: rc.Ewma(3.0), ["value"], "ewma double", lateness="90 minutes", keep=["event_id"], bucket_ms=1_800_000)
    lv.drain(make(), str(tmp_path / "o"), str(tmp_path / "ck"))
    write(files, "1.json", [("a", 5000, 0)])
    lv.drain(make(), str(tmp_path / "o"), str(tmp_path / "ck"))
    got = sorted((r["ts"], r["event_id"], round(r["ewma"], 9)) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    batch = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=m), float(i % 9), i) for i, m in enumerate(minutes)], "series_id string, ts timestamp, value double, event_id long")
    made = ordered_fold(batch, lambda k: rc.Ewma(3.0), ["value"], "ewma double", keep=["event_id"], tie=["event_id"])
    assert got == sorted((r["ts"], r["event_id"], round(r["ewma"], 9)) for r in made.collect())
