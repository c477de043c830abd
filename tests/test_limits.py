"""Cases that lie beyond former limits: long groups, long halos, ties, last days, missing forecasts."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.frames import explode_rows
from strandline.functions.scalar import iterated_log, iterated_log_of
from strandline.operators import evaluate as ev, recursive as rc, resample as rs, segment as sgm, sweep, window as win
from strandline.sources import files, panels
from tests.conftest import column


def test_diebold_mariano_of_a_long_group(spark):
    n = 400_000
    p = spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").alias("ts"), F.sin(F.col("id") / 7.0).alias("d"))
    p = p.union(p.limit(150).withColumn("series_id", F.lit("b")).withColumn("d", F.col("d") + 0.1))
    got = {r["series_id"]: r for r in ev.diebold_mariano(p, F.col("d") + 1.0, F.lit(1.0)).collect()}
    for name, d in (("a", np.sin(np.arange(n) / 7.0)), ("b", np.sin(np.arange(150) / 7.0) + 0.1)):
        m = len(d)
        bw = math.floor(4 * (m / 100) ** (2 / 9))
        var = d.var(ddof=1) + sum(2 * (1 - j / (bw + 1)) * np.cov(d[j:], d[:-j])[0, 1] for j in range(1, bw + 1))
        stat = d.mean() / math.sqrt(var / m)
        assert got[name]["bandwidth"] == bw and got[name]["statistic"] == pytest.approx(stat, rel=1e-6)
        assert got[name]["p_value"] == pytest.approx(math.erfc(abs(stat) / math.sqrt(2)), abs=1e-6)
    assert got["a"]["bandwidth"] > 24


def test_iterated_log_of_any_number(spark):
    values = [-3, 0, 1, 2, 7, 8, 100, 101, 2980, 2981, 10**6, 10**15]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "n long").coalesce(1)
    got = {r["n"]: r["s"] for r in df.select("n", iterated_log_of(F.col("n")).alias("s")).collect()}
    assert got == {v: iterated_log(v) for v in values} | {None: None}


def test_a_halo_longer_than_a_segment(panel):
    p = panel({"a": [float(i * i % 17) for i in range(40)]})
    whole = column(win.rolling(p, "value", 12, ["mean"]), "mean")
    cut = sgm.segmented(sgm.number_rows(p, bucket=F.lit(0)), 11, rows=4)
    got = sgm.drop_halo(win.rolling(cut, "value", 12, ["mean"], keys=sgm.SEG_KEYS))
    assert column(got, "mean") == pytest.approx(whole, nan_ok=True)


def test_tied_rows_are_numbered_alike_in_any_order(spark):
    rows = [("a", 1 + i // 5, i, float(i)) for i in range(60)]
    numbered = []
    for k in (1, -1):
        p = spark.createDataFrame(rows[::k], "series_id string, ts int, event_id int, value double").repartition(3 + k)
        p = sgm.number_rows(p, bucket=F.lit(0), tie=["event_id"])
        numbered.append(sorted((r["event_id"], r["rn"]) for r in p.collect()))
        total = sgm.running(p, {"total": (F.col("value"), "sum")}, rows=7)
        assert {r["event_id"]: r["total"] for r in total.collect()} == {i: i * (i + 1) / 2 for i in range(60)}
    assert numbered[0] == numbered[1] == [(i, i + 1) for i in range(60)]


def test_the_last_day_counts_whole(spark):
    times = [dt.datetime(2024, 1, d, h) for d in (4, 5, 6, 7) for h in (0, 9, 23)]
    p = spark.createDataFrame([("a", t, 1.0) for t in times], "series_id string, ts timestamp_ntz, value double")
    assert rs.crop(p, "2024-01-05", "2024-01-06").count() == 6
    assert files.ingest(p, start="2024-01-05", end="2024-01-06").count() == 6
    days = p.withColumn("ts", F.to_date("ts"))
    assert rs.crop(days, "2024-01-05", "2024-01-06").count() == 6


def test_adaptive_weights_combine_the_forecasts_that_exist(panel):
    p = panel({"a": [1.0, 2.0, 1.0, 2.0, 1.0]})
    day = F.datediff("ts", F.lit("2020-01-01").cast("date"))
    f = F.array(F.when(day != 2, F.col("value")), F.lit(4.0), F.when(day == 9, 1.0))
    got = rc.adaptive_weights(p.withColumn("f", f), "value", "f", 3, rate=1.0)
    combined, weights = column(got, "combined"), column(got, "weights")
    assert len(combined) == 5
    assert combined[0] == pytest.approx(2.5) and combined[2] == pytest.approx(4.0)  # only one forecast there
    assert weights[-1][0] > weights[-1][1]
    none = rc.adaptive_weights(p.withColumn("f", F.array(F.lit(None).cast("double"))), "value", "f", 1)
    assert none.count() == 0


def test_adaptive_weights_binary(panel):
    p = panel({"a": [1.0, -1.0, 1.0, 1.0, -1.0, -1.0]}).withColumn("f", F.array(F.col("value"), F.lit(0.2)))
    got = rc.adaptive_weights(p, "value", "f", 2, rate=1.0, binary=True)
    assert set(column(got, "combined")) <= {1.0, -1.0}
    assert column(got, "combined") == [1.0, -1.0, 1.0, 1.0, -1.0, -1.0]


def test_amounts_with_more_than_cents_raise(spark):
    df = spark.createDataFrame([(0.1,), (1234567.89,), (None,)], "v double")
    assert df.agg(panels.exact_sum(F.col("v"))).first()[0] == 1234567.99
    with pytest.raises(Exception, match="two decimals"):
        df.union(spark.createDataFrame([(0.125,)], "v double")).agg(panels.exact_sum(F.col("v"))).first()


def test_expanding_adaptive_mean_is_the_plain_one(panel):
    """Running sums against a second look at all values and hits for each row."""
    r = np.random.default_rng(2)
    x, n, gamma = [float(v) for v in np.round(r.normal(size=60), 3)], 5, 0.9
    hits, want = [], []
    for i, y in enumerate(x):
        if i < n:
            continue
        values = np.array(x[:i])
        f = values.mean()
        if i > n + 2:
            h = np.array([0.0] * (i - len(hits)) + hits)
            u = h - h.mean()
            v, c = (u**2).sum(), ((values - f) * u).sum()
            if v > 0 and abs(c) > 1e-12:
                f += (gamma if c > 0 else 1 / gamma) ** math.log(i) * 2 * abs(c) / v * u[-1]
        hits.append(float(y > f))
        want.append(f)
    p = panel({"a": x}).withColumn("gamma", F.lit(gamma))
    assert column(rc.adaptive_mean(p, "value", n), "adaptive_expanding") == pytest.approx(want, abs=1e-9)


def test_large_grids_give_the_rows_that_literals_give(spark, monkeypatch):
    one = spark.range(2)
    grid = sweep.grid(n=range(120), share=[0.1, 1 / 3, 2e-9], name=["a", "it's \"b\""])
    small = explode_rows(one, grid[:400])
    monkeypatch.setattr("strandline.frames.LITERAL_ROWS", 100)
    large = explode_rows(one, grid[:400])
    assert large.dtypes == small.dtypes and sorted(large.collect()) == sorted(small.collect())
    assert explode_rows(one, sweep.grid(n=range(300), d=range(100))).count() == 60_000


def test_spans_that_are_open_on_the_first_row(panel):
    p = panel({"a": [1, 1, 0, 1, 0]})
    assert win.flag_spans(p, "value").count() == 1
    got = [(r["start"].day, r["end"].day) for r in win.flag_spans(p, "value", open_start=True).collect()]
    assert sorted(got) == [(1, 3), (4, 5)]
