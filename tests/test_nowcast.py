"""Nowcast: features of mixed frequency, refits from running moments, the AR(1) benchmark."""

import datetime as dt

import numpy as np
import pytest

from strandline.operators import nowcast as nc

DAY0 = dt.date(2020, 1, 1)


def day(k):
    return DAY0 + dt.timedelta(days=k)


def table_of(spark, n, p, seed, nulls=()):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + 3
    x[:, -1] = 2.0  # a constant feature
    y = x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=n)
    rows = [("s", day(k), None if k in nulls else float(y[k]), *map(float, x[k])) for k in range(n)]
    names = [f"x{j}" for j in range(p)]
    return spark.createDataFrame(rows, "series_id string, ts date, y double, " + ", ".join(f"{c} double" for c in names)), names, x, y


def test_newest_values_fewer_take_the_date_before(spark):
    bars = [("a", day(k), float(k)) for k in range(0, 30, 5)] + [("a", day(60), None), ("a", day(100), 7.0), ("b", day(2), 1.0)]
    bars = spark.createDataFrame(bars, "series_id string, ts date, x double")
    dates = spark.createDataFrame([(day(k),) for k in (4, 10, 25, 60, 100)], "ts date")
    got = {r.ts: (r.a_1, r.a_2, r.a_3) for r in nc.recent_values(bars, dates, ["a", "gone"], "x", 15, 2, 3).collect()}
    assert got[day(4)] == (None, None, None)  # one value only, nothing before
    assert got[day(10)] == (10.0, 5.0, 0.0)  # the bar of the date itself counts
    assert got[day(25)] == (25.0, 20.0, 15.0)  # both ends of the window count
    assert got[day(60)] == got[day(100)] == (25.0, 20.0, 15.0)


def test_empty_bars_give_dates_without_values(spark):
    none = spark.createDataFrame([], "series_id string, ts date, x double")
    dates = spark.createDataFrame([(day(1),)], "ts date")
    assert [tuple(r) for r in nc.recent_values(none, dates, ["a"], "x", 5, 1, 1).collect()] == [(day(1), None)]
    assert nc.recent_values(none, dates.limit(0), ["a"], "x", 5, 1, 1).count() == 0


def test_no_penalty_is_least_squares_of_the_rows_before(spark):
    df, names, x, y = table_of(spark, 40, 4, 1, nulls=(5, 20))
    rows = nc.expanding_net(df, "y", names, 12).orderBy("ts").collect()
    whole = [k for k in range(40) if k not in (5, 20)]
    assert [r.ts for r in rows] == [day(k) for k in whole[12:]]
    for r, k in zip(rows, whole[12:]):
        past = [j for j in whole if j < k]
        w = np.linalg.lstsq(x[past], y[past], rcond=None)[0]  # the constant feature is the intercept
        assert r.n == len(past) and r.forecast == pytest.approx(x[k] @ w, abs=1e-7)


@pytest.mark.parametrize("mix", [0.0, 0.5, 1.0])
def test_penalty_meets_the_conditions_of_the_minimum(spark, mix):
    df, names, x, y = table_of(spark, 30, 12, 2)
    rows = nc.expanding_net(df, "y", names, 8, [0.5, 0.1, 0.05], mix).orderBy("ts").collect()
    assert len(rows) == 22 and max(r.gap for r in rows) < 1e-8
    assert mix == 0 or min(r.used for r in rows) < 11
    for r in rows[::7]:  # the same minimum by a plain proximal gradient over the rows themselves
        a, b = x[: r.n], y[: r.n]
        sd = a.std(axis=0)
        sd[sd == 0] = np.inf
        u, v, w = (a - a.mean(axis=0)) / sd, b - b.mean(), np.zeros(12)
        rate = 1 / (np.linalg.eigvalsh(u.T @ u / r.n).max() + r.penalty * (1 - mix))
        for _ in range(60_000):
            step = w - rate * (u.T @ (u @ w - v) / r.n + r.penalty * (1 - mix) * w)
            w = np.sign(step) * np.maximum(np.abs(step) - rate * r.penalty * mix, 0)
        assert r.forecast == pytest.approx(b.mean() + (x[r.n] - a.mean(axis=0)) / sd @ w, abs=1e-5)


def test_penalty_follows_earlier_errors_only(spark):
    df, names, x, y = table_of(spark, 40, 6, 3)
    grid = [1.0, 0.3, 0.01]
    alone = {a: [r.forecast for r in nc.expanding_net(df, "y", names, 10, [a]).orderBy("ts").collect()] for a in grid}
    rows = nc.expanding_net(df, "y", names, 10, grid).orderBy("ts").collect()
    total = np.zeros(3)
    for k, r in enumerate(rows):
        best = grid[int(total.argmin())]
        assert r.penalty == best and r.forecast == pytest.approx(alone[best][k], abs=1e-7)
        total += [(alone[a][k] - y[10 + k]) ** 2 for a in grid]


def test_later_rows_change_no_earlier_forecast(spark):
    df, names, *_ = table_of(spark, 30, 4, 4)
    cut = [tuple(r) for r in nc.expanding_net(df.filter(df.ts < day(20)), "y", names, 8, [0.1]).orderBy("ts").collect()]
    assert cut == [tuple(r) for r in nc.expanding_net(df, "y", names, 8, [0.1]).orderBy("ts").collect()][: len(cut)]
    ar = nc.ar_benchmark(df, "y").orderBy("ts").collect()
    y = [r.y for r in ar]
    slope, level = np.polyfit(y[:14], y[1:15], 1)
    assert ar[15].benchmark == pytest.approx(level + slope * y[14], abs=1e-9)
    assert [r.benchmark for r in ar[:2]] == [None, None]


def test_wrong_settings_raise(spark):
    df, names, *_ = table_of(spark, 12, 3, 5)
    for bad in ({"first": 1}, {"first": 5, "penalties": []}, {"first": 5, "penalties": [-1.0]}, {"first": 5, "mix": 2.0}):
        with pytest.raises(ValueError):
            nc.expanding_net(df, "y", names, **bad)
    with pytest.raises(ValueError):
        nc.recent_values(df, df.select("ts"), [], "y", 5, 1, 1)
