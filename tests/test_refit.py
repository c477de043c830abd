"""The refitted sign classifier: gradient, schedule, warm start, nothing from later rows."""

import datetime as dt

import numpy as np
import pytest

from strandline.operators import refit as rf

DAY0 = dt.date(2020, 1, 1)


def table_of(spark, x, y, key="s"):
    rows = [(key, DAY0 + dt.timedelta(days=k), None if y[k] is None else float(y[k]), *map(float, x[k])) for k in range(len(y))]
    return spark.createDataFrame(rows, "series_id string, ts date, y double, " + ", ".join(f"x{j} double" for j in range(x.shape[1])))


def rule(n, seed):
    """The sign is that of a product: no linear rule finds it."""
    x = np.random.default_rng(seed).normal(size=(n, 2))
    return x, x[:, 0] * x[:, 1]


def test_slopes_are_those_of_the_error():
    x, y = rule(30, 1)
    net = rf.SignNet(2, (4, 3))

    def error():
        return 0.5 * float(((net.outputs(x)[-1][:, 0] - np.sign(y)) ** 2).mean())

    found = net.slopes(x, np.sign(y))
    for layer, slopes in zip(net.layers, found):
        for values, slope in zip(layer, slopes):
            for at in np.ndindex(values.shape):
                kept = values[at]
                values[at] = kept + 1e-6
                up = error()
                values[at] = kept - 1e-6
                down = error()
                values[at] = kept
                assert slope[at] == pytest.approx((up - down) / 2e-6, abs=1e-7)


def test_schedule_base_and_signal(spark):
    x, y = rule(60, 2)
    y = [None if k in (3, 30) else 0.0 if k == 31 else v for k, v in enumerate(y)]
    rows = rf.expanding_sign_network(table_of(spark, x, y), "y", ["x0", "x1"], 20, 15, (3,), 20).orderBy("ts").collect()
    whole = [k for k in range(60) if y[k] is not None]
    assert [(r.ts - DAY0).days for r in rows] == whole[20:]
    for i, r in enumerate(rows):
        k = 20 + i
        assert (r.refits, r.trained) == (i // 15 + 1, 20 + i // 15 * 15)
        assert r.label == np.sign(y[whole[k]]) and r.base == pytest.approx(np.mean(np.sign([y[j] for j in whole[:k]])))
        assert r.signal == (-1.0 if r.answer < r.base else 1.0)


def test_later_rows_change_nothing_before_and_the_answer_ignores_its_own_label(spark):
    x, y = rule(70, 3)
    args = ("y", ["x0", "x1"], 20, 15, (3,), 30)
    whole = rf.expanding_sign_network(table_of(spark, x, y), *args).orderBy("ts").collect()
    cut = rf.expanding_sign_network(table_of(spark, x[:50], y[:50]), *args).orderBy("ts").collect()
    assert whole[: len(cut)] == cut
    turned = rf.expanding_sign_network(table_of(spark, x[:50], [*y[:49], -y[49]]), *args).orderBy("ts").collect()
    assert turned[-1].answer == cut[-1].answer and turned[-1].label == -cut[-1].label


def test_refits_go_on_from_the_weights_before():
    x, y = rule(40, 4)
    step = rf.RefitStep(2, 20, 20, (4,), 10, 0.05)
    for a, b in zip(x, y):
        step.row(a, b)
    alone = rf.SignNet(2, (4,))
    part = x[:20]
    alone.train((part - part.mean(axis=0)) / part.std(axis=0), np.sign(y[:20]), 10, 0.05)
    for (w, b), (v, c) in zip(step.net.layers, alone.layers):
        assert np.allclose(w, v) and np.allclose(b, c)
    step.row(x[0], y[0])  # row 41: the second refit, on 40 rows
    alone.train((x - x.mean(axis=0)) / x.std(axis=0), np.sign(y), 10, 0.05)
    assert all(np.allclose(w, v) for (w, _), (v, _) in zip(step.net.layers, alone.layers))


def test_learns_what_no_linear_rule_finds(spark):
    x, y = rule(700, 5)
    d = table_of(spark, x, y).unionByName(table_of(spark, np.c_[x, np.ones(700)][:, [0, 2]], y, "flat"))  # a constant feature
    rows = rf.expanding_sign_network(d, "y", ["x0", "x1"], 126, 126, (8, 4), 1500, 0.1).collect()
    late = [r for r in rows if r.trained > 500 and r.series_id == "s"]
    assert np.mean([r.signal == r.label for r in late]) > 0.85
    assert all(abs(r.answer) <= 1 for r in rows) and len(rows) == 2 * (700 - 126)


def test_empty_short_and_wrong(spark):
    x, y = rule(10, 6)
    d = table_of(spark, x, y)
    assert rf.expanding_sign_network(d, "y", ["x0"], 10, 5).count() == 0
    assert rf.expanding_sign_network(d.limit(0), "y", ["x0"]).count() == 0
    for bad in ({"first": 1}, {"every": 0}, {"hidden": (0,)}):
        with pytest.raises(ValueError):
            rf.expanding_sign_network(d, "y", ["x0"], **bad)
