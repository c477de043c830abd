"""Operators without an SQL oracle, against plain loops and NumPy on small panels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.frames import explode_rows
from strandline.operators import forecast, ml, recursive as rc, regress as rg, signals as sg, spectral, sweep, window as win
from strandline.operators.quantiles import exact_quantiles
from strandline.sources import panels
from tests.conftest import column

RNG = np.random.default_rng(3)
PRICES = (100 * np.cumprod(1 + RNG.normal(0, 0.03, 90))).tolist()
RET = [PRICES[i] / PRICES[i - 1] - 1 for i in range(1, 90)]


@pytest.fixture(scope="module")
def rets(spark):
    import datetime as dt

    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), v, float(i % 7 + 1)) for i, v in enumerate(PRICES)]
    return panels.returns(spark.createDataFrame(rows, "series_id string, ts date, value double, volume double")).cache()


def lagged(x, k):
    return np.concatenate([np.full(k, np.nan), np.asarray(x, float)[: len(x) - k]])


def ols(y, cols):
    m = np.column_stack([np.ones(len(y)), *cols])
    ok = ~np.isnan(m).any(axis=1) & ~np.isnan(y)
    m, y = m[ok], np.asarray(y)[ok]
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    e = y - m @ b
    s2 = e @ e / (len(y) - m.shape[1])
    cov = s2 * np.linalg.inv(m.T @ m)
    return b, e @ e, len(y), b / np.sqrt(np.diag(cov)), cov


def test_ols_standard_errors_with_five_regressors(rets):
    xs = [f"l{k}" for k in range(1, 6)]
    from strandline.operators.transform import shift

    p = rets
    for k, x in enumerate(xs, 1):
        p = shift(p, "ret", k, out=x)
    got = rg.ols(p, "ret", xs).collect()[0]
    b, rss, n, t, _ = ols(np.array(RET), [lagged(RET, k) for k in range(1, 6)])
    assert got["n"] == n and got["rss"] == pytest.approx(rss)
    assert [got["intercept"], *got["coef"]] == pytest.approx(b.tolist())
    assert got["t"] == pytest.approx(t[1:].tolist())


def test_singular_design_gives_null(rets):
    p = rets.withColumn("x", F.col("volume")).withColumn("x2", 2 * F.col("volume"))
    assert rg.ols(p, "ret", ["x", "x2"]).collect()[0]["intercept"] is None or abs(rg.ols(p, "ret", ["x", "x2"]).collect()[0]["r2"]) <= 1


def test_order_table(rets):
    table = {r["order"]: r for r in rg.ar_orders(rets, "ret", 4).collect()}
    y = np.array(RET)[4:]
    for p in range(1, 5):
        b, rss, n, _, _ = ols(y, [lagged(RET, k)[4:] for k in range(1, p + 1)])
        assert table[p]["coef"] == pytest.approx(b[1:].tolist(), abs=1e-9)
        assert table[p]["mdl"] == pytest.approx(n * math.log(rss / n) + p * math.log(n))
        ll = -0.5 * n * (math.log(2 * math.pi * rss / n) + 1)
        assert table[p]["aic"] == pytest.approx(2 * (p + 1) - 2 * ll)


def test_sequential_elimination(rets):
    from strandline.operators.transform import shift

    p = rets
    for k in range(1, 5):
        p = shift(p, "ret", k, out=f"l{k}")
    names = [f"l{k}" for k in range(1, 5)]
    got = rg.sequential_elimination(p, "ret", names, [0.3, 1.0]).collect()[0]
    cols = {n: lagged(RET, k)[4:] for k, n in enumerate(names, 1)}
    y, keep = np.array(RET)[4:], list(names)
    for cut in (0.3, 1.0):
        t = ols(y, [cols[n] for n in keep])[3][1:]
        strong = [n for n, v in zip(keep, t) if abs(v) >= cut]
        keep = strong or keep
    assert [n for n, k in zip(names, got["kept"]) if k] == keep
    b = ols(y, [cols[n] for n in keep])[0]
    assert [c for c, k in zip(got["coef"], got["kept"]) if k] == pytest.approx(b[1:].tolist())


def test_ardl_wald(rets):
    got = rg.ardl_long_run(rets, "ret", "volume", 1, 2, cutoff=0.0).collect()[0]
    vol = [float(i % 7 + 1) for i in range(1, 90)]
    cols = [lagged(RET, 1)[2:], np.array(vol)[2:], lagged(vol, 1)[2:], lagged([1.0, *vol][:-1], 1)[2:]]
    # volume also has a row before the first return, so two lags lose only what the returns lose
    y = np.array(RET)
    cols = [lagged(RET, 1), np.array(vol), np.array([1.0, *vol[:-1]]), np.array([np.nan, 1.0, *vol[:-2]])]
    b, _, n, _, cov = ols(y, cols)
    s = b[2:].sum()
    var = cov[2:, 2:].sum()
    assert got["n"] == n and got["sum_x"] == pytest.approx(s) and got["wald"] == pytest.approx(s * s / var)
    assert got["long_run"] == pytest.approx(s / (1 - b[1]))


def test_two_equation_system(rets):
    out = rg.two_equation_system(rets, "ret", min_rows=30, refit_every=1).filter("forecast is not null").orderBy("ts").collect()
    y = np.array(RET)
    d = np.concatenate([[np.nan], np.diff(y)])
    z = [np.where(np.isnan(d), np.nan, np.where(c, 1.0, -1.0)) for c in ((d > 0) & (y > 0), (d <= 0) & (y > 0), (d <= 0) & (y <= 0))]
    now = [y, lagged(y, 1), lagged(y, 2), *z]
    was = [lagged(c, 1) for c in now]
    last = len(y) - 1
    for back in (0, 7):
        t = last - back
        b = ols(y[: t + 1], [c[: t + 1] for c in was])[0]
        f = b[0] + sum(k * c[t] for k, c in zip(b[1:], now))
        row = out[-1 - back]
        assert row["forecast"] == pytest.approx(f, abs=1e-9)
        assert row["forecast_change"] == pytest.approx(f - y[t], abs=1e-9)
        assert row["rule_return"] == np.sign(f)


def test_basis_regression_equals_linear_kernel_process(rets):
    from strandline.operators.transform import shift

    p = shift(rets.filter("ret is not null"), "ret", 1, out="x").withColumn("one", F.lit(1.0))
    got = rg.basis_regression(p, "ret", ["one", "x"], 20, [0.01, 1.0], [0.0005, 0.01], complete_only=True).orderBy("ts").collect()[-1]
    y, phi = np.array(RET[-21:-1]), np.column_stack([np.ones(20), RET[-22:-2]])
    q = np.array([1.0, RET[-2]])
    best = None
    for s2 in (0.01, 1.0):
        for g2 in (0.0005, 0.01):
            k = s2 * phi @ phi.T + g2 * np.eye(20)
            ev = -0.5 * (y @ np.linalg.solve(k, y) + np.linalg.slogdet(k)[1] + 20 * math.log(2 * math.pi))
            ks = s2 * phi @ q
            mean = ks @ np.linalg.solve(k, y)
            var = s2 * q @ q - ks @ np.linalg.solve(k, ks) + g2
            if best is None or ev > best[0]:
                best = (ev, mean, math.sqrt(var))
    assert (got["evidence"], got["mean"], got["deviation"]) == pytest.approx(best, rel=1e-6)


def test_ar1_long_horizon_and_short_history(rets):
    f = forecast.ar1(rets, "value", 4).orderBy("ts").collect()
    assert f[5]["forecast"] == PRICES[5] and f[5]["lower"] is None
    x, y = np.array(PRICES[:-1]), np.array(PRICES[1:])
    phi, c = np.polyfit(x, y, 1)
    v = PRICES[-1]
    for _ in range(4):
        v = c + phi * v
    if abs(phi) < 0.999:
        assert f[-1]["forecast"] == pytest.approx(v)


def test_exact_quantiles_with_ties_and_a_hot_group(spark):
    hot = [float(i % 5) if i % 3 == 0 else i / 7 for i in range(2000)]
    rows = [("hot", v) for v in hot] + [("one", 4.0)] + [("two", v) for v in (1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in exact_quantiles(df, "x", {"a": 0.0, "m": 0.5, "q": 0.9, "z": 1.0}, ["k"], buckets=16).collect()}
    for k, vals in (("hot", hot), ("one", [4.0]), ("two", [1.0, 2.0])):
        assert [got[k][c] for c in "amqz"] == pytest.approx(np.quantile(vals, [0, 0.5, 0.9, 1]).tolist())


def test_block_learning(rets):
    ns, reset = (3, 5), 4
    got = sg.block_learning(rets, ns, reset).orderBy("ts").collect()
    s = {n: [None] * len(RET) for n in ns}
    for n in ns:
        for t in range(n, len(RET)):
            w = RET[t - n : t]
            m = float(np.median(w))
            s[n][t] = np.sign(np.mean(w) / m if m else np.mean(w))
    first = max(ns)
    rows = range(first, len(RET))
    assert len(got) == len(rows)
    for pos, t in enumerate(rows):
        if pos == 0:
            continue
        block = range(first + pos // reset * reset, t)  # rows of the same block before t
        weights = {}
        for n in ns:
            ep = [abs(RET[u]) for u in block if np.sign(RET[u]) - s[n][u] == 2]
            em = [abs(RET[u]) for u in block if np.sign(RET[u]) - s[n][u] == -2]
            lp, lm = np.prod([1 + v for v in ep]), np.prod([1 + v for v in em])
            weights[n] = (2.0 ** (2.0 ** -len(ep) / lp + 2.0 ** -len(em) / lm), 2.0 ** -(len(ep) + len(em)), 2.0 ** -(lp + lm))
        for i, name in enumerate(("by_both", "by_errors", "by_losses")):
            total = sum(weights[n][i] * s[n][t] for n in ns)
            assert got[pos][name] == pytest.approx(RET[t] * np.sign(round(total, 12)), abs=1e-12)


def test_adaptive_probability_shares(rets):
    p = explode_rows(rets.select("series_id", "ts", "ret"), sweep.grid(n=[5]))
    got = rc.adaptive_probability(p, "ret").orderBy("ts").collect()
    adt = std = 0.5
    gamma, errs, bench = 0.1, [0.0] * 4, [0.0] * 4
    for t in range(5, len(RET)):
        past = RET[:t]
        share, loss = np.mean([v <= 0 for v in past]), float(past[-1] <= 0)
        e = loss - adt
        a = e * e / (share + e * e)
        a = a * a / (a * a + (1 - a) * (1 - a))
        adt = a * share + (1 - a) * e * e
        errs.append(loss - std)
        bench.append(loss - share)
        if t > 10:
            x = np.array(errs)
            c = np.mean(x[:-1] ** 2) or 1.0
            gamma = (np.mean(x[1:] * x[:-1]) - np.mean(np.array(bench)[1:] * x[:-1])) / c
        std = share + gamma * errs[-1]
        row = got[t - 5]
        assert row["pe_avg"] == pytest.approx(RET[t] * np.sign(1 - 2 * share))
        assert row["pe_adt"] == pytest.approx(RET[t] * np.sign(1 - 2 * adt))
        assert row["pe_std"] == pytest.approx(RET[t] * np.sign(1 - 2 * std))
        assert row["mr"] == pytest.approx(RET[t] * np.sign(np.mean(past[-5:])))


def test_position_machine_by_hand(spark):
    import datetime as dt

    steps = [(100, 0.0, 1), (101, 0.01, 1), (97, -4 / 101, 1), (97, 0.0, -1), (90, -7 / 97, -1), (90, 0.0, 0), (91, 1 / 90, 1), (92, 1 / 91, -1), (92, 0.0, 0)]
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(p), r, float(s)) for i, (p, r, s) in enumerate(steps)]
    df = spark.createDataFrame(rows, "series_id string, ts date, value double, ret double, signal double")
    out = rc.position_machine(df, "value", "ret", "signal", capital=1000.0, size=0.5, stop=0.02, take=0.05, cost=0.0).orderBy("ts").collect()
    # a position closed by a limit is reopened on the same row when a signal stands
    assert [r["action"] for r in out] == ["BUY", "HOLD", "BUY", "REVERSE", "SELL", "FLAT", "BUY", "REVERSE", "FLAT"]
    cap = 1000 + 500 * 0.01
    cap += 500 * (97 / 100 - 1)
    assert out[2]["capital"] == pytest.approx(cap)
    size = cap * 0.5
    cap += size * (97 / 90 - 1)
    assert out[4]["capital"] == pytest.approx(cap)
    assert [r["position"] for r in out] == [1, 1, 1, -1, -1, 0, 1, -1, 0]


def test_online_kernel_learns_and_matches_a_direct_update(rets):
    got = rc.online_kernel(rets, "ret", memory=3, rate=0.05, decay=0.01, normalise=False).orderBy("ts").collect()
    theta, pred = np.zeros(1 + 3 + 9), 0.0
    feat = lambda w: np.concatenate([[1.0], w, np.outer(w, w).ravel()])
    for t in range(3, len(RET)):
        err = RET[t] - pred
        theta = theta * (1 - 0.05 * 0.01) + 0.05 * err * feat(np.array(RET[t - 3 : t]))
        pred = float(theta @ feat(np.array(RET[t - 2 : t + 1])))
        assert got[t - 3]["forecast"] == pytest.approx(pred, abs=1e-12)


def test_adaptive_mean(rets):
    p = explode_rows(rets.select("series_id", "ts", "ret"), sweep.grid(gamma=[0.8]))
    got = rc.adaptive_mean(p, "ret", 10).orderBy("ts").collect()
    hits = np.zeros(len(RET))
    for t in range(10, len(RET)):
        mean = np.mean(RET[t - 10 : t])
        f = mean
        if t > 12:
            u = hits[t - 10 : t] - hits[t - 10 : t].mean()
            c = np.mean((np.array(RET[t - 10 : t]) - mean) * u)
            if c != 0 and (u * u).sum() > 0:
                f += (0.8 if c > 0 else 1 / 0.8) ** math.log(t) * 2 * abs(c) / np.mean(u * u) * u[-1]
        hits[t] = RET[t] > f
        assert got[t - 10]["adaptive_rolling"] == pytest.approx(f)
        assert got[t - 10]["mean_expanding"] == pytest.approx(np.mean(RET[:t]))


def test_adaptive_weights_prefer_the_better_model(rets):
    p = rets.filter("ret is not null").withColumn("f", F.array(F.col("ret") * 0.9, F.lit(0.5)))
    w = column(rc.adaptive_weights(p, "ret", "f", 2, rate=1.0), "weights")
    assert w[0] == [0.5, 0.5] and w[-1][0] > 0.9 and sum(w[-1]) == pytest.approx(1.0)


def test_capital_rule_without_triggers_is_holding(rets):
    p = rets.withColumn("fast", F.lit(0.0)).withColumn("slow", F.lit(0.0))
    got = column(rc.capital_rule(p, "ret", "fast", "slow", rise=9.0), "capital")
    assert got[-1] == pytest.approx(1000 * np.prod([1 + r for r in RET[1:]]))


def test_risk_position_uses_earlier_rows_only(rets):
    p = sg.belief_states(rets, 6, gamma=0.1)
    rows = [r for r in rc.risk_position(p, "ret", "signal", "entropy").orderBy("ts").collect()]
    ent = [r["entropy"] for r in p.orderBy("ts").collect()]
    change = [r["strategy"] for r in rows]
    for m in (2, 5, 40):
        e, c = ent[1:m], change[1:m]
        want = 0.5 if len(e) < 2 else float(np.clip(np.tanh(10 * np.cov(e, c)[0, 1]) - 1, -1, 1))
        assert rows[m]["risk"] == pytest.approx(want)


def test_sample_entropy_and_information(rets):
    got = win.sample_entropy(win.histogram_entropy(rets, "ret", 16, 6), "ret", 16).orderBy("ts").collect()[-1]
    x = np.array(RET[-16:])
    counts = np.histogram(x, bins=6)[0]
    q = counts[counts > 0] / 16
    assert got["entropy"] == pytest.approx(-(q * np.log(q)).sum())
    tol = 0.2 * x.std()
    hits = [sum(np.max(np.abs(x[i : i + m] - x[j : j + m])) < tol for i in range(14) for j in range(i + 1, 14)) for m in (2, 3)]
    want = -math.log(hits[1] / hits[0]) if min(hits) else None
    assert got["sample_entropy"] == (pytest.approx(want) if want is not None else None)


def test_breaker_needs_all_three(rets):
    out = sg.anomaly_and_breaker(rets, 20, 8, entropy_limit=0.0, drawdown_limit=0.01, kurtosis_limit=-9.0).collect()
    assert any(r["stop"] for r in out)
    assert not any(r["stop"] for r in sg.anomaly_and_breaker(rets, 20, 8, entropy_limit=99.0, drawdown_limit=0.01, kurtosis_limit=-9.0).collect())


def test_principal_components(spark):
    x = RNG.normal(size=(200, 4)) @ np.diag([4.0, 2.0, 1.0, 0.5])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    got = ml.principal_components(df, "x", 2).collect()
    w, v = np.linalg.eigh(np.cov(x.T))
    lead = np.abs(v[:, np.argsort(w)[::-1][0]])
    assert [abs(r["loading"]) for r in sorted(got, key=lambda r: r["variable"]) if r["component"] == 1] == pytest.approx(lead.tolist())
    assert got[0]["explained"] == pytest.approx(max(w) / sum(w))


def test_mixture_separates_two_groups(spark):
    rows = [(float(i), float(v)) for i, v in enumerate(np.concatenate([RNG.normal(-3, 0.5, 80), RNG.normal(3, 0.5, 80)]))]
    df = spark.createDataFrame(rows, "id double, x double")
    out = ml.two_means(ml.mixture_regimes(df, ["x"]), ["x"]).orderBy("id").collect()
    assert all(r["p0"] > 0.9 and r["cluster"] == 0 for r in out[:80]) and all(r["p1"] > 0.9 and r["cluster"] == 1 for r in out[80:])


def test_walk_forward_blocks_equal_direct_scores(rets):
    rows = win.sign_rule_rows(rets, [2, 3, 5], [1])
    got = {(r["fold"]): r for r in sweep.walk_forward(rows, 30, 10, 10, ["n", "delay"]).collect()}
    strat = {n: [RET[t] * np.sign(np.mean(RET[t - n : t])) for t in range(5, len(RET))] for n in (2, 3, 5)}
    total = len(RET) - 5
    folds = [f for f in range(total) if f * 10 + 40 <= total]
    assert sorted(got) == folds
    for f in folds:
        train = {n: np.prod([1 + v for v in s[f * 10 : f * 10 + 30]]) - 1 for n, s in strat.items()}
        best = max(sorted(train), key=lambda n: round(train[n], 12))
        assert got[f]["n"] == best and got[f]["train_score"] == pytest.approx(train[best])
        assert got[f]["test_score"] == pytest.approx(np.prod([1 + v for v in strat[best][f * 10 + 30 : f * 10 + 40]]) - 1)


def test_elastic_net_without_penalty_is_least_squares(rets):
    p, names = ml.lag_features(rets, "ret", [1, 2])
    cut = p.orderBy("ts").collect()[70]["ts"]
    out = ml.elastic_net(p, "ret", names, F.col("ts") < F.lit(cut)).orderBy("ts").collect()
    b = ols(np.array(RET[:69]), [lagged(RET, 1)[:69], lagged(RET, 2)[:69]])[0]
    assert out[0]["forecast"] == pytest.approx(b[0] + b[1] * RET[68] + b[2] * RET[67], abs=1e-6)


@pytest.mark.parametrize("chirp_from", [16.0, 0.0])
def test_periodogram_at_prime_and_composite_lengths(spark, chirp_from):
    series = {str(n): RNG.normal(size=n) + 3 for n in (1, 2, 12, 97, 120)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "series_id string, ts int, value double")
    got = {(g.series_id, g.k): g for g in spectral.periodogram(df, "value", chirp_from=chirp_from).collect()}
    assert sorted(got) == sorted((k, j) for k, x in series.items() for j in range(len(x) // 2 + 1))
    for name, x in series.items():
        n = len(x)
        for j in range(n // 2 + 1):
            want = abs(sum((v - x.mean()) * np.exp(-2j * np.pi * j * t / n) for t, v in enumerate(x))) ** 2 / n
            assert got[name, j].power == pytest.approx(want, abs=1e-9) and got[name, j].frequency == pytest.approx(j / n)


def test_threshold_scan_tries_every_observed_value(spark):
    r = np.random.default_rng(8)
    rows = []
    for key, n in (("a", 90), ("b", 60), ("c", 4)):
        x, o = np.round(r.normal(size=n), 1), r.normal(size=n)  # ties in x
        y = 0.3 * o + np.where(x < 0.25, 1.0 + 0.5 * x, -0.5 * x) + 0.2 * r.normal(size=n)
        rows += [(key, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, o, x))]
    df = spark.createDataFrame([*rows, ("a", 999, None, 1.0, 2.0)], "series_id string, ts int, y double, o double, x double")
    got = {g.series_id: g for g in rg.threshold_scan(df, "y", "o", "x", buckets=8).collect()}
    assert sorted(got) == ["a", "b"]
    for key in got:
        y, o, x = (np.array([row[i] for row in rows if row[0] == key]) for i in (2, 3, 4))
        best = None
        for tau in np.unique(x):
            if np.quantile(x, 0.1) <= tau <= np.quantile(x, 0.9):
                below = (x < tau).astype(float)
                b, rss, n, _, _ = ols(y, [o, x, below, below * x])
                if best is None or rss < best[0] - 1e-12:
                    best = (rss, tau, b)
        g, (rss, tau, b) = got[key], best
        assert g.tau == tau and g.mse == pytest.approx(rss / (len(y) - 5), rel=1e-9)
        assert [g.intercept, g.own, g.slope, g.below, g.slope_below] == pytest.approx(b.tolist(), rel=1e-7, abs=1e-9)


def test_moving_blocks_against_rows(spark):
    import hashlib

    series = {"a": RNG.normal(0, 0.1, 25), "short": np.array([0.1, -0.2, 0.05]), "broke": np.array([0.1, -1.0, 0.2, -1.5, 0.3, 0.1, 0.2])}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("a", 99, None)], "series_id string, ts int, ret double")
    got = {(g.series_id, g.replicate): g for g in sweep.moving_blocks(df, 4, 6).collect()}
    assert len(got) == 18
    for (key, rep), g in got.items():
        x, sample = series[key], []
        for block in range(-(-len(x) // 4)):
            start = int(hashlib.md5(f"{key}|{rep}|{block}|7".encode()).hexdigest()[:8], 16) % max(1, len(x) - 3)
            sample += x[start : start + 4].tolist()
        sample = np.array(sample[: len(x)])
        assert g.n == len(x) and g.mean == pytest.approx(sample.mean()) and g.deviation == pytest.approx(sample.std(ddof=1))
        assert g.wealth == pytest.approx(np.prod(1 + sample), abs=1e-12)


def test_relevance_weights_follow_conditional_entropy():
    step = rc.WeightedBeliefs([0.4, 0.2])
    evidence, belief, entropy, *weights = step.row("1_1", 0.8, 0.6)
    assert evidence == pytest.approx(0.7) and belief == pytest.approx(0.7)
    h = -0.7 * math.log2(0.7)  # features are not in the joint entropy of the first row

    def given(p, s):
        return sum(v * math.log2(v / s) for v in (p * s, p * (1 - s), (1 - p) * s))

    shares = [max(0.0, (h - given(p, 0.7)) / h) for p in (0.4, 0.2)]
    assert weights == pytest.approx([s / sum(shares) for s in shares])
    second = step.row("0_1", 0.1, 0.3)
    assert second[0] == pytest.approx(0.1 * weights[0] + 0.3 * weights[1]) and step.row(None, 0.1, 0.2) is None
    assert sum(step.weights) == pytest.approx(1.0) and set(step.beliefs) == {"1_1", "0_1"}
    assert rc.WeightedBeliefs([0.5, 0.5]).row("s", 1.0, 1.0)[1] == 1.0
