"""Order statistics by blocks, and walk-forward folds of strategies with a state."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.frames import expanding
from strandline.operators import ranked, sweep
from strandline.operators.recursive import PositionReturns


@pytest.mark.parametrize("full", [4, ranked.FULL])
def test_quantiles_of_every_prefix(monkeypatch, full):
    monkeypatch.setattr(ranked, "FULL", full)
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=400), 1).tolist() + [0.0] * 50 + [1e9, -1e9]
    for q in (0.0, 0.1, 0.5, 0.75, 1.0):
        fold, seen = ranked.Quantiles(1, q), []
        for x in [None, *values, float("nan")]:
            if x is not None and x == x:
                seen.append(x)
            got = fold.row(x)[0]
            assert got == pytest.approx(np.quantile(seen, q), abs=1e-9) if seen else got is None


def test_twice_the_rows_cost_little_more_than_twice_the_time():
    rng = np.random.default_rng(2)
    values = rng.normal(size=40_000).tolist()

    def seconds(n):
        best = 1e9
        for _ in range(3):
            start, fold = time.perf_counter(), ranked.Quantiles(1, 0.5)
            for x in values[:n]:
                fold.row(x)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(40_000) < 2.5 * seconds(20_000) + 0.05


def test_expanding_quantiles_against_the_window_form(spark, panel):
    rng = np.random.default_rng(3)
    df = panel({"a": [None, *rng.normal(size=40).round(1).tolist()], "b": [5, None, 5, 1], "c": [None]})
    df = df.withColumn("other", -F.col("value")).withColumn("note", F.lit("x"))
    got = ranked.expanding_quantiles(df, {"value": "v", "other": "o"}, 0.25)
    w = expanding()
    want = df.select("*", *[F.percentile(c, F.lit(0.25)).over(w).alias(n) for c, n in (("value", "v"), ("other", "o"))])
    assert got.columns == want.columns
    a, b = ({(r["series_id"], r["ts"]): r for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        for c in ("v", "o"):
            assert a[k][c] == pytest.approx(b[k][c], abs=1e-12)


def ran(rows, **params):
    """Total return of one run of the machine from its first row."""
    machine, growth = PositionReturns(**params), 1.0
    for r in rows:
        made = machine.row(*r)
        growth *= 1.0 + (0.0 if made is None else made)
    return growth - 1.0


def test_every_part_starts_with_a_state_of_its_own(spark):
    rng = np.random.default_rng(4)
    price = 100 * np.cumprod(1 + rng.normal(0, 0.02, 75))
    rows = [(float(p), float(p / q - 1), 1.0) for p, q in zip(price[1:], price[:-1])]
    start = dt.date(2020, 1, 1)
    data = [("a", start + dt.timedelta(days=i), *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data[::-1], "series_id string, ts date, value double, ret double, signal double")
    train, test, step = 20, 8, 9
    got = sweep.position_walk_forward(df, train, test, step, {"stop": [0.01, 0.05], "take": [0.02, 0.2]}, size=0.5).collect()
    assert [r["fold"] for r in sorted(got, key=lambda r: r["fold"])] == list(range((74 - train - test) // step + 1))
    for r in got:
        a = r["fold"] * step
        trained = {(s, t): ran(rows[a : a + train], stop=s, take=t, size=0.5) for s in (0.01, 0.05) for t in (0.02, 0.2)}
        best = min(trained, key=lambda k: (-round(trained[k], 12), k))
        assert (r["stop"], r["take"]) == best
        assert r["train_score"] == pytest.approx(trained[best], abs=1e-12)
        part = rows[a + train : a + train + test]
        assert r["test_score"] == pytest.approx(ran(part, stop=best[0], take=best[1], size=0.5), abs=1e-12)
        # always long: a position carried over would earn the first row of the test part as well
        assert PositionReturns(stop=best[0], take=best[1]).row(*part[0]) == pytest.approx(-0.5 * 0.0001, abs=1e-9)


def test_beliefs_are_learned_anew_in_every_part(spark):
    """A state that was certain to rise in training tells the test part nothing."""
    from strandline.operators.recursive import BeliefReturns

    learned, fresh = BeliefReturns(), BeliefReturns()
    for _ in range(10):
        learned.row(0.01, "110", 2 / 3)
    assert learned.row(0.01, "110", 2 / 3) == 0.01 and fresh.row(0.01, "110", 2 / 3) == 0.0
    rng = np.random.default_rng(5)
    start = dt.date(2020, 1, 1)
    data = [("a", start + dt.timedelta(days=i), float(x)) for i, x in enumerate(rng.normal(0, 0.02, 60))]
    df = spark.createDataFrame(data, "series_id string, ts date, ret double")
    axes = {"prior": [0.3, 0.5], "trade_limit": [0.4, 0.6]}
    got = sweep.belief_walk_forward(df, 20, 10, 10, [3, 5], [0.5], axes).collect()
    assert sorted(r["fold"] for r in got) == [0, 1, 2] and all(r["n"] in (3, 5) for r in got)
