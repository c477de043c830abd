"""Edge rules on hand-made panels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.operators import align, crosscorr, evaluate, fold, recursive, resample, segment, signals, sweep, transform, window
from strandline.frames import SEG_KEYS, explode_rows
from strandline.sources import files, panels
from tests.conftest import column


def test_partial_windows_are_null_and_row_order_is_irrelevant(panel):
    p = window.rolling(panel({"a": range(1, 9), "b": [5] * 8}), "value", 3, ["mean", "std"])
    assert column(p, "mean", "a") == [None, None, 2, 3, 4, 5, 6, 7]
    assert column(p, "std", "b")[2:] == [0] * 6


def test_null_inside_window_blanks_it(panel):
    p = window.rolling(panel({"a": [1, 2, None, 4, 5, 6]}), "value", 3, ["mean"])
    assert column(p, "mean") == [None, None, None, None, None, 5]


def test_flat_series_gives_null_ratios(panel):
    p = panels.returns(panel({"a": [3] * 6}))
    perf = evaluate.performance_annual(p, 252).collect()[0]
    assert perf["sharpe"] is None and perf["sortino"] is None and perf["total_return"] == 0
    assert column(window.rolling_corr(p, "value", "ret", 3), "corr") == [None] * 6
    assert window.histogram_entropy(p, "value", 3, 5).filter("entropy is not null").select("entropy").distinct().collect()[0][0] == 0


def test_zero_base_gives_null_growth(panel):
    assert column(panels.returns(panel({"a": [1, 0, 5]})), "ret") == [None, -1, None]


def test_a_low_of_zero_gives_an_infinite_reach(spark):
    """As in the SQL of D13_range_volume_booster, where doubles divide by zero."""
    bars = [(5.0, 0.0, 2), (3.0, 1.0, 4), (2.0, 0.0, 4), (0.0, 0.0, 2), (None, 2.0, 2)]
    rows = [("a", dt.date(2020, 1, 1 + i), *bar) for i, bar in enumerate(bars)]
    df = spark.createDataFrame(rows, "series_id string, ts date, high double, low double, volume long")
    made = transform.range_volume_booster(df)
    assert [str(x) for x in column(made, "reach")] == ["None", "inf", "1.0", "nan", "None"]
    assert [str(x) for x in column(made, "booster")] == ["None", "inf", "1.0", "nan", "None"]


def test_total_loss(panel):
    p = panel({"a": [0.1, -0.2, -1.0, 0.5, 0.3]}).withColumnRenamed("value", "ret")
    perf = evaluate.performance_trading(p, 252).collect()[0]
    assert perf["total_return"] == -1 and perf["max_drawdown"] == -1 and perf["annualized_return"] is None
    assert column(window.equity(p), "wealth")[2:] == [0, 0, 0]


def test_single_row_does_not_fail(panel):
    p = panels.returns(panel({"a": [4]}))
    assert evaluate.performance_annual(p, 12).count() == 0
    assert column(window.kinematics(p, "value"), "velocity") == [None]
    assert column(resample.blank_and_interpolate(p, "value", 1.0), "smoothed") == [4]
    assert recursive.switching(explode_rows(p.select("series_id", "ts", "ret"), sweep.grid(n=[2], delay=[0])), "ret").count() == 0


def test_best_lag_takes_the_smallest_of_equals(spark):
    t = spark.createDataFrame([("p", 3, 0.5), ("p", 1, -0.5), ("p", 2, 0.1)], "pair string, lag int, rho double")
    assert crosscorr.best_lag(t).collect()[0]["best_lag"] == 1


def test_ffill_fills_calendar_gaps(spark):
    rows = [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 4), 2.0), ("a", dt.date(2020, 1, 5), None)]
    p = resample.upsample_ffill(spark.createDataFrame(rows, "series_id string, ts date, value double"), "interval 1 day")
    assert column(p, "value") == [1, 1, 1, 2, None]
    assert column(p, "filled") == [False, True, True, False, False]


def test_week_ends_and_quarters(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 6),)], "ts date")
    assert [r[0] for r in d.select(resample.period_end(F.col("ts"), "W-FRI")).collect()] == [dt.date(2024, 1, 5), dt.date(2024, 1, 12)]
    assert d.select(resample.period_end(F.col("ts"), "QE")).collect()[0][0] == dt.date(2024, 3, 31)
    with pytest.raises(ValueError):
        resample.period_end(F.col("ts"), "XX")


def test_open_span_ends_at_the_last_row(panel):
    p = panel({"a": [0, 1, 1, 0, 1, 1]})
    spans = sorted(tuple(r) for r in window.flag_spans(p.withColumn("value", F.col("value").cast("int")), "value").collect())
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    assert spans == [("a", day(1), day(3)), ("a", day(4), day(5))]


def test_last_block_is_dropped_even_when_full(panel):
    p = panel({"a": [0.0] * 9}).withColumnRenamed("value", "ret")
    assert window.block_returns(p, 3).count() == 2
    assert window.block_returns(p, 4).count() == 2


def test_shift_zero_is_identity_and_wealth_is_a_product(panel):
    p = transform.shift(panel({"a": [1, 2, 3]}), "value", 0, out="same")
    assert column(p, "same") == [1, 2, 3]
    e = window.equity(panel({"a": [0.1, -0.5, 0.2]}).withColumnRenamed("value", "ret"))
    assert column(e, "wealth") == pytest.approx([1.1, 0.55, 0.66])
    assert all(d <= 0 for d in column(e, "drawdown"))


def test_rolling_equals_expanding_on_a_window_as_long_as_the_series(panel):
    p = panel({"a": [3, 1, 4, 1, 5, 9, 2, 6]})
    last = column(window.rolling(p, "value", 8, ["mean"]), "mean")[-1]
    assert last == pytest.approx(column(window.expanding_stats(p, "value"), "mean")[-1])


@pytest.mark.parametrize("rows", [4, 7, 50])
def test_segments_change_nothing(panel, rows):
    p = panel({"hot": [((i * 37) % 101) - 50 for i in range(120)], "cold": [1, 2, 3]})
    plain = window.rolling(p, "value", 4, ["mean", "max"])
    cut = segment.drop_halo(window.rolling(segment.segmented(segment.number_rows(p), 3, rows), "value", 4, ["mean", "max"], keys=SEG_KEYS))
    want = sorted((r["series_id"], r["ts"], r["mean"], r["max"]) for r in plain.filter("mean is not null").collect())
    got = sorted((r["series_id"], r["ts"], r["mean"], r["max"]) for r in cut.filter("mean is not null").collect())
    assert got == want
    run = segment.running(segment.number_rows(p), {"s": (F.col("value"), "sum"), "m": (F.col("value"), "max")}, rows=rows)
    total = 0
    for r in sorted((r for r in run.collect() if r["series_id"] == "hot"), key=lambda r: r["ts"]):
        total += r["value"]
        assert r["s"] == total


@pytest.mark.parametrize("buckets,rows", [(4, 5), (64, 100_000), (2, 1)])
def test_buckets_are_monotone_and_small(spark, buckets, rows):
    from strandline.operators.quantiles import balanced_buckets

    crowded = [1000 + i // 50 for i in range(300)] + list(range(0, 100_000, 997))
    df = spark.createDataFrame([("k", t * 1000 + i % 50) for i, t in enumerate(crowded)], "series_id string, ts long")
    out = sorted((r["ts"], r["_b"]) for r in balanced_buckets(df, "ts", ["series_id"], buckets, rows).collect())
    assert [b for _, b in out] == sorted(b for _, b in out)
    sizes = {}
    for _, b in out:
        sizes[b] = sizes.get(b, 0) + 1
    assert max(sizes.values()) <= max(len(out) / buckets * 2, 8)
    numbered = segment.number_rows(df)
    assert [r["rn"] for r in numbered.orderBy("ts").collect()] == list(range(1, len(out) + 1))


def test_asof_query_reads_every_event_type(spark, tmp_path):
    from strandline.catalog import all_queries

    rows = [(1, 1, "error", 1.0), (2, 2, "view", 5.0), (3, 3, "signup", 2.0), (4, 4, "click", 3.0), (5, 5, "view", 7.0), (6, 6, "purchase", 4.0), (7, 7, None, 6.0)]
    rows = [(i, dt.datetime(2024, 1, 1, 0, m), t, v) for i, m, t, v in rows]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in all_queries()["B6_asof_event_types"](spark, str(tmp_path)).select("event_id", "event_type", "asof_value").collect())
    assert got == [(1, "error", None), (2, "view", 5), (3, "signup", 5), (4, "click", 5), (5, "view", 7), (6, "purchase", 7), (7, None, 7)]


def test_asof_takes_the_last_value_at_or_before(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 5, 10, 99)], "series_id string, ts long")
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0), ("a", 7, 3.0)], "series_id string, ts long, value double")
    assert column(align.asof(left, right), "asof_value") == [None, 2, 3, 3]
    assert column(align.asof(left, right, bucket=lambda t: F.floor(t / 2)), "asof_value") == [None, 2, 3, 3]


def test_broadcast_has_a_bound_and_another_way(spark):
    big = spark.range(100).withColumnRenamed("id", "k")
    over = spark.range(10).withColumnRenamed("id", "k").join(align.bounded_broadcast(big, limit=5), "k")
    under = spark.range(10).withColumnRenamed("id", "k").join(align.bounded_broadcast(big, limit=500), "k")
    assert over.count() == under.count() == 10
    assert "ResolvedHint" not in over._jdf.queryExecution().analyzed().toString()


def test_grids_are_checked(panel):
    p = panel({"a": [1]})
    with pytest.raises(ValueError):
        explode_rows(p, [])
    with pytest.raises(ValueError):
        explode_rows(p, [{"value": 1}])
    assert explode_rows(p, sweep.grid(n=[1, 2], d=[3, 4, 5])).count() == 6


def test_unknown_names_raise(panel):
    p = panel({"a": [1, 2, 3]})
    for call in (
        lambda: window.rolling(p, "value", 2, ["nope"]),
        lambda: align.align(p, p, "cross"),
        lambda: sweep.stitch(p, "nope"),
        lambda: signals.automatic_window(p, [2], tie="nope"),
        lambda: files.ingest(p, change="nope"),
        lambda: files.coalesce_columns(p, ["x", "y"]),
    ):
        with pytest.raises(ValueError):
            call()


def test_cross_section_file_with_byte_order_mark(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_bytes(
        b'\xef\xbb\xbf"LOCATION","INDICATOR","SUBJECT","MEASURE","FREQUENCY","TIME","Value","Flag Codes"\n'
        b'"AUS","INCOMEINEQ","GINI","INEQ","A","2012",0.326,\n"AUS","INCOMEINEQ","GINI","INEQ","A","2014",0.337,"P"\n"AUT","INCOMEINEQ","GINI","INEQ","A","2007",0.284,\n'
    )
    df = files.read_csv(spark, str(f), files.CROSS_SECTION)
    last = resample.latest_per_key(df.withColumn("year", F.col("TIME").cast("int")), ["LOCATION"], "year", "Value")
    assert {r["LOCATION"]: (r["year"], r["Value"]) for r in last.collect()} == {"AUS": (2014, 0.337), "AUT": (2007, 0.284)}


def test_custom_date_formats(spark, tmp_path):
    (tmp_path / "m.csv").write_text("day,value\n202001,1\n202013,2\n")
    df = files.read_csv(spark, str(tmp_path / "m.csv"), "day string, value double", "day", "yyyyMM")
    assert [r["ts"] for r in df.orderBy("value").collect()] == [dt.date(2020, 1, 1), None]


def test_written_partitions_read_back(panel, spark, tmp_path):
    p = panel({"a": [1, 2], "b": [3]})
    for fmt in ("parquet", "json", "orc"):
        out = str(tmp_path / fmt)
        files.write_table(p, out, fmt, ["series_id"])
        assert spark.read.format(fmt).load(out).count() == 3


def test_filters_reach_the_scan(spark):
    from tests.conftest import SF

    p = files.ingest(panels.event_ticks(spark, SF), start="2024-01-05", names=["view"])
    plan = p.select("value")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan and "GreaterThanOrEqual(ts" in plan
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "props" not in schema and "user_id" not in schema


def test_top_k_is_cut_before_the_shuffle(spark):
    from tests.conftest import SF

    p = resample.top_k(panels.event_ticks(spark, SF), ["series_id"], "value", 3, "event_id")
    assert "WindowGroupLimit" in p._jdf.queryExecution().executedPlan().toString()


SIGNALS = {
    "bubble": lambda p: signals.bubble(p, (3, 5), {"v": "variance"}),
    "abc": lambda p: signals.abc_pattern(p, 2, 3, 4),
    "auto": lambda p: signals.automatic_window(p, (2, 3, 5)),
    "belief": lambda p: signals.belief_states(p, 5),
    "code": lambda p: signals.binary_code(signals.six_attributes(p, 6)),
    "learn": lambda p: signals.block_learning(p, (3, 5)),
    "posterior": lambda p: sweep.posterior_search(p, (2, 3), (1.0,), (1.0, 2.0)),
    "kernel": lambda p: recursive.online_kernel(p, "ret", memory=3),
    "bias": lambda p: recursive.bias_learning(p, "ret", 3, 2),
    "breaker": lambda p: signals.anomaly_and_breaker(p, 8, 4),
}


@pytest.mark.parametrize("name", sorted(SIGNALS))
def test_no_look_ahead(panel, name):
    values = [100 + 10 * ((i * 7919) % 13 - 6) / 6 + (i * i) % 7 for i in range(40)]
    changed = values[:30] + [v * 1.7 for v in values[30:]]
    cut = dt.date(2020, 1, 1) + dt.timedelta(days=30)
    runs = []
    for v in (values, changed):
        out = SIGNALS[name](panels.returns(panel({"a": v}))).filter(F.col("ts") < F.lit(cut))
        runs.append(sorted(map(str, out.collect())))
    assert runs[0] == runs[1] and runs[0]


def test_fold_state_restarts_per_key_and_survives_batch_borders(panel, spark):
    p = panel({f"s{i}": [1, 2, 3, 4] for i in range(20)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = fold.ordered_fold(p, lambda k: recursive.Ewma(1.0), ["value"], "e double")
        assert all(column(out, "e", f"s{i}") == [1, 2, 3, 4] for i in range(20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
