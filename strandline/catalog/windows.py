"""Rolling, expanding and block operators over the panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog.registry import query
from strandline.catalog.sqlparts import DAILY, MONTHLY, WEEKLY, full, q, r, rets
from strandline.frames import SEG_KEYS
from strandline.operators import segment as sg
from strandline.operators import transform as tr
from strandline.operators import window as win
from strandline.sources import panels

B = "(partition by series_id order by ts)"


def weekly(spark, path):
    return panels.returns(panels.ship_weekly(spark, path))


@query("E1_rolling_statistics", q(WEEKLY, body="select series_id, ts, " + ", ".join(
    r(full(f"{f}(value)", "value", 12), n, 3) for f, n in [("avg", "mean"), ("sum", "sum"), ("stddev_samp", "std"), ("var_samp", "var"), ("min", "min"), ("max", "max")])
    + ", count(value) over (partition by series_id order by ts rows between 11 preceding and current row) as count from weekly"), digits=3)
def _(spark, path):
    p = win.rolling(panels.ship_weekly(spark, path), "value", 12, ["mean", "sum", "std", "var", "min", "max", "count"])
    return p.drop("value", "volume")


@query("E1_rolling_ticks_segmented", "select event_id, " + ", ".join(
    r(full(f"{f}(value)", "value", 20, part="event_type"), n) for f, n in [("avg", "mean"), ("stddev_samp", "std"), ("max", "max")]) + " from events")
def _(spark, path):
    t = sg.number_rows(panels.event_ticks(spark, path), tie=["event_id"]).withColumn("ts", F.col("rn"))
    p = win.rolling(sg.segmented(t, before=19, rows=500), "value", 20, ["mean", "std", "max"], keys=SEG_KEYS)
    return sg.drop_halo(p).select("event_id", "mean", "std", "max")


@query("E1_window_sweep", q(WEEKLY, body=" union all ".join(
    f"select series_id, ts, {n} as n, {r(full('avg(value)', 'value', n), 'mean')}, {r(full('stddev_samp(value)', 'value', n), 'std')} from weekly" for n in range(2, 37))))
def _(spark, path):
    return win.rolling_rows(panels.ship_weekly(spark, path), "value", range(2, 37), ["mean", "std"], ["series_id", "ts"])


@query("E2_expanding_statistics", q(WEEKLY, body=f"""
select series_id, ts, {r(f"avg(value) over {B}", "mean")}, {r(f"sum(value) over {B}", "sum")}, {r(f"quantile_cont(value, 0.75) over {B}", "quantile")} from weekly"""))
def _(spark, path):
    return win.expanding_stats(panels.ship_weekly(spark, path), "value", quantile=0.75).drop("value", "volume")


@query("E3_momentum", q(WEEKLY, rets("weekly"), body=f"""
select series_id, ts, {r(full("product(1 + ret)", "ret", 8) + " - 1", "momentum")} from rets"""))
def _(spark, path):
    return win.momentum(weekly(spark, path), 8).select("series_id", "ts", "momentum")


@query("E4_rolling_quantile_median", q(WEEKLY, body=f"""
select series_id, ts, {r(full("quantile_cont(value, 0.75)", "value", 9), "q75")}, {r(full("quantile_cont(value, 0.5)", "value", 9), "median")} from weekly"""))
def _(spark, path):
    p = win.rolling_quantile(panels.ship_weekly(spark, path), "value", 9, 0.75, out="q75")
    return win.rolling_quantile(p, "value", 9, 0.5, out="median").select("series_id", "ts", "q75", "median")


@query("E5_rolling_shape", q(WEEKLY, rets("weekly"), """
k as (select series_id, ts, count(ret) over w as n, avg(ret) over w as m, avg(ret * ret) over w as m2, avg(ret ** 3) over w as m3, avg(ret ** 4) over w as m4, skewness(ret) over w as ss, kurtosis(ret) over w as sk
      from rets window w as (partition by series_id order by ts rows between 19 preceding and current row))""", body=f"""
select series_id, ts,
 {r("case when n = 20 then (m3 - 3 * m * m2 + 2 * m ** 3) / pow(m2 - m * m, 1.5) end", "skew")},
 {r("case when n = 20 then (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m ** 4) / pow(m2 - m * m, 2) - 3 end", "kurt")},
 {r("case when n = 20 then ss end", "sample_skew")}, {r("case when n = 20 then sk end", "sample_kurt")} from k"""))
def _(spark, path):
    return win.rolling_shape(weekly(spark, path), "ret", 20).select("series_id", "ts", "skew", "kurt", "sample_skew", "sample_kurt")


@query("E6_rolling_correlation", q(WEEKLY, rets("weekly"), f"l as (select *, lag(volume, 1) over {B} as v1 from rets)", body="""
select series_id, ts,
  case when count(case when volume is not null then ret end) over w = 15 then round(corr(ret, volume) over w, 6) + 0.0 end as corr0,
  case when count(case when v1 is not null then ret end) over w = 15 then round(corr(ret, v1) over w, 6) + 0.0 end as corr1
from l window w as (partition by series_id order by ts rows between 14 preceding and current row)"""))
def _(spark, path):
    p = weekly(spark, path).withColumn("volume", F.col("volume").cast("double"))
    p = win.rolling_corr(p, "ret", "volume", 15, 0, out="corr0")
    return win.rolling_corr(p, "ret", "volume", 15, 1, out="corr1").select("series_id", "ts", "corr0", "corr1")


@query("E7_rolling_drawdown", q(WEEKLY, f"""
d as (select series_id, ts, value / max(value) over (partition by series_id order by ts rows between 9 preceding and current row) - 1 as dd from weekly)""",
    body=f"select series_id, ts, {r('abs(min(dd) over (partition by series_id order by ts rows between 9 preceding and current row))', 'max_drawdown')} from d"))
def _(spark, path):
    return win.rolling_drawdown(panels.ship_weekly(spark, path), 10).select("series_id", "ts", "max_drawdown")


@query("E8_equity_and_drawdown", q(WEEKLY, rets("weekly"), f"w as (select *, product(1 + coalesce(ret, 0)) over {B} as wealth from rets)", body=f"""
select series_id, ts, {r("wealth", "wealth")}, {r(f"wealth / max(wealth) over {B} - 1", "drawdown")} from w"""))
def _(spark, path):
    return win.equity(weekly(spark, path)).select("series_id", "ts", "wealth", "drawdown")


@query("E8_running_ticks_segmented", """
select event_id, round(sum(value) over w, 6) as total, round(exp(sum(ln(1 + value / 100000)) over w), 6) as wealth, max(value) over w as peak
from events window w as (partition by event_type order by ts)""")
def _(spark, path):
    t = sg.number_rows(panels.event_ticks(spark, path), tie=["event_id"])
    v = F.col("value")
    t = sg.running(t, {"total": (v, "sum"), "wealth": (1.0 + v / 100000.0, "product"), "peak": (v, "max")}, rows=500)
    return t.select("event_id", "total", "wealth", "peak")


def _weighted(n, alpha):
    num = " + ".join(f"{float(n - k) ** alpha} * lag(value, {k}) over {B}" for k in range(n))
    return f"({num}) / {sum(float(i) ** alpha for i in range(1, n + 1))}"


@query("E9_power_weighted_mean", q(WEEKLY, body=f"select series_id, ts, {r(_weighted(6, 1.0), 'linear')}, {r(_weighted(6, 3.0), 'cubic')} from weekly"))
def _(spark, path):
    p = win.power_weighted_mean(panels.ship_weekly(spark, path), "value", 6, 1.0, out="linear")
    return win.power_weighted_mean(p, "value", 6, 3.0, out="cubic").select("series_id", "ts", "linear", "cubic")


@query("E10_finite_memory_mean", q(WEEKLY, body="select series_id, ts, " + r(
    "(" + " + ".join(f"{0.8 ** k} * lag(value, {k}) over {B}" for k in range(5)) + f") / {sum(0.8 ** k for k in range(5))}", "memory_mean") + " from weekly"))
def _(spark, path):
    return win.finite_memory_mean(panels.ship_weekly(spark, path), "value", 5, 0.8).select("series_id", "ts", "memory_mean")


WINDOWS = [2, 3, 4, 5, 8]
STAR = {2: 1, 3: 1, 4: 1, 5: 1, 8: 2}


def _multi(scheme):
    w = {n: {"equal": 1.0, "complexity": 2.0 ** -n, "prior": 2.0 ** -STAR[n]}[scheme] for n in WINDOWS}
    return {n: v / sum(w.values()) for n, v in w.items()}


def _multi_sql(fn, scheme, delay=0, x="ret", pre=""):
    return " + ".join(f"{v!r} * coalesce({pre}({full(f'{fn}({x})', x, n, delay)}), 0)" for n, v in _multi(scheme).items())


@query("E11_multi_window_mean", q(WEEKLY, rets("weekly"), body="select series_id, ts, " + ", ".join(r(_multi_sql("avg", s), s) for s in ("equal", "complexity", "prior")) + " from rets"))
def _(spark, path):
    p = weekly(spark, path)
    for s in ("equal", "complexity", "prior"):
        p = win.multi_window_mean(p, "ret", WINDOWS, s, out=s)
    return p.select("series_id", "ts", "equal", "complexity", "prior")


@query("E12_martingale_gain", q(WEEKLY, rets("weekly"), f"""
m as (select *, coalesce(ret * lag(ret, 1) over {B}, 0) + coalesce(ret * lag(ret, 2) over {B}, 0) + coalesce(ret * lag(ret, 3) over {B}, 0) as p from rets)""",
    body=f"select series_id, ts, {r(_multi_sql('sum', 'complexity', 1, pre='2 * ret * '), 'gain')}, {r(_multi_sql('avg', 'prior', 0, 'p', pre='2 * '), 'moment_gain')} from m"))
def _(spark, path):
    p = win.martingale_gain(weekly(spark, path), "ret", WINDOWS, "complexity")
    return win.cross_moment_gain(p, "ret", WINDOWS, "prior", out="moment_gain").select("series_id", "ts", "gain", "moment_gain")


@query("E13_runs_ratio", q(WEEKLY, rets("weekly"), f"s as (select *, sign(ret) as s from rets)", f"c as (select *, (s <> lag(s) over {B})::int as c from s)",
    "p as (select *, (sum(c) over (partition by series_id order by ts rows between 10 preceding and current row) + 1) / 12.0 as p, count(s) over (partition by series_id order by ts rows between 11 preceding and current row) as k from c)",
    body=f"select series_id, ts, {r('case when k = 12 then p / nullif(1 - p, 0) end', 'runs_ratio')} from p"))
def _(spark, path):
    p = weekly(spark, path).withColumn("s", F.signum("ret"))
    return win.runs_ratio(p, "s", 12).select("series_id", "ts", "runs_ratio")


@query("E14_mean_to_median", q(WEEKLY, rets("weekly"), body=f"select series_id, ts, {r(f'''case when ({full('quantile_cont(ret, 0.5)', 'ret', 7)}) = 0 then ({full('avg(ret)', 'ret', 7)}) else ({full('avg(ret)', 'ret', 7)}) / ({full('quantile_cont(ret, 0.5)', 'ret', 7)}) end''', 'ratio')} from rets"))
def _(spark, path):
    return win.mean_to_median(weekly(spark, path), "ret", 7).select("series_id", "ts", "ratio")


@query("E15_histogram_entropy", q(WEEKLY, rets("weekly"), """
x as (select a.series_id, a.ts, b.ret, min(b.ret) over g as lo, max(b.ret) over g as hi, count(b.ret) over g as k
      from rets a join rets b on a.series_id = b.series_id and b.rn between a.rn - 24 and a.rn window g as (partition by a.series_id, a.ts)),
c as (select series_id, ts, least(floor((ret - lo) * 10 / (hi - lo)), 9) as bin, count(*) as n from x where k = 25 group by 1, 2, 3),
h as (select series_id, ts, -sum(n / 25.0 * ln(n / 25.0)) as h from c group by 1, 2)""", body=f"""
select r.series_id, r.ts, {r("h", "entropy")}, {r("1 - h / ln(10)", "information")} from rets r left join h using (series_id, ts)"""))
def _(spark, path):
    return win.histogram_entropy(weekly(spark, path), "ret", 25, 10).select("series_id", "ts", "entropy", "information")


@query("E16_sample_entropy", q(WEEKLY, rets("weekly"), """
t as (select series_id, rn, ts, ret as x0, lead(ret, 1) over w as x1, lead(ret, 2) over w as x2 from rets window w as (partition by series_id order by rn)),
o as (select series_id, ts, rn, greatest(0.2 * stddev_pop(ret) over f, 1e-9) as tol, count(ret) over f as k from rets window f as (partition by series_id order by rn rows between 19 preceding and current row)),
p as (select o.series_id, o.ts, sum((abs(a.x0 - b.x0) < tol and abs(a.x1 - b.x1) < tol)::int) as nb,
             sum((abs(a.x0 - b.x0) < tol and abs(a.x1 - b.x1) < tol and abs(a.x2 - b.x2) < tol)::int) as na
      from o join t a on a.series_id = o.series_id and a.rn between o.rn - 19 and o.rn - 2
             join t b on b.series_id = o.series_id and b.rn > a.rn and b.rn <= o.rn - 2
      where k = 20 group by 1, 2)""", body=f"""
select r.series_id, r.ts, {r("case when na > 0 and nb > 0 then -ln(na / nb) end", "sample_entropy")} from rets r left join p using (series_id, ts)"""))
def _(spark, path):
    return win.sample_entropy(weekly(spark, path), "ret", 20).select("series_id", "ts", "sample_entropy")


@query("E17_trend_and_noise", q(WEEKLY, rets("weekly"), body="""
select series_id, ts, case when count(value) over w = 14 then round(regr_slope(value, rn) over w, 6) + 0.0 end as slope,
 case when count(value) over w = 14 then round(var_pop(value) over w - regr_slope(value, rn) over w * covar_pop(value, rn) over w, 6) end as residual_variance
from rets window w as (partition by series_id order by ts rows between 13 preceding and current row)"""))
def _(spark, path):
    return win.trend(panels.ship_weekly(spark, path), "value", 14).select("series_id", "ts", "slope", "residual_variance")


@query("E18_delay_embedding", q(WEEKLY, body=f"""
select * from (select series_id, ts, round(lag(value, 3) over {B}, 6) as p0, round(lag(value, 2) over {B}, 6) as p1, round(lag(value, 1) over {B}, 6) as p2, round(value, 6) as p3 from weekly) where p0 is not null"""))
def _(spark, path):
    e = win.delay_embedding(panels.ship_weekly(spark, path), "value", 4)
    return e.select("series_id", "ts", *[F.col("pattern")[i].alias(f"p{i}") for i in range(4)])


E19 = f"""
m as (select *, {full("avg(ret)", "ret", 6)} as mean from rets),
e as (select *, lag(mean) over {B} as mu1, ret - lag(mean) over {B} as e from m),
t as (select a.series_id, a.ts, count(b.e) as k, avg((b.e <= -a.mu1)::int) as share from e a join e b on a.series_id = b.series_id and b.rn between a.rn - 5 and a.rn group by 1, 2)"""


@query("E19_error_tail_share", q(WEEKLY, rets("weekly"), E19.strip(), body=f"select m.series_id, m.ts, {r('m.mean', 'mean')}, {r('case when k = 6 then share end', 'tail_share')} from m join t using (series_id, ts)"))
def _(spark, path):
    return win.error_tail_share(weekly(spark, path), "ret", 6).select("series_id", "ts", "mean", "tail_share")


@query("E20_negative_share", q(WEEKLY, rets("weekly"), body=f"""
select series_id, ts, {r(full("avg((ret < 0)::int)", "ret", 10), "negative_share")}, {r("(" + full("sum((ret >= 0)::int)", "ret", 10) + " + 2) / 15.0", "posterior_mean")} from rets"""))
def _(spark, path):
    return win.negative_share(weekly(spark, path), "ret", 10, 2.0, 3.0).select("series_id", "ts", "negative_share", "posterior_mean")


@query("E21_past_conditions", q(WEEKLY, rets("weekly"), body="""
select series_id, ts, case when count(ret) over w = 3 then min(ret) over w > 0 end as all_up, case when count(ret) over w = 3 then max(ret) over w < 0 end as all_down,
 case when count(ret) over w = 3 then max(ret) over w > 0 end as any_up from rets window w as (partition by series_id order by ts rows between 3 preceding and 1 preceding)"""))
def _(spark, path):
    return win.past_conditions(weekly(spark, path), "ret", 3).select("series_id", "ts", "all_up", "all_down", "any_up")


BLOCKS = """
b as (select *, (row_number() over (partition by series_id order by ts) - 1) // 10 as block from rets where ret is not null),
bl as (select series_id, block, product(1 + ret) - 1 as block_ret, min(ts) as ts from b group by 1, 2)"""


@query("E22_block_returns", q(WEEKLY, rets("weekly"), BLOCKS.strip(), body=f"""
select series_id, block, ts, {r("block_ret", "block_ret")} from (select *, max(block) over (partition by series_id) as last from bl) where block < last"""))
def _(spark, path):
    return win.block_returns(weekly(spark, path), 10).select("series_id", "block", "ts", "block_ret")


@query("E23_reset_accumulators", q(WEEKLY, rets("weekly"), "b as (select *, (rn - 1) // 6 as block from rets)", body="""
select series_id, ts, block, sum((ret < 0)::int) over w as errors, round(product(1 + abs(ret) * (ret < 0)::int) over w, 6) as loss
from b window w as (partition by series_id, block order by ts)"""))
def _(spark, path):
    from strandline.frames import expanding

    b = win.reset_blocks(weekly(spark, path), 6)
    w = expanding(("series_id", "block"))
    down = (F.col("ret") < 0).cast("int")
    return b.select("series_id", "ts", "block", F.sum(down).over(w).alias("errors"), F.product(1.0 + F.abs("ret") * down).over(w).alias("loss"))


@query("E24_log_volume_ratio", q(WEEKLY, f"u as (select *, ln(volume) - ln({full('avg(volume)', 'volume', 7)}) as u from weekly)", body=f"""
select series_id, ts, {r("u", "u")}, {r(f"u / nullif(avg(abs(u)) over {B}, 0)", "rho_expanding")}, {r("u / nullif(" + full("avg(abs(u))", "u", 7) + ", 0)", "rho_rolling")} from u"""))
def _(spark, path):
    return tr.log_volume_ratio(panels.ship_weekly(spark, path), 7).select("series_id", "ts", "u", "rho_expanding", "rho_rolling")


@query("E25_centred_mean", q(MONTHLY, body=f"""
select series_id, ts, {r("avg(value) over (partition by series_id order by ts rows between 6 preceding and 5 following)", "centred_mean", 3)} from monthly"""), digits=3)
def _(spark, path):
    return win.centred_mean(panels.orders_monthly(spark, path), "value", 12).select("series_id", "ts", "centred_mean")


@query("E26_flag_spans", q(WEEKLY, rets("weekly"), f"f as (select *, (ret < 0)::int as f from rets where ret is not null)",
    f"c as (select *, f - lag(f) over {B} as c, max(ts) over (partition by series_id) as last from f)",
    f"e as (select *, lead(ts) over {B} as nxt from c where c <> 0)",
    body='select series_id, ts as start, coalesce(nxt, last) as "end" from e where c = 1'))
def _(spark, path):
    p = weekly(spark, path).dropna(subset=["ret"]).withColumn("down", (F.col("ret") < 0).cast("int"))
    return win.flag_spans(p, "down")


KIN = [f"k1 as (select *, value - lag(value) over {B} as v from weekly)", f"k2 as (select *, v - lag(v) over {B} as a from k1)"]


@query("E27_kinematics", q(WEEKLY, *KIN, body=f"""
select series_id, ts, {r("avg(v) over v5", "velocity")}, {r("avg(a) over a3", "acceleration")}, {r("abs(avg(sign(v)) over v5)", "coherence")}, {r("stddev_samp(v) over v5", "dispersion")},
 case when sign(v) = sign(a) and a <> 0 then 'momentum' else 'reversal' end as regime
from k2 window v5 as (partition by series_id order by ts rows between 4 preceding and current row), a3 as (partition by series_id order by ts rows between 2 preceding and current row)
qualify count(v) over v5 = 5 and count(a) over a3 = 3"""))
def _(spark, path):
    return win.kinematics(panels.ship_weekly(spark, path), "value").select("series_id", "ts", "velocity", "acceleration", "coherence", "dispersion", "regime").dropna()
