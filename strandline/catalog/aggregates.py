"""Performance tables, forecast accuracy, tests and portfolio aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog.registry import query
from strandline.catalog.sqlparts import MONTHLY, SUPPLIER, WEEKLY, full, q, r, rets
from strandline.frames import trailing
from strandline.operators import evaluate as ev
from strandline.operators import portfolio as pf
from strandline.operators import window as win
from strandline.sources import panels

B = "(partition by series_id order by ts)"


def weekly(spark, path):
    return panels.returns(panels.ship_weekly(spark, path))


def supplier(spark, path):
    return panels.returns(panels.supplier_monthly(spark, path))


EQ = f"""
e as (select *, product(1 + ret) over {B} as w from rets where ret is not null),
d as (select *, w / max(w) over {B} - 1 as dd from e)"""


@query("F1_performance_annual", q(SUPPLIER, rets("supplier_m"), EQ.strip(), f"""
a as (select series_id, count(*) as periods, avg(ret) * 12 as mean, stddev_samp(ret) * sqrt(12) as std, sqrt(avg(pow(greatest(-ret, 0), 2))) as down,
      product(1 + ret) - 1 as total_return, min(dd) as max_drawdown from d group by 1)""", body=f"""
select series_id, periods, {r("mean", "mean")}, {r("std", "std")}, {r("mean / nullif(std, 0)", "sharpe")}, {r("mean / nullif(down, 0)", "sortino")},
 {r("total_return", "total_return")}, {r("max_drawdown", "max_drawdown")} from a"""))
def _(spark, path):
    return ev.performance_annual(supplier(spark, path), 12)


@query("F1_value_at_risk", q(SUPPLIER, rets("supplier_m"), body=f"""
select series_id, {r("quantile_cont(ret, 0.05)", "var_95")}, {r("quantile_cont(ret, 0.01)", "var_99")} from rets where ret is not null group by 1"""))
def _(spark, path):
    return ev.value_at_risk(supplier(spark, path))


@query("F2_performance_trading", q(SUPPLIER, rets("supplier_m"), EQ.strip(), """
a as (select series_id, count(*) as n, avg(ret) as mu, stddev_pop(ret) as sd, stddev_pop(case when ret < 0 then ret end) as nsd,
      product(1 + ret) - 1 as tr, min(dd) as mdd, count(*) filter (ret <> 0) as nt, count(*) filter (ret > 0) as np,
      sum(ret) filter (ret > 0) as sp, sum(ret) filter (ret < 0) as sn, avg(ret) filter (ret <> 0) as atr from d group by 1)""", body=f"""
select series_id, {r("tr", "total_return")}, {r("pow(1 + tr, 12.0 / n) - 1", "annualized_return")}, {r("mu * 12 / (sd * sqrt(12))", "sharpe_ratio")}, {r("mdd", "max_drawdown")},
 {r("np / nt", "win_rate")}, {r("sp / abs(sn)", "profit_factor")}, nt as num_trades, {r("atr", "avg_trade_return")}, {r("sd * sqrt(12)", "volatility")},
 {r("(pow(1 + tr, 12.0 / n) - 1) / abs(mdd)", "calmar_ratio")}, {r("mu * 12 / (nsd * sqrt(12))", "sortino_ratio")} from a"""))
def _(spark, path):
    return ev.performance_trading(supplier(spark, path), 12)


@query("F3_performance_plain", q(WEEKLY, rets("weekly"), EQ.strip(), """
a as (select series_id, count(*) as n, avg(ret) as mu, stddev_pop(ret) as sd, stddev_samp(ret) as ss, product(1 + ret) - 1 as tr, min(dd) as mdd from d group by 1)""", body=f"""
select series_id, {r("tr", "cumulative_return")}, {r("mu / sd", "sharpe_plain")}, {r("mu * sqrt(52) / ss", "sharpe_annual")},
 {r("(pow(1 + tr, 52.0 / n) - 1) / (ss * sqrt(52))", "sharpe_growth")}, {r("-mdd", "max_drawdown")} from a"""))
def _(spark, path):
    return ev.performance_plain(weekly(spark, path), 52)


@query("F4_return_by_year", q(SUPPLIER, rets("supplier_m"), body=f"""
select series_id, year(ts) as year, {r("product(1 + ret) - 1", "year_return")}, {r("sum(ret)", "year_sum")}, {r("quantile_cont(ret, 0.5)", "year_median")}
from rets where ret is not null group by 1, 2"""))
def _(spark, path):
    return ev.by_year(supplier(spark, path))


TAUS = [3, 5, 8, 13]
SW = " union all ".join(f"select series_id, ts, {n} as n, ret, ret * sign({full('avg(ret)', 'ret', n, 1)}) as strategy from rets" for n in TAUS)


def _sweep(spark, path):
    p = win.rolling_rows(weekly(spark, path), "ret", TAUS, ["mean"], ["series_id", "ts", "ret"], delay=1)
    return p.withColumn("strategy", F.col("ret") * F.signum("mean"))


@query("F5_excess_and_success", q(WEEKLY, rets("weekly"), f"s as ({SW})", """
x as (select series_id, n, product(1 + strategy) - product(1 + ret) as er from s where strategy is not null and ret is not null group by 1, 2)""", body=f"""
select series_id, {r("avg((er > 0)::int)", "success_share")}, {r("max(er)", "best")}, {r("avg(er)", "mean")}, {r("min(er)", "worst")}, count(*) as runs from x group by 1"""))
def _(spark, path):
    return ev.success_share(ev.excess_return(_sweep(spark, path), keys=("series_id", "n")))


@query("F6_describe", q(SUPPLIER, rets("supplier_m"), """
m as (select series_id, count(ret) as n, avg(ret) as m, avg(ret * ret) as m2, avg(ret ** 3) as m3, avg(ret ** 4) as m4, stddev_samp(ret) as sd, min(ret) as lo, max(ret) as hi,
 quantile_cont(ret, 0.25) as q1, quantile_cont(ret, 0.5) as q2, quantile_cont(ret, 0.75) as q3 from rets group by 1)""", body=f"""
select series_id, n as count, {r("m", "mean")}, {r("sd", "std")}, {r("lo", "min")}, {r("q1", "q25")}, {r("q2", "q50")}, {r("q3", "q75")}, {r("hi", "max")},
 {r("(m3 - 3 * m * m2 + 2 * m ** 3) / pow(m2 - m * m, 1.5)", "skew")}, {r("(m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m ** 4) / pow(m2 - m * m, 2) - 3", "kurtosis")} from m"""))
def _(spark, path):
    return ev.describe(supplier(spark, path), "ret")


@query("F7_top_choice_quartiles", q(WEEKLY, rets("weekly"), f"s as ({SW})", """
x as (select series_id, n, product(1 + strategy) - product(1 + ret) as er from s where strategy is not null and ret is not null group by 1, 2),
k as (select *, row_number() over (partition by series_id order by er desc, n) as rank from x)""", body=f"""
select rank, {r("quantile_cont(n, 0.25)", "q25")}, {r("quantile_cont(n, 0.5)", "q50")}, {r("quantile_cont(n, 0.75)", "q75")},
 array_to_string(list_sort(list(distinct n)), ',') as choices from k where rank <= 3 group by rank"""))
def _(spark, path):
    from strandline.operators.resample import top_k

    x = ev.excess_return(_sweep(spark, path), keys=("series_id", "n"))
    return ev.choice_quartiles(top_k(x, ["series_id"], "excess_return", 3, "n"), "rank", "n")


FC = f"""
f as (select series_id, ts, value as actual, lag(value) over {B} as prev, {full("avg(value)", "value", 6, 1)} as rolling, {full("stddev_samp(value)", "value", 6, 1)} as sd from weekly),
m as (select series_id, ts, 'naive' as model, actual, prev as forecast, prev, sd from f union all select series_id, ts, 'rolling', actual, rolling, prev, sd from f),
k as (select *, actual - forecast as e, forecast - 2 * sd as lo, forecast + 2 * sd as hi from m where actual is not null and forecast is not null)"""


def forecasts(spark, path):
    """Two benchmark forecasts as rows: last value and rolling mean of six."""
    from strandline.frames import ordered, stack_rows

    p = panels.ship_weekly(spark, path)
    w = trailing(6, delay=1)
    v = F.col("value")
    base = p.select("series_id", "ts", v.alias("actual"), F.lag(v).over(ordered()).alias("prev"),
                    win.stat("mean", v, w, 6).alias("rolling"), win.stat("std", v, w, 6).alias("sd"))
    return stack_rows(base, ["series_id", "ts", "actual", "prev", "sd"],
                      [{"model": "naive", "forecast": F.col("prev")}, {"model": "rolling", "forecast": F.col("rolling")}])


@query("F8_forecast_accuracy", q(WEEKLY, FC.strip(), body=f"""
select series_id, model, count(*) as n, {r("avg(abs(e))", "mae")}, {r("avg(e * e)", "mse")}, {r("sqrt(avg(e * e))", "rmse")}, {r("100 * avg(abs(e / nullif(actual, 0)))", "mape")},
 {r("1 - sum(e * e) / (var_pop(actual) * count(*))", "r2")}, {r("avg((sign(actual) = sign(forecast))::int)", "sign_accuracy")},
 {r("avg((sign(actual - prev) = sign(forecast - prev))::int)", "hit_rate")}, {r("avg((sd is not null and actual between lo and hi)::int) filter (sd is not null)", "coverage")}, {r("avg(hi - lo)", "sharpness")}
from k group by 1, 2"""))
def _(spark, path):
    f = forecasts(spark, path).withColumn("lo", F.col("forecast") - 2 * F.col("sd")).withColumn("hi", F.col("forecast") + 2 * F.col("sd"))
    return ev.forecast_accuracy(f, ["series_id", "model"], lower="lo", upper="hi", previous="prev")


@query("F9_relative_accuracy", q(WEEKLY, FC.strip(), """
s as (select series_id, model, avg(e * e) as mse, avg(abs(e)) as mae, avg(pow(e / actual, 2)) / avg(pow(e / forecast, 2)) as rr from k group by 1, 2)""", body=f"""
select s.series_id, s.model, {r("s.mse", "mse")}, {r("s.mae", "mae")}, {r("s.mse / b.mse", "rel_mse")}, {r("s.mae / b.mae", "rel_mae")}, {r("1 / sqrt(1000 * s.rr + 1)", "precision")}
from s join s b on s.series_id = b.series_id and b.model = 'naive'"""))
def _(spark, path):
    return ev.relative_accuracy(forecasts(spark, path), "naive", ["series_id"])


@query("F9_rolling_precision", q(WEEKLY, FC.strip(), """
p as (select series_id, ts, model, count(*) over w as n, avg(pow(e / actual, 2)) over w / avg(pow(e / forecast, 2)) over w as rr from k
      window w as (partition by series_id, model order by ts rows between 11 preceding and current row))""", body=f"""
select series_id, ts, model, {r("1 / sqrt(1000 * rr + 1)", "precision", 8)} from p where n = 12"""), digits=8)
def _(spark, path):
    f = forecasts(spark, path).dropna(subset=["actual", "forecast"])
    p = ev.rolling_precision(f, 12, ["series_id", "model"])
    return p.select("series_id", "ts", "model", "precision").dropna()


@query("F10_diebold_mariano", q(WEEKLY, FC.strip(), """
d as (select a.series_id, a.ts, a.e * a.e - b.e * b.e as d from k a join k b on a.series_id = b.series_id and a.ts = b.ts and a.model = 'naive' and b.model = 'rolling'),
l as (select *, lag(d, 1) over w as d1, lag(d, 2) over w as d2, lag(d, 3) over w as d3, lag(d, 4) over w as d4, lag(d, 5) over w as d5, lag(d, 6) over w as d6 from d window w as (partition by series_id order by ts)),
s as (select series_id, count(*) as n, avg(d) as m, floor(4 * pow(count(*) / 100.0, 2.0 / 9))::int as bw, var_samp(d) as g0, covar_samp(d, d1) as g1, covar_samp(d, d2) as g2, covar_samp(d, d3) as g3,
             covar_samp(d, d4) as g4, covar_samp(d, d5) as g5, covar_samp(d, d6) as g6 from l group by 1),
v as (select *, g0 + 2 * (greatest(1 - 1.0 / (bw + 1), 0) * g1 + greatest(1 - 2.0 / (bw + 1), 0) * g2 + greatest(1 - 3.0 / (bw + 1), 0) * g3 + greatest(1 - 4.0 / (bw + 1), 0) * g4
             + greatest(1 - 5.0 / (bw + 1), 0) * g5 + greatest(1 - 6.0 / (bw + 1), 0) * g6) as var from s)""", body=f"""
select series_id, n, bw as bandwidth, {r("m", "mean_difference")}, {r("m / sqrt(var / n)", "statistic")},
 {r("poly * exp(-pow(m / sqrt(var / n), 2) / 2)", "p_value")} from (
 select *, ((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u as poly from (
 select *, 1 / (1 + 0.3275911 * abs(m / sqrt(var / n)) / sqrt(2.0)) as u from v))"""))
def _(spark, path):
    f = forecasts(spark, path)
    e = F.col("actual") - F.col("forecast")
    wide = f.groupBy("series_id", "ts").agg(F.max(F.when(F.col("model") == "naive", e)).alias("a"), F.max(F.when(F.col("model") == "rolling", e)).alias("b"))
    return ev.diebold_mariano(wide, F.col("a") * F.col("a"), F.col("b") * F.col("b"))


@query("F11_replication_summary", """
select l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) as mean, round(stddev_samp(l_extendedprice), 6) as std, round(quantile_cont(l_extendedprice, 0.5), 6) as median,
 round(quantile_cont(l_extendedprice, 0.05), 6) as q05, round(quantile_cont(l_extendedprice, 0.95), 6) as q95 from lineitem group by 1, 2""")
def _(spark, path):
    return ev.replication_summary(panels.table(spark, path, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("F12_ensemble_summary", q(SUPPLIER, rets("supplier_m"), EQ.strip(), """
a as (select series_id, product(1 + ret) - 1 as cr, avg(ret) / stddev_pop(ret) as sh, -min(dd) as md from d group by 1),
g as (select min(cr) as lo, max(cr) as hi, count(*) as n, avg((cr > 0)::int) as sp, avg(cr) as er, avg(sh) as ms, avg(md) as mm from a),
h as (select least(floor((cr - lo) * 20 / (hi - lo)), 19) as bin, count(*) as c from a, g group by 1)""", body="""
select 'all' as ensemble, round(sp, 6) as success_probability, round(er, 6) as expected_return, round(ms, 6) as mean_sharpe, round(mm, 6) as mean_max_drawdown,
 round((select -sum(c / n::double * log2(c / n::double)) from h), 6) as return_entropy from g"""))
def _(spark, path):
    p = ev.performance_plain(supplier(spark, path), 12).withColumn("ensemble", F.lit("all"))
    return ev.ensemble_summary(p, ["ensemble"], "cumulative_return", "sharpe_plain", "max_drawdown")


@query("F13_modal_value", """
select l_returnflag, l_quantity::int as quantity, votes from (
 select l_returnflag, l_quantity, count(*) as votes, row_number() over (partition by l_returnflag order by count(*) desc, l_quantity) as k from lineitem group by 1, 2) where k = 1""")
def _(spark, path):
    li = panels.table(spark, path, "lineitem").withColumn("quantity", F.col("l_quantity").cast("int"))
    return ev.modal(li, ["l_returnflag"], "quantity")


WTS = {"A": 0.5, "N": 0.3, "R": 0.2}
PW = """
w(series_id, w) as (values ('A', 0.5), ('N', 0.3), ('R', 0.2)),
p as (select r.series_id, r.ts, r.ret, w.w from rets r join w using (series_id) where ret is not null)"""


def _weights(spark, path):
    m = F.create_map(*[F.lit(x) for k, v in WTS.items() for x in (k, v)])
    return weekly(spark, path).dropna(subset=["ret"]).withColumn("w", m[F.col("series_id")])


@query("F14_portfolio_returns", q(WEEKLY, rets("weekly"), PW.strip(), """
h as (select *, w * (1 + ret) / sum(w * (1 + ret)) over (partition by ts) as drifted from p),
t as (select *, abs(w - coalesce(lag(drifted) over (partition by series_id order by ts), 0)) as trade from h)""", body=f"""
select ts, {r("avg(ret)", "equal_weight")}, {r("sum(w * ret)", "gross")}, {r("sum(trade)", "turnover")}, {r("sum(w * ret) - 0.001 * sum(trade)", "net")} from t group by ts"""))
def _(spark, path):
    return pf.portfolio_returns(_weights(spark, path), cost=0.001)


@query("F14_portfolio_risk", q(WEEKLY, rets("weekly"), PW.strip(), """
c as (select a.series_id as i, b.series_id as j, any_value(a.w) as wi, any_value(b.w) as wj, covar_samp(a.ret, b.ret) as c from p a join p b on a.ts = b.ts group by 1, 2),
m as (select i, any_value(wi) as w, sum(c * wj) as marg, max(case when i = j then c end) as v from c group by 1),
t as (select sqrt(sum(w * marg)) as sd, sum(w * sqrt(v)) as avgsd from m)""", body=f"""
select i as series_id, {r("w", "weight")}, {r("marg / sd", "marginal_risk")}, {r("w * marg / sd", "component_risk")}, {r("w * marg / (sd * sd)", "risk_share")}, {r("sd", "portfolio_std")}, {r("avgsd / sd", "diversification_ratio")} from m, t"""))
def _(spark, path):
    return pf.portfolio_risk(weekly(spark, path), WTS)


@query("F15_return_attribution", q(WEEKLY, rets("weekly"), PW.strip(), body=f"""
select series_id, {r("sum(w * ret)", "contribution")}, {r("sum(w * ret) / sum(sum(w * ret)) over ()", "share")} from p group by 1"""))
def _(spark, path):
    return pf.attribution(_weights(spark, path))


SHOCKS = {"slump": {"A": -0.3, "N": -0.2, "R": 0.1}, "rates": {"A": 0.05, "N": -0.1}}


@query("F15_stress_scenarios", q(WEEKLY, rets("weekly"), PW.strip(), """
l as (select series_id, arg_max(w, ts) as w from p group by 1),
s(scenario, series_id, shock) as (values ('slump', 'A', -0.3), ('slump', 'N', -0.2), ('slump', 'R', 0.1), ('rates', 'A', 0.05), ('rates', 'N', -0.1))""", body="""
select scenario, round(sum(w * shock), 6) as impact from l join s using (series_id) group by 1"""))
def _(spark, path):
    from strandline.operators.resample import latest_per_key

    return pf.stress(latest_per_key(_weights(spark, path), ["series_id"], "ts", "w"), SHOCKS)


@query("F16_market_regime", q(WEEKLY, rets("weekly"), """
n as (select *, row_number() over (partition by series_id order by ts desc) as k from rets where ret is not null),
v as (select avg(x) as v from (select stddev_samp(ret) filter (k <= 20) / stddev_samp(ret) as x from n group by series_id)),
c as (select avg(x) as c from (select corr(a.ret, b.ret) as x from n a join n b on a.ts = b.ts and a.series_id < b.series_id and a.k <= 20 and b.k <= 20 group by a.series_id, b.series_id))""", body="""
select round(v, 6) as volatility_ratio, round(c, 6) as mean_correlation,
 case when v > 1.5 and c > 0.7 then 'crisis' when v > 1.2 then 'volatile' when c > 0.7 then 'high_correlation' else 'normal' end as regime from v, c"""))
def _(spark, path):
    return ev.market_regime(weekly(spark, path), ["A", "N", "R"], 20)


@query("F16_feedback_regime", q(WEEKLY, rets("weekly"), f"l as (select *, lag(ret) over {B} as l from rets)", """
a as (select series_id, ts, case when count(ret) over (partition by series_id order by ts rows between 19 preceding and current row) = 20
      then corr(ret, l) over (partition by series_id order by ts rows between 18 preceding and current row) end as a from l)""", body="""
select series_id, ts, round(a, 6) + 0.0 as autocorr, case when a is null then 'undefined' when abs(a) < 0.1 then 'homeostatic' when a > 0.3 then 'trending'
 when a < -0.3 then 'mean-reverting' else 'transitional' end as feedback from a"""))
def _(spark, path):
    return ev.feedback_regime(weekly(spark, path), "ret", 20).select("series_id", "ts", "autocorr", "feedback")


@query("F17_histogram", """
with g as (select l_returnflag, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by 1)
select l_returnflag, least(floor((l_extendedprice - low) * 30 / (high - low)), 29)::int as bin, count(*) as n, min(low) as low, max(high) as high
from lineitem join g using (l_returnflag) group by 1, 2""")
def _(spark, path):
    return ev.histogram(panels.table(spark, path, "lineitem"), "l_extendedprice", 30, ["l_returnflag"])
