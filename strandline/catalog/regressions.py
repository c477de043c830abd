"""Regressions, forecasters and estimators."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from strandline.catalog.crosscorr import pairs_sql, week_pairs, weekly
from strandline.catalog.registry import query
from strandline.catalog.sqlparts import MONTHLY, WEEKLY, full, q, r, rets
from strandline.frames import ordered, stack_rows
from strandline.operators import align as al
from strandline.operators import forecast as fc
from strandline.operators import ml
from strandline.operators import nowcast as nc
from strandline.operators import refit as rf
from strandline.operators import regress as rg
from strandline.operators import transform as tr
from strandline.operators import evaluate as ev
from strandline.sources import panels

B = "(partition by series_id order by ts)"
Z = NormalDist().inv_cdf(0.975)


@query("H1_delay_regression_path", q(WEEKLY, rets("weekly"), pairs_sql("rets"), """
l as (select a.pair, (a.rn - b.rn)::int as lag, a.y, b.x from pr a join pr b on a.pair = b.pair and a.rn - b.rn between 1 and 8),
t as (select pair, lag, corr(y, x) as rho, regr_slope(y, x) as b, regr_intercept(y, x) as a from l group by 1, 2),
k as (select *, row_number() over (partition by pair order by round(abs(rho), 9) desc, lag) as k from t),
e as (select *, row_number() over (partition by pair order by ts desc)::int as j, max(ts) over (partition by pair) as last from pr)""", body=f"""
select e.pair, k.lag - e.j + 1 as step, cast(e.last + to_months(k.lag - e.j + 1) as date) as target, k.lag, {r("k.a + k.b * e.x", "forecast")} from e join k on k.pair = e.pair and k.k = 1 and e.j <= k.lag"""))
def _(spark, path):
    return rg.delay_regression_path(week_pairs(spark, path), range(0, 9))


def _lagged(spark, path):
    p = weekly(spark, path).withColumn("vol", F.log(F.col("volume").cast("double")))
    return tr.shift(tr.shift(p, "ret", 1, out="r1"), "vol", 1, out="v1")


L2 = f"l as (select *, lag(ret) over {B} as r1, lag(ln(volume)) over {B} as v1, ln(volume) as vol from rets)"
M2 = """m as (select *, case when ret is not null and r1 is not null and v1 is not null then 1 end as ok from l),
c as (select series_id, ts, ret, vol, count(ok) over w as n, avg(case when ok = 1 then ret end) over w as my, avg(case when ok = 1 then r1 end) over w as m1, avg(case when ok = 1 then v1 end) over w as m2,
   var_pop(case when ok = 1 then r1 end) over w as s11, var_pop(case when ok = 1 then v1 end) over w as s22, covar_pop(case when ok = 1 then r1 end, v1) over w as s12,
   covar_pop(case when ok = 1 then r1 end, ret) over w as s1y, covar_pop(case when ok = 1 then v1 end, ret) over w as s2y, var_pop(case when ok = 1 then ret end) over w as syy from m
   window w as (partition by series_id order by ts rows between {frame})),
b as (select *, (s1y * s22 - s2y * s12) / nullif(s11 * s22 - s12 * s12, 0) as b1, (s2y * s11 - s1y * s12) / nullif(s11 * s22 - s12 * s12, 0) as b2 from c)"""


@query("H2_rolling_regression", q(WEEKLY, rets("weekly"), L2, M2.replace("{frame}", "29 preceding and current row"), body=f"""
select series_id, ts, {r("b1", "b1")}, {r("b2", "b2")}, {r("my - b1 * m1 - b2 * m2", "intercept")}, {r("1 - (syy - b1 * s1y - b2 * s2y) / syy", "r2")},
 {r("my - b1 * m1 - b2 * m2 + b1 * ret + b2 * vol", "forecast")} from b where n = 30"""))
def _(spark, path):
    f = rg.rolling_ols(_lagged(spark, path), "ret", ["r1", "v1"], 30).filter("n = 30")
    return f.select("series_id", "ts", F.col("coef")[0].alias("b1"), F.col("coef")[1].alias("b2"), "intercept", "r2",
                    rg.predict(F.col("coef"), F.col("intercept"), [F.col("ret"), F.col("vol")]).alias("forecast"))


@query("H2_expanding_regression", q(WEEKLY, rets("weekly"), L2, M2.replace("{frame}", "unbounded preceding and current row"), body=f"""
select series_id, ts, {r("b1", "b1")}, {r("b2", "b2")} from b where n >= 40"""))
def _(spark, path):
    f = rg.rolling_ols(_lagged(spark, path), "ret", ["r1", "v1"], None, min_rows=40).filter("n >= 40")
    return f.select("series_id", "ts", F.col("coef")[0].alias("b1"), F.col("coef")[1].alias("b2"))


@query("H3_ar1_forecast", q(WEEKLY, f"l as (select series_id, ts, value, lag(value) over {B} as l, row_number() over {B} as rn from weekly)", """
g as (select *, regr_slope(value, l) over w as phi, regr_intercept(value, l) over w as c, (count(l) over w) as m,
   var_pop(case when l is not null then value end) over w - regr_slope(value, l) over w * covar_pop(value, l) over w as v from l window w as (partition by series_id order by ts rows between 38 preceding and current row)),
h as (select *, case when abs(phi) < 0.999 then c / (1 - phi) + pow(phi, 3) * (value - c / (1 - phi)) else value + 3 * c end as f,
   v * m / (m - 2) * (case when abs(phi) < 0.999 then 1 + pow(phi, 2) + pow(phi, 4) else 3 end) as var from g)""", body=f"""
select series_id, ts, case when rn >= 40 then round(phi, 6) + 0.0 end as phi, round(case when rn >= 40 then f when rn < 10 then value end, 6) as forecast,
 round(case when rn >= 40 then f - {Z!r} * sqrt(var) end, 6) as lower, round(case when rn >= 40 then f + {Z!r} * sqrt(var) end, 6) as upper from h"""))
def _(spark, path):
    p = fc.ar1(panels.ship_weekly(spark, path), "value", 3, 40)
    known = F.col("lower").isNotNull()
    return p.select("series_id", "ts", F.when(known, F.col("phi")).alias("phi"), "forecast", "lower", "upper")


AR2 = f"""l as (select series_id, ts, ret as y, lag(ret, 1) over {B} as a, lag(ret, 2) over {B} as b from rets),
m as (select series_id, count(*) as n, var_pop(y) as syy, var_pop(a) as saa, var_pop(b) as sbb, covar_pop(a, b) as sab, covar_pop(a, y) as say, covar_pop(b, y) as sby from l where y is not null and a is not null and b is not null group by 1),
f as (select series_id, n, 1 as p, syy - say * say / saa as s2 from m union all
      select series_id, n, 2, syy - (say * (say * sbb - sby * sab) + sby * (sby * saa - say * sab)) / (saa * sbb - sab * sab) from m),
ic as (select *, n * (ln(2 * pi()) + ln(s2) + 1) as ll2 from f)"""


@query("H4_order_criteria", q(WEEKLY, rets("weekly"), AR2, body=f"""
select series_id, p as "order", n, {r("2 * (p + 1) + ll2", "aic")}, {r("ln(n) * (p + 1) + ll2", "bic")}, {r("2 * ln(ln(n)) * (p + 1) + ll2", "hqic")}, {r("n * ln(s2) + p * ln(n)", "mdl")} from ic"""))
def _(spark, path):
    return rg.ar_orders(weekly(spark, path), "ret", 2).select("series_id", "order", "n", "aic", "bic", "hqic", "mdl")


@query("H4_order_selection", q(WEEKLY, rets("weekly"), AR2, body="""
select series_id, arg_min(p, n * ln(s2) + p * ln(n)) as "order", round(min(n * ln(s2) + p * ln(n)), 6) as mdl from ic group by 1"""))
def _(spark, path):
    b = rg.best_order(rg.ar_orders(weekly(spark, path), "ret", 2), "mdl")
    return b.select("series_id", "order", "mdl")


@query("H4_three_orders", q(WEEKLY, rets("weekly"), f"""
l as (select series_id, ts, ret as y, lag(ret, 1) over {B} as a, lag(ret, 2) over {B} as b, lag(ret, 3) over {B} as c from rets),
m as (select series_id, count(*) as n, var_pop(y) as yy, var_pop(a) as aa, var_pop(b) as bb, var_pop(c) as cc, covar_pop(a, b) as ab, covar_pop(a, c) as ac, covar_pop(b, c) as bc, covar_pop(a, y) as ay, covar_pop(b, y) as vy, covar_pop(c, y) as cy from l where y is not null and a is not null and b is not null and c is not null group by 1),
u as (select series_id, n, yy - ay * ay / aa as yy, bb - ab * ab / aa as bb, cc - ac * ac / aa as cc, bc - ab * ac / aa as bc, vy - ab * ay / aa as vy, cy - ac * ay / aa as cy from m),
v as (select series_id, n, yy as one, yy - vy * vy / bb as two, cc - bc * bc / bb as cc, cy - bc * vy / bb as cy from u),
f as (select series_id, n, 1 as p, one as s2 from v union all select series_id, n, 2, two from v union all select series_id, n, 3, two - cy * cy / cc from v),
ic as (select *, n * (ln(2 * pi()) + ln(s2) + 1) as ll2 from f)""", body=f"""
select series_id, p as "order", n, {r("2 * (p + 1) + ll2", "aic")}, {r("ln(n) * (p + 1) + ll2", "bic")}, {r("2 * ln(ln(n)) * (p + 1) + ll2", "hqic")}, {r("n * ln(s2) + p * ln(n)", "mdl")},
       row_number() over (partition by series_id order by round(ln(n) * (p + 1) + ll2, 9), p) = 1 as chosen from ic"""))
def _(spark, path):
    t = rg.ar_orders(weekly(spark, path), "ret", 3)
    b = rg.best_order(t, "bic").select("series_id", F.col("order").alias("best"))
    return t.join(b, "series_id").select("series_id", "order", "n", "aic", "bic", "hqic", "mdl", (F.col("order") == F.col("best")).alias("chosen"))


@query("H4_many_orders")
def _(spark, path):
    return rg.ar_orders(weekly(spark, path), "ret", 6).drop("coef")


@query("H5_threshold_regression", q(WEEKLY, rets("weekly"), L2, """
s as (select series_id, ret as y, r1 as o, v1 as x from l where ret is not null and r1 is not null and v1 is not null),
tq as (select series_id, unnest([quantile_cont(x, 0.1), quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75), quantile_cont(x, 0.9)]) as tau from s group by 1),
tt as (select distinct * from tq),
g as (select s.series_id, tau, x < tau as i, count(*) as n, var_pop(x) as sxx, covar_pop(x, y) as sxy, covar_pop(x, o) as sxo, var_pop(y) as syy, var_pop(o) as soo, covar_pop(y, o) as syo from s join tt using (series_id) group by 1, 2, 3),
h as (select series_id, tau, sum(n) as n, sum(n * (syy - sxy * sxy / sxx)) as yy, sum(n * (soo - sxo * sxo / sxx)) as oo, sum(n * (syo - sxy * sxo / sxx)) as yo from g group by 1, 2),
k as (select *, round((yy - yo * yo / oo) / (n - 5), 12) as mse, yo / oo as b from h)""", body=f"""
select series_id, {r("arg_min(tau, mse)", "tau")}, {r("min(mse)", "mse", 9)}, {r("arg_min(b, mse)", "own")} from k where mse is not null and not isnan(mse) group by 1"""), digits=9)
def _(spark, path):
    t = rg.threshold_search(_lagged(spark, path), "ret", "r1", "v1", [0.1, 0.25, 0.5, 0.75, 0.9])
    return t.select("series_id", F.round("tau", 6).alias("tau"), "mse", F.round(F.col("coef")[0], 6).alias("own"))


@query("H5_threshold_scan", q(WEEKLY, rets("weekly"), L2, """
s as (select series_id, ret as y, r1 as o, v1 as x from l where ret is not null and r1 is not null and v1 is not null),
c as (select series_id, x, count(*) as k, sum(count(*)) over (partition by series_id order by x) as upto, sum(count(*)) over (partition by series_id) as n from s group by 1, 2),
tt as (select series_id, x as tau from c where (upto - 1) * 10 >= n - 1 and (upto - k) * 10 <= 9 * (n - 1)),
g as (select s.series_id, tau, x < tau as i, count(*) as n, avg(x) as mx, avg(y) as my, avg(o) as mo, var_pop(x) as sxx, covar_pop(x, y) as sxy, covar_pop(x, o) as sxo, var_pop(y) as syy, var_pop(o) as soo, covar_pop(y, o) as syo from s join tt using (series_id) group by 1, 2, 3),
h as (select series_id, tau, sum(n) as n, sum(n * (syy - sxy * sxy / sxx)) as yy, sum(n * (soo - sxo * sxo / sxx)) as oo, sum(n * (syo - sxy * sxo / sxx)) as yo from g group by 1, 2 having min(sxx) > 0 and count(*) = 2),
b as (select *, yo / oo as own, count(*) over (partition by series_id) as tried from h qualify row_number() over (partition by series_id order by yy - yo * yo / oo, tau) = 1),
e as (select b.*, i, (sxy - own * sxo) / sxx as slope, my - own * mo - (sxy - own * sxo) / sxx * mx as level from b join g using (series_id, tau)),
f as (select series_id, tau, any_value((yy - yo * yo / oo) / (n - 5)) as mse, any_value(own) as own, max(case when not i then level end) as lr, max(case when i then level end) as ll, max(case when not i then slope end) as sr, max(case when i then slope end) as sl, any_value(n) as n, any_value(tried) as tried from (select e.* exclude (n), b.n from e join b using (series_id, tau)) group by 1, 2)""", body=f"""
select series_id, {r("tau", "tau")}, {r("mse", "mse", 9)}, n::bigint as n, {r("lr", "intercept")}, {r("own", "own")}, {r("sr", "slope")}, {r("ll - lr", "below")}, {r("sl - sr", "slope_below")}, tried from f"""), digits=9)
def _(spark, path):
    t = rg.threshold_scan(_lagged(spark, path), "ret", "r1", "v1")
    return t.select("series_id", "mse", "n", "tried", *[F.round(c, 6).alias(c) for c in ("tau", "intercept", "own", "slope", "below", "slope_below")])


@query("H6_ardl_long_run")
def _(spark, path):
    p = weekly(spark, path).withColumn("lv", F.log(F.col("volume").cast("double")))
    return rg.ardl_long_run(p, "ret", "lv", 2, 4).select("series_id", "n", "sum_x", "wald", "long_run", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


def _states(spark, path):
    p = tr.quadrant_dummies(weekly(spark, path))
    w = ordered()
    for c in ("up_gain", "up_loss", "down_gain"):
        p = p.withColumn(c, F.lag(F.col(c).cast("double")).over(w))
    return tr.shift(tr.shift(p, "ret", 1, out="r1"), "ret", 2, out="r2")


@query("H7_sequential_elimination")
def _(spark, path):
    s = rg.sequential_elimination(_states(spark, path), "ret", ["r1", "r2", "up_gain", "up_loss", "down_gain"], [0.5, 1.0, 1.64])
    return s.select("series_id", "n", "intercept", "r2", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), *[F.col("coef")[i].alias(f"b{i}") for i in range(5)])


@query("H8_two_equation_system")
def _(spark, path):
    return rg.two_equation_system(weekly(spark, path), "ret").drop("value", "volume")


@query("H9_basis_regression")
def _(spark, path):
    p = tr.lag_basis(weekly(spark, path).dropna(subset=["ret"]), "ret", [1], 2).withColumn("one", F.lit(1.0))
    b = rg.basis_regression(p, "ret", ["one", "t1_lag1", "t2_lag1"], 52, [0.01, 1.0], [0.005, 0.02], complete_only=True)
    return b.select("series_id", "ts", "mean", "deviation", "prior", "noise", "evidence")


@query("H10_elastic_net")
def _(spark, path):
    p, names = ml.lag_features(panels.returns(panels.supplier_monthly(spark, path)), "ret", [1, 2, 3, 12])
    out = ml.elastic_net(p, "ret", names, F.col("ts") < F.lit("1999-01-01").cast("date"), [0.001, 0.01], [0.0, 0.5])
    return out.select("series_id", "ts", "ret", "forecast")


def _quarters(spark, path, series, lags):
    """Quarterly growth of orders with its own lag and the newest weekly price changes known at the quarter's end."""
    end = F.date_sub(F.add_months(F.date_trunc("quarter", "ts").cast("date"), 3), 1)
    target = panels.orders_monthly(spark, path).groupBy("series_id", end.alias("ts")).agg(panels.exact_sum(F.col("value")).alias("value"))
    target = tr.shift(panels.returns(target), "ret", 1, out="before")
    weeks = weekly(spark, path).withColumn("ts", F.date_add("ts", 6))  # known when the week is over
    found = nc.recent_values(weeks, target.select("ts").distinct(), series, "ret", 91, 10, lags)
    names = [c for c in found.columns if c != "ts"]
    return target.join(found, "ts").dropna(subset=["ret", "before", *names]), [*names, "before"]


def _against_benchmark(rows, net):
    """Accuracy of the net and of the AR(1) benchmark over the same quarters."""
    both = net.join(nc.ar_benchmark(rows, "ret").select("series_id", "ts", "benchmark"), ["series_id", "ts"])
    models = stack_rows(both, ["series_id", "actual"], [{"model": "nowcast", "forecast": F.col("forecast")}, {"model": "ar1", "forecast": F.col("benchmark")}])
    return ev.forecast_accuracy(models, ["series_id", "model"])


@query("H10_nowcast_least_squares", q(WEEKLY, rets("weekly"), MONTHLY, f"""
qs as (select series_id, (date_trunc('quarter', ts) + interval 3 month - interval 1 day)::date as ts, sum(value) as value from monthly group by 1, 2)""", rets("qs", "qr"), f"""
ends as (select distinct ts as e from qs),
w as (select e, count(ret) as k, arg_max(ret, ts) filter (ret is not null) as x from ends left join rets on series_id = 'R' and ts + 6 between e - 91 and e group by 1),
x as (select e as ts, last_value(case when k >= 10 then x end ignore nulls) over (order by e) as x from w),
rows_ as (select * from (select series_id, ts, ret as y, lag(ret) over {B} as o from qr) join x using (ts) where y is not null and o is not null and x is not null),
a as (select *, lag(y) over {B} as py from rows_),
c as (select *, count(*) over w as n, avg(y) over w as my, avg(x) over w as mx, avg(o) over w as mo, var_pop(x) over w as sxx, var_pop(o) over w as soo, covar_pop(x, o) over w as sxo, covar_pop(x, y) over w as sxy, covar_pop(o, y) over w as soy,
  regr_slope(y, py) over w as ab, regr_intercept(y, py) over w as aa from a window w as (partition by series_id order by ts rows between unbounded preceding and 1 preceding)),
b as (select *, sxx * soo - sxo * sxo as det from c where n >= 10),
f as (select series_id, y, my + (sxy * soo - soy * sxo) / det * (x - mx) + (soy * sxx - sxy * sxo) / det * (o - mo) as nowcast, aa + ab * py as ar1 from b),
m as (select series_id, 'nowcast' as model, y, nowcast as p from f union all select series_id, 'ar1', y, ar1 from f)""", body=f"""
select series_id, model, count(*) as n, {r("avg(abs(y - p))", "mae")}, {r("avg((y - p) * (y - p))", "mse")}, {r("sqrt(avg((y - p) * (y - p)))", "rmse")}, {r("100 * avg(abs((y - p) / nullif(y, 0)))", "mape", 4)},
 {r("1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))", "r2")}, {r("avg((sign(y) = sign(p))::int)", "sign_accuracy")} from m group by 1, 2"""))
def _(spark, path):
    rows, names = _quarters(spark, path, ["R"], 1)
    return _against_benchmark(rows, nc.expanding_net(rows, "ret", names, 10)).withColumn("mape", F.round("mape", 4))


@query("H10_nowcast")
def _(spark, path):
    rows, names = _quarters(spark, path, ["A", "N", "R"], 8)
    return _against_benchmark(rows, nc.expanding_net(rows, "ret", names, 10, [0.1, 0.05, 0.02], 0.5))


def _direction(spark, path):
    p, names = ml.lag_features(panels.returns(panels.supplier_monthly(spark, path)), "ret", [1, 2, 3])
    for n in names:
        p = p.withColumn(f"{n}_up", (F.col(n) > 0).cast("double"))
    return p.withColumn("label", (F.col("ret") > 0).cast("double")).withColumn("quarter", F.quarter("ts").cast("string")), names


@query("H11_forest_classifier")
def _(spark, path):
    from strandline.operators import signals as sg
    from strandline.operators.sweep import split_share

    coded = sg.code_strategy(sg.binary_code(sg.six_attributes(weekly(spark, path))))
    p = coded.withColumn("label", (F.lead("ret").over(ordered()) > 0).cast("double")).withColumn("state", F.col("code").cast("string"))
    out = ml.forest_classifier(split_share(p, 0.5), "label", ["state"], ["action", "confidence"], F.col("part") == "train", trees=50)
    return out.select("series_id", "ts", "code", "label", "predicted", "probability")


@query("H12_network_classifier")
def _(spark, path):
    p, names = _direction(spark, path)
    out = ml.network_classifier(p, "label", [f"{n}_up" for n in names], F.col("ts") < F.lit("1998-06-01").cast("date"))
    return out.select("series_id", "ts", "label", "predicted", "probability")


def _refitted(spark, path):
    p, names = ml.lag_features(weekly(spark, path), "ret", [1, 2, 3, 4, 5])
    return rf.expanding_sign_network(p, "ret", names)


@query("H12_expanding_refit")
def _(spark, path):
    n = _refitted(spark, path)
    return n.select("series_id", "ts", "ret", "answer", "signal", (F.col("signal") * F.col("ret")).alias("trade"))


@query("H12_refit_schedule", q(WEEKLY, rets("weekly"), f"""
l as (select * from rets qualify lag(ret, 5) over {B} is not null),
c as (select series_id, ts, sign(ret)::double as label, (row_number() over {B} - 1)::int as n, avg(sign(ret)) over (partition by series_id order by ts rows between unbounded preceding and 1 preceding) as base from l)""", body=f"""
select series_id, ts, label, {r("base", "base")}, ((n - 126) // 126 + 1)::int as refits, (126 + (n - 126) // 126 * 126)::bigint as trained, true as ruled from c where n >= 126"""))
def _(spark, path):
    n = _refitted(spark, path)
    ruled = F.col("answer").between(-1, 1) & (F.col("signal") == F.when(F.col("answer") < F.col("base"), -1.0).otherwise(1.0))
    return n.select("series_id", "ts", "label", "base", "refits", "trained", ruled.alias("ruled"))


@query("H13_principal_components")
def _(spark, path):
    return ml.principal_components(panels.vectors(spark, path), "x", 3)


@query("G8_correlation_matrix_ml", """
with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings)
select a.i::int as i, b.i::int as j, round(corr(a.x, b.x), 6) + 0.0 as corr from e a join e b on a.vec_id = b.vec_id and a.i <= b.i group by 1, 2""")
def _(spark, path):
    return ml.correlation_matrix_ml(panels.vectors(spark, path), "x")


@query("H14_wilks_lambda", """
with g as (select l_returnflag as g, count(*) as n, avg(l_quantity) as m1, avg(l_discount) as m2, var_pop(l_quantity) as c11, covar_pop(l_quantity, l_discount) as c12, var_pop(l_discount) as c22 from lineitem group by 1),
t as (select count(*) as n, var_pop(l_quantity) * count(*) as t11, covar_pop(l_quantity, l_discount) * count(*) as t12, var_pop(l_discount) * count(*) as t22 from lineitem),
e as (select sum(n * c11) as e11, sum(n * c12) as e12, sum(n * c22) as e22, count(*) as groups from g)
select n, groups, round((e11 * e22 - e12 * e12) / (t11 * t22 - t12 * t12), 9) as wilks_lambda from t, e""", digits=9)
def _(spark, path):
    return rg.wilks_lambda(panels.table(spark, path, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag")


def kin_sql(w=5, a=3, h=2, width=1.5, name="kf"):
    return f"""{name}1 as (select series_id, ts, value, value - lag(value) over {B} as v from weekly),
{name}2 as (select *, v - lag(v) over {B} as a from {name}1),
{name}3 as (select *, avg(v) over wv as vb, avg(a) over wa as ab, abs(avg(sign(v)) over wv) as k, stddev_samp(v) over wv as sv, case when sign(v) = sign(a) and a <> 0 then 'momentum' else 'reversal' end as regime
  from {name}2 window wv as (partition by series_id order by ts rows between {w - 1} preceding and current row), wa as (partition by series_id order by ts rows between {a - 1} preceding and current row)
  qualify count(v) over wv = {w} and count(a) over wa = {a}),
{name} as (select *, case when regime = 'momentum' then value + {h} * k * vb + {h * (h + 1) / 2} * ab else value + 0.5 * {h} * k * vb end as f,
  {Z!r} * sv * sqrt({h}) * {width} * (1 + 0.5 * (1 - k)) as half from {name}3)"""


@query("H15_kinematic_forecast", q(WEEKLY, kin_sql(), body=f"select series_id, ts, {r('f', 'forecast')}, {r('f - half', 'lower')}, {r('f + half', 'upper')}, regime from kf"))
def _(spark, path):
    p = fc.kinematic(panels.ship_weekly(spark, path), "value", 2).filter("forecast is not null")
    return p.select("series_id", "ts", "forecast", "lower", "upper", "regime")


@query("H16_mean_reverting_blend", q(WEEKLY, kin_sql(), f"mu as (select series_id, ts, {full('avg(value)', 'value', 30)} as mu from weekly)",
    "b as (select kf.*, mu, 0.4 * (1 - k) as lam from kf join mu using (series_id, ts) where mu is not null)", body=f"""
select series_id, ts, {r("lam", "lambda")}, {r("(1 - lam) * f + lam * mu", "forecast")}, {r("(1 - lam) * f + lam * mu - half * (1 - 0.3 * lam)", "lower")} from b"""))
def _(spark, path):
    p = fc.mean_reverting(panels.ship_weekly(spark, path), "value", 2, "coherence", 0.4)
    return p.filter("forecast is not null").select("series_id", "ts", "lambda", "forecast", "lower")


@query("H16_acf_blend", q(WEEKLY, rets("weekly"), kin_sql(), """
w as (select a.series_id, a.ts, b.rn - a.rn + 30 as t, b.value - avg(b.value) over (partition by a.series_id, a.ts) as c, avg(b.value) over (partition by a.series_id, a.ts) as mu from rets a join rets b on a.series_id = b.series_id and b.rn between a.rn - 29 and a.rn where a.rn >= 30),
p as (select x.series_id, x.ts, y.t - x.t as lag, sum(x.c * y.c) as s, any_value(x.mu) as mu from w x join w y on x.series_id = y.series_id and x.ts = y.ts and y.t - x.t between 0 and 5 group by 1, 2, 3),
l as (select series_id, ts, any_value(mu) as mu, least(0.5, greatest(0.05, 1 - sum(abs(s)) filter (lag > 0) / max(s) filter (lag = 0) / 5)) as lam from p group by 1, 2)""",
    body=f"select series_id, ts, {r('lam', 'lambda')}, {r('(1 - lam) * f + lam * mu', 'forecast')} from kf join l using (series_id, ts)"))
def _(spark, path):
    p = fc.mean_reverting(panels.ship_weekly(spark, path), "value", 2, "acf")
    return p.filter("forecast is not null").select("series_id", "ts", "lambda", "forecast")


CFG = ((3, 2), (5, 3), (7, 3), (10, 5))


@query("H17_forecast_ensemble", q(WEEKLY, *[kin_sql(w, a, 2, 1.0, f"c{w}") for w, a in CFG], "u as (" + " union all ".join(f"select series_id, ts, f, 2 * half as w, k, regime from c{w}" for w, _ in CFG) + ")", f"""
g as (select series_id, ts, count(*) as n, quantile_cont(f, 0.5) as med, greatest(avg(w), 2 * {Z!r} * stddev_pop(f)) * 2 as width, avg(k) as k, sum((regime = 'momentum')::int) as votes from u group by 1, 2)""", body=f"""
select series_id, ts, {r("med", "forecast")}, {r("med - width / 2", "lower")}, {r("k", "coherence")}, case when 2 * votes >= 4 then 'momentum' else 'reversal' end as regime from g where n = 4"""))
def _(spark, path):
    p = fc.ensemble(panels.ship_weekly(spark, path), "value", 2, CFG)
    return p.filter("forecast is not null").select("series_id", "ts", "forecast", "lower", "coherence", "regime")


@query("H18_benchmark_forecasts", q(WEEKLY, f"d as (select *, value - lag(value) over {B} as v from weekly)", body=f"""
select series_id, ts, 'no_change' as model, {r("value", "forecast")}, {r(f"value - {Z!r} * (" + full("stddev_samp(v)", "v", 12) + ") * sqrt(2)", "lower")} from d
union all select series_id, ts, 'mean', {r(full("avg(value)", "value", 12), "forecast")}, {r("(" + full("avg(value)", "value", 12) + f") - {Z!r} * (" + full("stddev_samp(value)", "value", 12) + ") / sqrt(12)", "lower")} from d"""))
def _(spark, path):
    p = panels.ship_weekly(spark, path)
    a = fc.no_change(p, "value", 2, 12).withColumn("model", F.lit("no_change"))
    b = fc.rolling_mean_forecast(p, "value", 12).withColumn("model", F.lit("mean"))
    return a.unionByName(b).select("series_id", "ts", "model", "forecast", "lower")


TWO = f"f as (select series_id, ts, ret as actual, lag(ret) over {B} as a, {full('avg(ret)', 'ret', 6, 1)} as b from rets)"


def _two(spark, path):
    from strandline.frames import trailing
    from strandline.operators.window import stat

    x = F.col("ret")
    return weekly(spark, path).select("series_id", "ts", x.alias("actual"), F.lag(x).over(ordered()).alias("a"), stat("mean", x, trailing(6, delay=1), 6).alias("b")).dropna()


@query("H19_error_weighted_combination", q(WEEKLY, rets("weekly"), TWO, """
e as (select *, avg(pow(actual - a, 2)) over w as ma, avg(pow(actual - b, 2)) over w as mb, count(*) over w as n from f where actual is not null and a is not null and b is not null
   window w as (partition by series_id order by ts rows between unbounded preceding and 1 preceding)),
g as (select *, case when n >= 10 then 1 / (1 + exp(ma - mb)) else 0.5 end as wt from e)""", body=f"select series_id, ts, {r('wt', 'weight')}, {r('wt * a + (1 - wt) * b', 'combined')} from g"))
def _(spark, path):
    return fc.error_weighted(_two(spark, path), "actual", "a", "b").select("series_id", "ts", "weight", "combined")


@query("H20_switch_models", q(WEEKLY, rets("weekly"), TWO, """
m as (select series_id, ts, actual, 'a' as model, a as forecast from f where actual is not null and a is not null and b is not null union all select series_id, ts, actual, 'b', b from f where actual is not null and a is not null and b is not null),
p as (select *, 1 / sqrt(1000 * (avg(pow((actual - forecast) / actual, 2)) over w / avg(pow((actual - forecast) / forecast, 2)) over w) + 1) as prec, count(*) over w as n from m window w as (partition by series_id, model order by ts rows between 11 preceding and current row)),
c as (select series_id, ts, arg_max(model, prec) as best from p where n = 12 group by 1, 2),
l as (select series_id, ts, lag(best) over (partition by series_id order by ts) as chosen from c)""", body=f"""
select m.series_id, m.ts, m.model, {r("m.forecast", "forecast")} from m join l on l.series_id = m.series_id and l.ts = m.ts and m.model = l.chosen"""))
def _(spark, path):
    from strandline.frames import stack_rows

    t = stack_rows(_two(spark, path), ["series_id", "ts", "actual"], [{"model": "a", "forecast": F.col("a")}, {"model": "b", "forecast": F.col("b")}])
    return fc.switch_models(t, 12).select("series_id", "ts", "model", "forecast")


@query("H22_subsample_forecasts", q(WEEKLY, rets("weekly"), """
n as (select *, count(*) over (partition by series_id) as n, row_number() over (partition by series_id order by ts) as k from rets where ret is not null),
s as (select n.*, share, floor(share * n) as size from n, (values (0.25), (0.5), (0.75), (1.0)) v(share)),
z as (select *, lag(ret) over (partition by series_id, share order by ts) as l from s where k > n - size),
g as (select series_id, share::double as share, regr_slope(ret, l) as phi, regr_intercept(ret, l) as c, arg_max(ret, ts) as last, count(*) as n from z group by 1, 2)""", body=f"""
select series_id, share, {r("phi", "phi")}, n, {r("case when abs(phi) < 0.999 then c / (1 - phi) + pow(phi, 2) * (last - c / (1 - phi)) else last + 2 * c end", "forecast")} from g"""))
def _(spark, path):
    return fc.subsample_forecasts(weekly(spark, path), "ret", 2)


@query("H23_mixture_regimes")
def _(spark, path):
    p = weekly(spark, path).dropna(subset=["ret"])
    m = ml.two_means(ml.mixture_regimes(p, ["ret"]), ["ret"])
    return m.select("series_id", "ts", "p0", "p1", "cluster")


@query("H24_normal_fit", q(WEEKLY, rets("weekly"), "s as (select series_id, count(ret) as n, avg(ret) as mu, stddev_pop(ret) as sigma from rets group by 1)",
    "l as (select *, -n * (0.5 * ln(2 * pi()) + ln(sigma) + 0.5) as loglik from s)", body=f"""
select series_id, n, {r("mu", "mu")}, {r("sigma", "sigma")}, {r("loglik", "loglik")}, {r("4 - 2 * loglik", "aic")}, {r("2 * ln(n) - 2 * loglik", "bic")} from l"""))
def _(spark, path):
    return ev.normal_fit(weekly(spark, path), "ret")


@query("H25_trend_and_cycle", q(MONTHLY, """
x as (select series_id, ts, ln(value) as y, row_number() over (partition by series_id order by ts)::double / count(*) over (partition by series_id) as s from monthly),
b as (select series_id, ts, y, s as t1, 2 * s * s - 1 as t2 from x),
m as (select series_id, count(*) as n, avg(y) as my, avg(t1) as m1, avg(t2) as m2, var_pop(y) as syy, var_pop(t1) as saa, var_pop(t2) as sbb, covar_pop(t1, t2) as sab, covar_pop(t1, y) as say, covar_pop(t2, y) as sby from b group by 1),
c as (select *, say / saa as b11, (say * sbb - sby * sab) / (saa * sbb - sab * sab) as b21, (sby * saa - say * sab) / (saa * sbb - sab * sab) as b22 from m),
i as (select *, n * ln(syy - b11 * say) + 2 * ln(n) as bic1, n * ln(syy - b21 * say - b22 * sby) + 3 * ln(n) as bic2 from c)""", body=f"""
select b.series_id, b.ts, case when bic1 <= bic2 then 1 else 2 end as degree,
 {r("100 * (y - case when bic1 <= bic2 then my + b11 * (t1 - m1) else my + b21 * (t1 - m1) + b22 * (t2 - m2) end)", "cycle")},
 case when ts between date '1996-02-01' and date '1996-08-31' then 1 else 0 end as recession from b join i using (series_id)"""))
def _(spark, path):
    t = rg.trend_cycle(panels.orders_monthly(spark, path), "value", 2)
    return t.select("series_id", "ts", "degree", "cycle", al.flag_intervals(t, [("1996-02-01", "1996-08-31")]).alias("recession"))
