"""Lead/lag, spectrum and information queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandline.catalog.registry import query
from strandline.catalog.sqlparts import MONTHLY, WEEKLY, full, q, r, rets
from strandline.operators import align as al
from strandline.operators import crosscorr as cc
from strandline.operators import information as inf
from strandline.operators import spectral as sp
from strandline.operators import window as win
from strandline.sources import panels

B = "(partition by series_id order by ts)"
FLAGS = ["A", "N", "R"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PAIRS_W = al.all_pairs(FLAGS)
PAIRS_M = al.all_pairs(PRIORITIES)


def weekly(spark, path):
    return panels.returns(panels.ship_weekly(spark, path))


def week_pairs(spark, path):
    return al.pair_rows(weekly(spark, path), PAIRS_W, "ret")


def month_pairs(spark, path):
    return al.pair_rows(panels.returns(panels.orders_monthly(spark, path)), PAIRS_M, "ret")


def pairs_sql(src: str, name: str = "pr") -> str:
    return f"""{name} as (select *, row_number() over (partition by pair order by ts) as rn from (
 select a.series_id || '~' || b.series_id as pair, a.ts, a.ret as y, b.ret as x from {src} a join {src} b on a.ts = b.ts and a.series_id < b.series_id where a.ret is not null and b.ret is not null))"""


LAGTAB = """t as (select a.pair, (a.rn - b.rn)::int as lag, corr(a.y, b.x) as rho, count(*) as n from pr a join pr b on a.pair = b.pair and a.rn - b.rn between 0 and 48 group by 1, 2)"""


@query("G1_lag_correlations", q(MONTHLY, rets("monthly"), pairs_sql("rets"), LAGTAB, body=f"select pair, lag, {r('rho', 'rho')}, n from t"))
def _(spark, path):
    return cc.lag_correlations(month_pairs(spark, path), range(0, 49))


@query("G1_both_directions", q(WEEKLY, rets("weekly"), pairs_sql("rets"), body=f"""
select a.pair, (a.rn - b.rn)::int as lag, {r("corr(a.y, b.x)", "rho")}, count(*) as n from pr a join pr b on a.pair = b.pair and abs(a.rn - b.rn) <= 6 group by 1, 2"""))
def _(spark, path):
    return cc.both_directions(week_pairs(spark, path), range(0, 7))


@query("G2_best_lag", q(MONTHLY, rets("monthly"), pairs_sql("rets"), LAGTAB, body=f"""
select pair, lag as best_lag, {r("rho", "best_rho")} from (select *, row_number() over (partition by pair order by abs(round(rho, 9)) desc, lag) as k from t where lag <= 12) where k = 1"""))
def _(spark, path):
    t = cc.lag_correlations(month_pairs(spark, path), range(0, 13)).withColumn("rho", F.round("rho", 9))
    return cc.best_lag(t)


@query("E6_pair_correlations", q(WEEKLY, rets("weekly"), pairs_sql("rets"), body="""
select pair, ts, case when count(*) over w = 15 then round(corr(y, x) over w, 6) + 0.0 end as corr
from pr window w as (partition by pair order by ts rows between 14 preceding and current row)"""))
def _(spark, path):
    return win.rolling_corr(week_pairs(spark, path).dropna(subset=["y", "x"]), "y", "x", 15, keys=("pair",)).select("pair", "ts", "corr")


STARTS = ["1995-01-01", "1996-01-01", "1997-01-01", "1998-01-01"]


@query("G3_best_lag_by_start", q(WEEKLY, rets("weekly"), pairs_sql("rets"), """
s(start) as (values (date '1995-01-01'), (date '1996-01-01'), (date '1997-01-01'), (date '1998-01-01')),
t as (select a.pair, start, (a.rn - b.rn)::int as lag, round(corr(a.y, b.x), 9) as rho from pr a join pr b on a.pair = b.pair and a.rn - b.rn between 0 and 12 join s on b.ts >= start group by 1, 2, 3)""",
    body=f"""select pair, start, lag as best_lag, {r("rho", "best_rho")} from (select *, row_number() over (partition by pair, start order by abs(rho) desc, lag) as k from t) where k = 1"""))
def _(spark, path):
    t = cc.lag_correlations(week_pairs(spark, path), range(0, 13), starts=STARTS).withColumn("rho", F.round("rho", 9))
    return cc.best_lag(t, ["pair", "start"])


@query("G4_rolling_best_lag", q(WEEKLY, rets("weekly"), pairs_sql("rets"), """
o as (select pair, ts, rn from pr where rn >= 26),
c as (select o.pair, o.ts, o.rn, (a.rn - b.rn)::int as lag, corr(a.y, b.x) as rho from o join pr a on a.pair = o.pair and a.rn between o.rn - 25 and o.rn
       join pr b on b.pair = o.pair and b.rn between o.rn - 25 and o.rn and a.rn - b.rn between 1 and 6 group by 1, 2, 3, 4),
k as (select *, row_number() over (partition by pair, ts order by abs(round(rho, 9)) desc, lag) as k from c)""", body=f"""
select k.pair, k.ts, k.lag as best_lag, {r("k.rho", "best_rho")}, {r("b.x", "driver")}, {r("1 - sqrt(1 - k.rho * k.rho)", "information")},
  {r("n.y * sign(k.rho * b.x)", "strategy")}
from k join pr b on b.pair = k.pair and b.rn = k.rn - k.lag + 1 left join pr n on n.pair = k.pair and n.rn = k.rn + 1 where k.k = 1"""))
def _(spark, path):
    from strandline.frames import ordered

    p = cc.rolling_best_lag(week_pairs(spark, path), 26, range(1, 7), complete_only=True)
    p = p.withColumn("information", cc.information_from_corr(F.col("best_rho")))
    nxt = F.lead("y").over(ordered(("pair",)))
    return p.withColumn("strategy", nxt * F.signum(F.col("best_rho") * F.col("driver"))).drop("y", "x")


@query("G5_information_of_lags", q(MONTHLY, rets("monthly"), pairs_sql("rets"), LAGTAB, body=f"select pair, lag, {r('1 - sqrt(1 - rho * rho)', 'information')} from t where lag <= 12"))
def _(spark, path):
    t = cc.lag_correlations(month_pairs(spark, path), range(0, 13))
    return t.select("pair", "lag", cc.information_from_corr(F.col("rho")).alias("information"))


@query("G6_autocorrelation", q(WEEKLY, rets("weekly"), f"c as (select *, ret - avg(ret) over (partition by series_id) as c from rets where ret is not null)", """
l as (select a.series_id, (a.rn - b.rn)::int as lag, sum(a.c * b.c) as s from c a join c b on a.series_id = b.series_id and a.rn - b.rn between 1 and 12 group by 1, 2),
v as (select series_id, sum(c * c) as v from c group by 1)""", body=f"select series_id, lag, {r('s / v', 'acf')} from l join v using (series_id)"))
def _(spark, path):
    return cc.autocorrelation(weekly(spark, path), "ret", range(1, 13))


@query("G7_periodogram", q(MONTHLY, """
x as (select series_id, row_number() over (partition by series_id order by ts) - 1 as t, count(*) over (partition by series_id) as n, (value - avg(value) over (partition by series_id)) / 1000000 as x from monthly),
k as (select x.*, unnest(generate_series(0, n // 2)) as k from x)""", body=f"""
select series_id, k, round(k / max(n)::double, 6) as frequency, {r("(pow(sum(x * cos(2 * pi() * k * t / n)), 2) + pow(sum(x * sin(2 * pi() * k * t / n)), 2)) / max(n)", "power")} from k group by 1, 2"""))
def _(spark, path):
    p = panels.orders_monthly(spark, path).withColumn("value", F.col("value") / 1000000)
    return sp.periodogram(p, "value").select("series_id", F.col("k").cast("long").alias("k"), "frequency", "power")


def _segments(src, key, cols):
    """Half-overlapping Hann segments of 36 rows, as sums per frequency."""
    means = ", ".join(f"{c} - avg({c}) over (partition by {key}, seg) as d_{c}" for c in cols)
    sums = ", ".join(f"sum(h * d_{c} * cos(2 * pi() * k * p / 36)) as re_{c}, sum(-h * d_{c} * sin(2 * pi() * k * p / 36)) as im_{c}" for c in cols)
    return f"""sg as (select {src}.*, unnest(generate_series(greatest(0, ceil((rn - 1 - 35) / 18.0)::int), (rn - 1) // 18)) as seg from {src}),
 sm as (select *, rn - 1 - seg * 18 as p, 0.5 - 0.5 * cos(2 * pi() * (rn - 1 - seg * 18) / 36) as h, count(*) over (partition by {key}, seg) as m, {means} from sg),
 fx as (select sm.*, unnest(generate_series(0, 18)) as k from sm where m = 36),
 sf as (select {key}, seg, k, {sums} from fx group by 1, 2, 3)"""


@query("G7_welch_spectrum", q(WEEKLY, rets("weekly", "r0"), "rr as (select series_id, ts, ret, row_number() over (partition by series_id order by ts) as rn from r0 where ret is not null)",
    _segments("rr", "series_id", ["ret"]), body=f"""
select series_id, k, {r("k / 36.0", "frequency")}, count(*) as segments, {r("avg(case when k in (0, 18) then 1 else 2 end * (re_ret * re_ret + im_ret * im_ret)) / (18.0 * 18.0)", "power", 9)} from sf group by 1, 2"""), digits=9)
def _(spark, path):
    w = sp.welch(weekly(spark, path), "ret")
    return w.select("series_id", F.col("k").cast("long").alias("k"), F.round("frequency", 6).alias("frequency"), "segments", "power")


@query("G7_coherence", q(WEEKLY, rets("weekly"), pairs_sql("rets"), _segments("pr", "pair", ["y", "x"]), """
a as (select pair, k, avg(re_y * re_x + im_y * im_x) as c, avg(im_y * re_x - re_y * im_x) as q, avg(re_y * re_y + im_y * im_y) as yy, avg(re_x * re_x + im_x * im_x) as xx from sf group by 1, 2)""",
    body=f"select pair, k, {r('k / 36.0', 'frequency')}, {r('(c * c + q * q) / (yy * xx)', 'coherence')} from a"))
def _(spark, path):
    c = sp.coherence(week_pairs(spark, path))
    return c.select("pair", F.col("k").cast("long").alias("k"), "frequency", "coherence")


@query("G8_correlation_matrix", q(MONTHLY, rets("monthly"), body=f"""
select a.series_id as i, b.series_id as j, {r("corr(a.ret, b.ret)", "corr")}, {r("covar_samp(a.ret, b.ret)", "cov")} from rets a join rets b on a.ts = b.ts and a.series_id <= b.series_id group by 1, 2"""))
def _(spark, path):
    return cc.correlation_matrix(panels.returns(panels.orders_monthly(spark, path)), PRIORITIES, "ret")


@query("G9_proximity_components", q(WEEKLY, rets("weekly"), """
x as (select a.series_id, a.ts, b.ret as v, count(*) over (partition by a.series_id, a.ts) as k from rets a join rets b on a.series_id = b.series_id and b.rn between a.rn - 29 and a.rn where b.ret is not null),
g as (select *, v - lag(v) over (partition by series_id, ts order by v) < 0.01 as near from x where k = 30),
h as (select *, lag(near) over (partition by series_id, ts order by v) as before from g),
c as (select series_id, ts, sum((near and not coalesce(before, false))::int) as comp, sum(coalesce(near, false)::int) as edges from h group by 1, 2)""", body=f"""
select series_id, ts, comp::int as components, (comp + edges)::int as nodes, {r("case when comp + edges = 0 then 0.5 else comp / (comp + edges) end", "persistence")} from c"""))
def _(spark, path):
    p = inf.proximity_components(weekly(spark, path), "ret", 30, 0.01)
    return p.filter("nodes is not null").select("series_id", "ts", "components", "nodes", "persistence")


FEATS = f"f as (select *, lag(ret) over {B} as l1, lag(ret, 2) over {B} as l2, volume::double as vol from rets)"


@query("G10_mutual_information", q(WEEKLY, rets("weekly"), FEATS, """
u as (select series_id, ts, ret, 'l1' as feature, l1 as x from f where l1 is not null and ret is not null union all select series_id, ts, ret, 'l2', l2 from f where l2 is not null and ret is not null
      union all select series_id, ts, ret, 'vol', vol from f where ret is not null),
b as (select *, ntile(4) over (partition by series_id, feature order by x, ts) as bx, ntile(4) over (partition by series_id, feature order by ret, ts) as bt from u),
c as (select series_id, feature, bx, bt, count(*)::double as n from b group by all),
t as (select *, sum(n) over (partition by series_id, feature) as nn, sum(n) over (partition by series_id, feature, bx) as nx, sum(n) over (partition by series_id, feature, bt) as ny from c),
m as (select series_id, feature, sum(n / nn * ln(n * nn / (nx * ny))) as mi from t group by 1, 2)""", body=f"""
select series_id, feature, {r("mi", "mutual_information")}, row_number() over (partition by series_id order by mi desc, feature) as rank from m"""))
def _(spark, path):
    from strandline.operators.transform import shift

    p = weekly(spark, path).withColumn("vol", F.col("volume").cast("double"))
    p = shift(shift(p, "ret", 1, out="l1"), "ret", 2, out="l2")
    return inf.mutual_information(p, ["l1", "l2", "vol"], "ret", 4)


@query("G11_transfer_entropy", q(WEEKLY, rets("weekly"), f"d as (select *, volume - lag(volume) over {B} as dv from rets)",
    f"s as (select series_id, lead((ret > 0)::int) over {B} as n, (ret > 0)::int as y, (dv > 0)::int as x from d)", """
c as (select series_id, n, y, x, count(*)::double as c from s where n is not null and y is not null and x is not null group by all),
t as (select *, sum(c) over (partition by series_id) as tot, sum(c) over (partition by series_id, y, x) as nyx, sum(c) over (partition by series_id, n, y) as nny, sum(c) over (partition by series_id, y) as ny from c)""",
    body=f"select series_id, {r('sum(c / tot * log2((c / nyx) / (nny / ny)))', 'transfer_entropy')}, sum(c)::bigint as n from t group by 1"))
def _(spark, path):
    from strandline.operators.transform import difference

    return inf.transfer_entropy(difference(weekly(spark, path), "volume", out="dv"), "dv", "ret")


GRID = [i / 10 for i in range(11)]


@query("G12_fractional_order", q(WEEKLY, rets("weekly"), f"""
w as (select a.series_id, a.ts, b.value as v, b.rn - a.rn + 23 as t from rets a join rets b on a.series_id = b.series_id and b.rn between a.rn - 23 and a.rn where a.rn >= 24),
f as (select w.*, unnest(generate_series(0, 11)) as k from w),
p as (select series_id, ts, k, 2.0 / 24 * sqrt(pow(sum(v * cos(2 * pi() * ((k * t) % 24) / 24)), 2) + pow(sum(v * sin(2 * pi() * ((k * t) % 24) / 24)), 2)) as p, 4 * pow(sin(pi() * k / 24), 2) as g from f group by 1, 2, 3),
d as (select p.*, unnest({GRID!r}::double[]) as d from p),
l as (select series_id, ts, d, 12 * ln(avg(case when k = 0 then (case when d = 0 then p else 0 end) else pow(g, d) * p end)) + d * sum(case when k > 0 then ln(g) else 0 end) + 12 as loss from d group by 1, 2, 3)""",
    body='select series_id, ts, round(arg_min(d, loss), 6) as "order" from l group by 1, 2'))
def _(spark, path):
    p = sp.fractional_order(panels.ship_weekly(spark, path), "value", 24, GRID, complete_only=True)
    return p.select("series_id", "ts", "order")


@query("G13_wiener_filter", q(WEEKLY, rets("weekly"), """
w as (select a.series_id, a.ts, b.ret as v, b.rn - a.rn + 15 as t from rets a join rets b on a.series_id = b.series_id and b.rn between a.rn - 15 and a.rn where a.rn >= 17),
nz as (select series_id, ts, var_pop(v) - regr_slope(v, t) * covar_pop(v, t) as noise from w group by 1, 2),
f as (select w.*, unnest(generate_series(0, 15)) as k from w),
s as (select series_id, ts, k, sum(v * cos(2 * pi() * ((k * t) % 16) / 16)) as re, -sum(v * sin(2 * pi() * ((k * t) % 16) / 16)) as im from f group by 1, 2, 3),
h as (select s.*, greatest((re * re + im * im) / 16, 1e-10) as pw, noise from s join nz using (series_id, ts))""", body=f"""
select series_id, ts, {r("sum(pw / (pw + noise) * (re * cos(2 * pi() * ((k * 15) % 16) / 16) - im * sin(2 * pi() * ((k * 15) % 16) / 16))) / 16", "filtered", 8)} from h group by 1, 2"""), digits=8)
def _(spark, path):
    p = sp.wiener_last(weekly(spark, path), "ret", 16, complete_only=True)
    return p.select("series_id", "ts", "filtered")


@query("G14_exponential_distance", q(WEEKLY, rets("weekly"), """
x as (select series_id, abs(ret) as x, row_number() over (partition by series_id order by abs(ret)) as k, count(*) over (partition by series_id) as n, min(abs(ret)) over (partition by series_id) as loc,
       avg(abs(ret)) over (partition by series_id) - min(abs(ret)) over (partition by series_id) as s from rets where ret is not null),
c as (select *, 1 - exp(-(x - loc) / s) as f from x)""", body=f"""
select series_id, {r("max(greatest(abs(k / n::double - f), abs(f - (k - 1) / n::double)))", "distance")}, {r("max(loc)", "location")}, {r("max(s)", "scale")}, count(*) as n from c group by 1"""))
def _(spark, path):
    return inf.exponential_distance(weekly(spark, path).withColumn("a", F.abs("ret")), "a")


@query("G14_cumulative_line", q(WEEKLY, rets("weekly"), f"s as (select series_id, sum(abs(ret)) over {B} as s, row_number() over {B} - 1 as t from rets where ret is not null)", body=f"""
select series_id, {r("regr_slope(s, t)", "slope")}, {r("regr_intercept(s, t)", "intercept")}, {r("regr_r2(s, t)", "r2")} from s group by 1"""))
def _(spark, path):
    return inf.cumulative_line(weekly(spark, path), "ret")


def phi(z):
    u = f"(abs({z}) / {math.sqrt(2.0)!r})"
    t = f"(1 / (1 + 0.3275911 * {u}))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    half = f"0.5 * (1 - {poly} * exp(-{u} * {u}))"
    return f"(case when {z} >= 0 then 0.5 + {half} else 0.5 - {half} end)"


@query("G15_normal_chi_square", q("""
f as (select l_returnflag, count(*) as n, avg(l_extendedprice) as mu, stddev_pop(l_extendedprice) as sd, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem group by 1),
o as (select l_returnflag, least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49)::int as b, count(*) as o from lineitem join f using (l_returnflag) group by 1, 2),
e as (select f.*, unnest(generate_series(0, 49)) as b from f),
z as (select *, (lo + b * ((hi - lo) / 50) - mu) / sd as z0, (lo + (b + 1) * ((hi - lo) / 50) - mu) / sd as z1 from e),
c as (select z.l_returnflag, z.b, coalesce(o.o, 0) as o, n * (""" + phi("z1") + " - " + phi("z0") + """) as e from z left join o on o.l_returnflag = z.l_returnflag and o.b = z.b)""", body="""
select l_returnflag, round(sum(pow(o - e, 2) / e), 4) as chi_square, count(*) as bins_used from c where e >= 5 group by 1"""), digits=4)
def _(spark, path):
    return inf.normal_chi_square(panels.table(spark, path, "lineitem"), "l_extendedprice", 50, ["l_returnflag"])
