"""Sweeps, folds, walk-forward and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog.crosscorr import weekly
from strandline.catalog.recursions import X
from strandline.catalog.registry import query
from strandline.catalog.regressions import kin_sql
from strandline.catalog.sqlparts import SUPPLIER, WEEKLY, full, q, r, rets
from strandline.frames import ordered
from strandline.operators import evaluate as ev
from strandline.operators import signals as sg
from strandline.operators import sweep as sw
from strandline.operators import window as win
from strandline.sources import panels

B = "(partition by series_id order by ts)"
NS = list(range(2, 22))


def rule_rows(spark, path, windows=NS, delays=(1, 2)):
    return win.sign_rule_rows(weekly(spark, path), windows, delays)


def rule_sql(windows, delays):
    mx = f"({full('avg(ret)', 'ret', max(windows), max(delays))})"
    parts = " union all ".join(f"select series_id, ts, ret, {n} as n, {d} as delay, ret * sign({full('avg(ret)', 'ret', n, d)}) as strategy, {mx} is not null as ready from x" for n in windows for d in delays)
    return f"s as (select * from ({parts}) where ready)"


@query("K1_parameter_sweep", q(WEEKLY, rets("weekly"), X, rule_sql(NS, (1, 2)), """
e as (select series_id, n, delay, product(1 + strategy) - 1 as sr, product(1 + ret) - 1 as hr, count(*) as c from s group by 1, 2, 3),
k as (select *, row_number() over (partition by series_id order by round(sr - hr, 12) desc, n, delay) as rank from e)""", body=f"""
select series_id, n, delay, {r("sr", "strategy_return")}, {r("hr", "hold_return")}, c as rows, {r("sr - hr", "excess_return")}, rank from k where rank <= 5"""))
def _(spark, path):
    return sw.rank_parameters(rule_rows(spark, path), ["n", "delay"], 5)


@query("K2_start_date_sweep", q(WEEKLY, rets("weekly"), X, f"z as (select *, ret * sign({full('avg(ret)', 'ret', 6, 1)}) as strategy, lag(ts, 6) over {B} as needs from x)", """
st(start) as (values (date '1995-01-01'), (date '1996-01-01'), (date '1997-06-01'), (date '1998-06-01'))""", body=f"""
select series_id, start, {r("product(1 + strategy) - 1", "strategy_return")}, {r("product(1 + ret) - 1", "hold_return")}, count(*) as rows, {r("product(1 + strategy) - product(1 + ret)", "excess_return")} from z join st on start <= needs where strategy is not null group by 1, 2"""))
def _(spark, path):
    from strandline.frames import trailing

    p = weekly(spark, path).filter("ret is not null")
    x = F.col("ret")
    p = p.withColumn("strategy", x * F.signum(win.stat("mean", x, trailing(6, delay=1), 6))).withColumn("needs", F.lag("ts", 6).over(ordered()))
    return ev.excess_return(sw.from_starts(p, ["1995-01-01", "1996-01-01", "1997-06-01", "1998-06-01"], F.col("needs")), keys=("series_id", "start"))


@query("K3_rolling_folds", q(SUPPLIER, rets("supplier_m"), """
n as (select series_id, ts, rn - 1 as t, count(*) over (partition by series_id) as last from rets),
f as (select series_id, ts, f as fold, case when t - f * 6 < 36 then 'train' else 'test' end as part from n, generate_series(0, 40) g(f) where f * 6 <= t and t < f * 6 + 48 and f * 6 + 48 <= last)""", body="""
select series_id, fold, part, count(*) as rows, min(ts) as first, max(ts) as last from f group by 1, 2, 3"""))
def _(spark, path):
    f = sw.assign_folds(panels.supplier_monthly(spark, path), 36, 12, 6)
    return f.groupBy("series_id", "fold", "part").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))


WF = """
m as (select *, row_number() over (partition by series_id, n, delay order by ts) - 1 as t, count(*) over (partition by series_id, n, delay) as last from s),
f as (select m.*, f as fold, case when t - f * 26 < 104 then 'train' else 'test' end as part from m, generate_series(0, 20) g(f) where f * 26 <= t and t < f * 26 + 130 and f * 26 + 130 <= last),
c as (select series_id, fold, n, delay, product(1 + strategy) filter (part = 'train') - 1 as tr, product(1 + strategy) filter (part = 'test') - 1 as te from f group by 1, 2, 3, 4),
b as (select * from c qualify row_number() over (partition by series_id, fold order by round(tr, 12) desc, n, delay) = 1)"""
WN = [3, 5, 8, 13, 21]


@query("K4_walk_forward", q(WEEKLY, rets("weekly"), X, rule_sql(WN, (1, 2)), WF.strip(), body=f"select series_id, fold::int as fold, n, delay, {r('tr', 'train_score')}, {r('te', 'test_score')} from b"))
def _(spark, path):
    return sw.walk_forward(rule_rows(spark, path, WN), 104, 26, 26, ["n", "delay"])


WFS = WF.replace("product(1 + strategy) filter (part = 'train') - 1 as tr", "avg(strategy) filter (part = 'train') / nullif(stddev_pop(strategy) filter (part = 'train'), 0) as tr").replace(
    "product(1 + strategy) filter (part = 'test') - 1 as te", "avg(strategy) filter (part = 'test') / nullif(stddev_pop(strategy) filter (part = 'test'), 0) as te")


@query("K4_walk_forward_hundred", q(WEEKLY, rets("weekly"), X, rule_sql(list(range(2, 52)), (1, 2)), WFS.strip(), body=f"select series_id, fold::int as fold, n, delay, {r('tr', 'train_score')}, {r('te', 'test_score')} from b"))
def _(spark, path):
    return sw.walk_forward(rule_rows(spark, path, list(range(2, 52)), (1, 2)), 104, 26, 26, ["n", "delay"], metric="sharpe")


#: The folds' parts as episodes: j counts the rows of a part from 1.
PARTS = """
u as (select *, count(*) over (partition by {keys}) as last, row_number() over (partition by {keys} order by i) - 1 as t from {rows}),
p as (select u.*, f as fold, case when t - f * 26 < 104 then 'train' else 'test' end as part, case when t - f * 26 < 104 then t - f * 26 + 1 else t - f * 26 - 103 end as j
  from u, generate_series(0, 20) g(f) where f * 26 <= t and t < f * 26 + 130 and f * 26 + 130 <= last)"""

MACHINES = f"""
w0 as (select x.series_id, x.ts, x.i, x.value, x.ret, case when {full("avg(ret)", "ret", 6)} is null then 0 when abs({full("avg(ret)", "ret", 6)}) < 0.002 then 0 else sign({full("avg(ret)", "ret", 6)})::int end as want from x),
{PARTS.format(rows="w0", keys="series_id").strip()},
g2(stop, take) as (values (0.02::double, 0.04::double), (0.02::double, 0.1::double), (0.05::double, 0.04::double), (0.05::double, 0.1::double)),
e as (select series_id, fold, part, stop, take, 0::bigint as j, 0 as pos, 0.0::double as entry, 0.0::double as size, 10000.0::double as cap from (select distinct series_id, fold, part from p), g2
 union all
 select e.series_id, e.fold, e.part, e.stop, e.take, s.j, s.want, case when o.opened then s.value when s.want = 0 then 0 else e.entry end, case when o.opened then (e.cap + q.pnl) * 0.5 when s.want = 0 then 0 else e.size end,
  e.cap + q.pnl - o.fee
 from e join p s on s.series_id = e.series_id and s.fold = e.fold and s.part = e.part and s.j = e.j + 1,
  lateral (select case when e.pos = 1 then s.value / e.entry - 1 when e.pos = -1 then e.entry / s.value - 1 end as gain,
    coalesce((e.pos = 1 and s.value <= e.entry * (1 - e.stop)) or (e.pos = -1 and s.value >= e.entry * (1 + e.stop)), false) as lost,
    coalesce((e.pos = 1 and s.value >= e.entry * (1 + e.take)) or (e.pos = -1 and s.value <= e.entry * (1 - e.take)), false) as won) w,
  lateral (select case when e.pos = 0 then 0.0 when w.lost or w.won then e.size * w.gain else e.size * s.ret * e.pos end as pnl, case when w.lost or w.won then 0 else e.pos end as held) q,
  lateral (select (s.want <> 0 and q.held <> s.want) as opened,
    (case when w.lost or w.won then e.size * 0.0001 else 0 end + case when q.held <> 0 and s.want <> q.held then e.size * 0.0001 else 0 end + case when s.want <> 0 and q.held <> s.want then (e.cap + q.pnl) * 0.5 * 0.0001 else 0 end) as fee) o),
d as (select series_id, fold, part, stop, take, arg_max(cap, j) / 10000 - 1 as total from e group by all),
c as (select series_id, fold, stop, take, max(total) filter (part = 'train') as tr, max(total) filter (part = 'test') as te from d group by all),
b as (select * from c qualify row_number() over (partition by series_id, fold order by round(tr, 12) desc, stop, take) = 1)"""


@query("K4_positions", q(WEEKLY, rets("weekly"), X, MACHINES.strip(), body=f"select series_id, fold::int as fold, stop, take, {r('tr', 'train_score')}, {r('te', 'test_score')} from b", recursive=True))
def _(spark, path):
    p = win.rolling(weekly(spark, path), "ret", 6, ["mean"])
    p = p.withColumn("signal", F.when(F.abs("mean") < 0.002, 0.0).otherwise(F.signum("mean")))
    return sw.position_walk_forward(p, 104, 26, 26, {"stop": [0.02, 0.05], "take": [0.04, 0.1]})


def _state(n):
    mu, sd, mo = (full(e, "ret", n) for e in ("avg(ret)", "stddev_pop(ret)", "product(1 + ret)"))
    return f"select series_id, ts, i, ret, {n} as n, {mo} - 1 as mo, {mu} as mu, {sd} as sd, {full('count(ret)', 'ret', 14)} is not null as ok from x"


BELIEFS = f"""
m as ({_state(7)} union all {_state(14)}),
z as (select series_id, ts, i, ret, n, gamma, (mo > 0)::int as b0, (coalesce(mu / nullif(sd, 0), 0) > 0.05)::int as b1, (mu - gamma * sd > 0)::int as b2 from m, (values (0.25::double), (0.75::double)) v(gamma) where ok),
y as (select *, b0 || b1 || b2 as state, (b0 + b1 + b2) / 3.0::double as ev from z),
{PARTS.format(rows="y", keys="series_id, n, gamma").strip()},
h as (select p.*, prior, entropy_limit, trade_limit from p, (values (0.3::double), (0.5::double)) a(prior), (values (0.6::double), (0.95::double)) c(entropy_limit), (values (0.4::double), (0.7::double)) d(trade_limit)),
o as (select *, ln(prior / (1 - prior)) + sum(case when ev > 0 and ev < 1 then ln(ev / (1 - ev)) else 0 end) over (partition by series_id, fold, part, n, gamma, prior, entropy_limit, trade_limit, state order by j) as odds from h),
pr as (select *, case when ev <= 0 then 0.0 when ev >= 1 then 1.0 else 1 / (1 + exp(-odds)) end as bel from o),
en as (select *, case when bel > 0 and bel < 1 then -(bel * log2(bel) + (1 - bel) * log2(1 - bel)) else 0 end as ent from pr),
si as (select *, case when ent < entropy_limit then case when bel > trade_limit then 1.0 else -1.0 end end as sig from en),
st as (select *, ret * coalesce(last_value(sig ignore nulls) over (partition by series_id, fold, part, n, gamma, prior, entropy_limit, trade_limit order by j rows between unbounded preceding and 1 preceding), 0) as earned from si),
c as (select series_id, fold, n, gamma, prior, entropy_limit, trade_limit, product(1 + earned) filter (part = 'train') - 1 as tr, product(1 + earned) filter (part = 'test') - 1 as te from st group by all),
b as (select * from c qualify row_number() over (partition by series_id, fold order by round(tr, 12) desc, n, gamma, prior, entropy_limit, trade_limit) = 1)"""


@query("K4_beliefs", q(WEEKLY, rets("weekly"), X, BELIEFS.strip(), body=f"select series_id, fold::int as fold, n, gamma, prior, entropy_limit, trade_limit, {r('tr', 'train_score')}, {r('te', 'test_score')} from b"))
def _(spark, path):
    axes = {"prior": [0.3, 0.5], "entropy_limit": [0.6, 0.95], "trade_limit": [0.4, 0.7]}
    return sw.belief_walk_forward(weekly(spark, path), 104, 26, 26, [7, 14], [0.25, 0.75], axes, limits=(0.0, 0.05, 0.0))


def _stitched(rule, expr):
    return q(WEEKLY, rets("weekly"), X, rule_sql(WN, (1, 2)), WF.strip(), """
o as (select f.series_id, f.fold, f.ts, f.strategy, product(1 + f.strategy) over (partition by f.series_id, f.fold order by f.ts) as e from f join b on f.series_id = b.series_id and f.fold = b.fold and f.n = b.n and f.delay = b.delay where f.part = 'test'),
t as (select series_id, fold, product(1 + strategy) as t from o group by 1, 2),
c as (select series_id, fold, coalesce(product(t) over w, 1) as cm, coalesce(sum(t - 1) over w, 0) as ca from t window w as (partition by series_id order by fold rows between unbounded preceding and 1 preceding))""".replace("c as (select series_id, fold, coalesce", "cc as (select series_id, fold, coalesce"),
        body=f"select o.series_id, o.fold::int as fold, o.ts, {r('o.strategy', 'strategy')}, {r(expr, 'equity')} from o join cc using (series_id, fold)")


def _oos(spark, path, rule):
    rows = rule_rows(spark, path, WN)
    best = sw.walk_forward(rows, 104, 26, 26, ["n", "delay"])
    return sw.stitch(sw.out_of_sample(rows, best, 104, 26, 26, ["n", "delay"]), rule)


@query("K5_stitched_multiply", _stitched("multiply", "cm * e"))
def _(spark, path):
    return _oos(spark, path, "multiply")


@query("K5_stitched_add", _stitched("add", "ca + e"))
def _(spark, path):
    return _oos(spark, path, "add")


@query("K5_stitched_append", _stitched("append", "e"))
def _(spark, path):
    return _oos(spark, path, "append")


@query("K6_split_share_and_date", q(WEEKLY, """
n as (select series_id, ts, row_number() over (partition by series_id order by ts) as rn, count(*) over (partition by series_id) as n from weekly)""", body="""
select series_id, ts, case when rn <= floor(n * 0.7) then 'train' else 'test' end as by_share, case when ts <= date '1999-12-31' then 'train' else 'test' end as by_date from n"""))
def _(spark, path):
    p = sw.split_share(panels.ship_weekly(spark, path).select("series_id", "ts"), 0.7).withColumnRenamed("part", "by_share")
    return sw.split_date(p, "1999-12-31").withColumnRenamed("part", "by_date")


BOOT = "g as (select *, " + ", ".join(f"1 + ret * sign({full('avg(ret)', 'ret', n, 1)}) as g{n}" for n in (2, 4, 6)) + """ from x),
w as (""" + " union all ".join(f"select series_id, i, {n} as n, coalesce(product(g{n}) over (partition by series_id order by i rows between {n} following and 13 following), 1) as blk, product(g{n}) over (partition by series_id) as tot from g" for n in (2, 4, 6)) + """),
d as (select series_id, b, ('0x' || substr(md5(series_id || '|' || b || '|7'), 1, 8))::bigint % (n - 1) + 1 as i from (select series_id, count(*) as n from x group by 1), generate_series(1, 200) t(b))"""


@query("K7_block_bootstrap", q(WEEKLY, rets("weekly"), X, BOOT, body=f"""
select series_id, n, {r("avg((blk < pow(greatest(tot, 0), 1.0 / 14))::int)", "share_below")}, count(*) as replicates, {r("max(tot)", "wealth")} from d join w using (series_id, i) group by 1, 2"""))
def _(spark, path):
    return sw.block_bootstrap(weekly(spark, path), (2, 4, 6), 14, 200)


@query("K7_moving_blocks", q(WEEKLY, rets("weekly"), X, """
z as (select series_id, count(*) as n from x group by 1),
d as (select series_id, n, rep, b, ('0x' || substr(md5(series_id || '|' || rep || '|' || b || '|7'), 1, 8))::bigint % greatest(1, n - 14 + 1) as s from z, generate_series(1, 100) t(rep), lateral (select unnest(generate_series(0, ceil(n / 14.0)::bigint - 1)) as b)),
e as (select series_id, n, rep, unnest(generate_series(s + 1, s + least(14, n - b * 14))) as i from d)""", body=f"""
select series_id, rep::int as replicate, count(*) as n, {r("avg(ret)", "mean")}, {r("stddev_samp(ret)", "deviation")}, {r("product(1 + ret)", "wealth")} from e join x using (series_id, i) group by 1, 2"""))
def _(spark, path):
    return sw.moving_blocks(weekly(spark, path), 14, 100)


@query("K8_blend_sweep", q(WEEKLY, kin_sql(), f"""
m as (select series_id, ts, {full("avg(value)", "value", 30)} as mu, lead(value, 2) over {B} as y from weekly),
l as (select kf.series_id, lam, y - ((1 - lam) * f + lam * mu) as e from kf join m using (series_id, ts), (values (0.0::double), (0.1::double), (0.25::double), (0.5::double), (1.0::double)) v(lam) where mu is not null and y is not null and f is not null),
g as (select series_id, lam, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse, count(*) as n from l group by 1, 2)""", body=f"""
select series_id, lam as lambda, {r("mae", "mae")}, {r("rmse", "rmse")}, n, row_number() over (partition by series_id order by round(mae, 12), lam) as rank from g"""))
def _(spark, path):
    return sw.blend_sweep(panels.ship_weekly(spark, path), "value", 2, [0.0, 0.1, 0.25, 0.5, 1.0])


POST = "c(k, n, a, b) as (values " + ", ".join(f"({i}, {n}, {a}, {b})" for i, (n, a, b) in enumerate([(n, a, b) for n in (2, 4) for a in (1.0, 2.0) for b in (1.0, 3.0)])) + f"""),
z as (select x.*, k, c.n, a, b, case when c.n = 2 then ({full("sum((ret >= 0)::int)", "ret", 2, part="series_id, k")}) else ({full("sum((ret >= 0)::int)", "ret", 4, part="series_id, k")}) end as sm from x, c),
f as (select *, case when sm is not null then case when (sm + a) / (a + b + n) >= 0.5 then 1.0 else -1.0 end end as f from z),
p as (select *, lag(f) over (partition by series_id, k order by i) as p from f),
w as (select *, product(case when p is not null then 1 + ret end) over v / product(1 + ret * p) over v as w from p window v as (partition by series_id, k order by i)),
v as (select *, coalesce(w, 1) as v, pow(10.0, ceil(log10(greatest(abs(coalesce(w, 1)), 1e-300)))) as mag from w),
s as (select series_id, ts, i, any_value(ret) as ret, arg_min(k, (round(v / mag, 10) * mag, k)) as bk, min(round(v, 12)) as bw from v group by 1, 2, 3),
e as (select s.*, first_value(case when bw < 1 then bk end) over (partition by series_id, (i - 1) // 4 order by i) as hk from s),
g as (select e.*, c.n, c.a, c.b, coalesce(f.f, 1.0) as sig from e left join c on c.k = e.hk left join f on f.series_id = e.series_id and f.i = e.i and f.k = e.hk)"""


@query("J14_posterior_search", q(WEEKLY, rets("weekly"), X, POST, body=f"""
select series_id, ts, case when i > 4 then lag(n) over {B} end::double as n, case when i > 4 then lag(a) over {B} end::double as alpha, case when i > 4 then lag(b) over {B} end::double as beta, {r(f"case when i > 4 then ret * lag(sig) over {B} end", "strategy")} from g"""))
def _(spark, path):
    p = sw.posterior_search(weekly(spark, path), (2, 4), (1.0, 2.0), (1.0, 3.0), refit_every=4)
    return p.select("series_id", "ts", "n", "alpha", "beta", "strategy")
