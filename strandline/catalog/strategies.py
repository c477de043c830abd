"""Strategy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog.crosscorr import weekly
from strandline.catalog.registry import query
from strandline.functions.codes import CODE_ACTIONS
from strandline.catalog.sqlparts import DAILY, WEEKLY, full, q, r, rets
from strandline.frames import trailing
from strandline.operators import align as al
from strandline.operators import signals as sg
from strandline.operators import window as win
from strandline.plans.flagship import rolling_mean_verdict
from strandline.sources import panels

B = "(partition by series_id order by ts)"


def lag(x, k=1):
    return f"lag({x}, {k}) over {B}"


@query("flagship_rolling_mean_verdict", q(DAILY, rets("daily"), f"s as (select *, ret * sign({full('avg(ret)', 'ret', 5, 1)}) as strategy from rets)", f"""
e as (select series_id, ts, strategy, ret, product(1 + strategy) over {B} as w from s where strategy is not null),
d as (select *, w / max(w) over {B} - 1 as dd from e),
a as (select series_id, count(*) as periods, avg(strategy) * 252 as mean, stddev_samp(strategy) * sqrt(252) as std, product(1 + strategy) - 1 as tr, product(1 + ret) - 1 as hold, min(dd) as mdd from d group by 1)""", body=f"""
select series_id, periods, {r("mean / std", "sharpe")}, {r("tr", "strategy_return")}, {r("hold", "hold_return")}, {r("tr - hold", "excess_return")}, {r("mdd", "max_drawdown")}, tr > hold as beats_holding from a"""))
def _(spark, path):
    return rolling_mean_verdict(spark, path)


@query("J1_follow_sign", q(WEEKLY, rets("weekly"), f"m as (select *, {full('avg(ret)', 'ret', 6)} as m from rets)", body=f"select series_id, ts, {r(f'ret * sign({lag(chr(109), 2)})', 'strategy')} from m"))
def _(spark, path):
    p = win.rolling(weekly(spark, path), "ret", 6, ["mean"])
    return sg.follow_sign(p, "mean", delay=2).select("series_id", "ts", "strategy")


@query("J2_long_only", q(WEEKLY, rets("weekly"), f"m as (select *, {full('avg(ret)', 'ret', 6)} as m from rets)", body=f"select series_id, ts, {r(f'ret * case when {lag(chr(109))} >= 0 then 1 when {lag(chr(109))} < 0 then 0 end', 'strategy')} from m"))
def _(spark, path):
    p = win.rolling(weekly(spark, path), "ret", 6, ["mean"])
    return sg.follow_sign(p, "mean", long_only=True).select("series_id", "ts", "strategy")


@query("J3_two_asset_rotation", q(WEEKLY, rets("weekly"), """
p as (select a.ts, a.ret as a, b.ret as b from rets a join rets b on a.ts = b.ts and a.series_id = 'A' and b.series_id = 'N' where a.ret is not null and b.ret is not null),
d as (select *, product(1 + a) over (order by ts) - product(1 + b) over (order by ts) as d from p),
s as (select *, case when count(d) over w = 12 then sign(avg(d) over w) end as s from d window w as (order by ts rows between 12 preceding and 1 preceding))""", body=f"""
select ts, s as signal, {r("case when s > 0 then b when s <= 0 then a end", "rotation")} from s"""))
def _(spark, path):
    wide = al.wide(weekly(spark, path), ["A", "N"], "ret")
    return sg.rotate(wide, "A", "N", 12).select("ts", "signal", "rotation")


J4 = f"""
m as (select *, {full("avg(ret)", "ret", 6)} as mean from rets),
e as (select *, lag(mean) over {B} as mu1, ret - lag(mean) over {B} as e from m),
t as (select a.series_id, a.ts, any_value(a.ret) as ret, any_value(a.mean) as mean, count(b.e) as k, avg((b.e <= -a.mu1)::int) as share from e a join e b on a.series_id = b.series_id and b.rn between a.rn - 5 and a.rn group by 1, 2),
z as (select series_id, ts, ret as x, lag(mean) over {B} as m, lag(case when k = 6 then share end) over {B} as p from t)"""


@query("J4_mean_and_probability", q(WEEKLY, rets("weekly"), J4.strip(), body=f"""
select series_id, ts, {r("case when (m > 0) and (p <= 0.5) then x when m < 0 and p > 0.5 then -x else 0 end", "mean_and_prob")},
 {r("case when (m > 0) or (p <= 0.5) then x when m < 0 or p > 0.5 then -x else 0 end", "mean_or_prob")}, {r("x * sign(m)", "mean_only")} from z where m is not null and p is not null"""))
def _(spark, path):
    p = sg.mean_and_probability(weekly(spark, path), "ret", 6)
    return p.select("series_id", "ts", "mean_and_prob", "mean_or_prob", "mean_only").dropna()


J5 = f"""
u as (select *, ln(volume) - ln({full("avg(volume)", "volume", 7)}) as u, 0.031623 * (value - {lag("value")}) / pow(value, 0.75) as d from rets),
v as (select *, u / nullif(avg(abs(u)) over {B}, 0) as rho from u),
f as (select * from v where rho is not null and d is not null and ret is not null),
g as (select *, {lag("rho")} as rho1, {lag("d")} as d1 from f),
h as (select *, count(d) over w as k, avg(d) over w as md, avg(rho) over w as mr, corr(rho, d) over w as c0, corr(rho1, d) over w3 as c1 from g
  window w as (partition by series_id order by ts rows between 4 preceding and 1 preceding), w3 as (partition by series_id order by ts rows between 3 preceding and 1 preceding))"""


@query("J5_volume_price_rules", q(WEEKLY, rets("weekly"), J5.strip(), body=f"""
select series_id, ts, {r("case when sign(md) = sign(rho1) then ret else -ret end", "vs1")}, {r("case when sign(d1) = sign(mr) then -ret else ret end", "vs2")},
 {r("ret * sign(c0)", "vs3")}, {r("ret * sign(c1)", "vs4")} from h where k = 4"""))
def _(spark, path):
    p = sg.volume_price_rules(weekly(spark, path), 4).filter("vs1 is not null")
    return p.select("series_id", "ts", "vs1", "vs2", "vs3", "vs4")


TH = {"deviation": "deviation", "variance": "variance", "zero": 0.0, "tenth": 0.1}
J6 = "b as (" + " union all ".join(f"""select series_id, ts, ret, {n} as n, {full('product(1 + ret) - 1', 'ret', n, 1).replace('product(1 + ret) - 1 over', 'product(1 + ret) over')} - 1 as c, {full('var_samp(ret)', 'ret', n, 1)} as v from rets""" for n in (3, 5, 8)) + """),
t as (select b.*, threshold, case threshold when 'deviation' then sqrt(v) when 'variance' then v when 'zero' then 0.0 else 0.1 end as lim from b, (values ('deviation'), ('variance'), ('zero'), ('tenth')) x(threshold)),
s as (select *, case when v is not null then case when c - 0.5 * v * n > lim then -1.0 else 1.0 end end as signal from t)"""


@query("J6_bubble_signal", q(WEEKLY, rets("weekly"), J6, body="select series_id, ts, n, threshold, signal from s"))
def _(spark, path):
    return sg.bubble(weekly(spark, path), (3, 5, 8), TH).drop("ret")


@query("J7_average_signal", q(WEEKLY, rets("weekly"), J6, "a as (select series_id, threshold, ts, any_value(ret) as ret, case when count(signal) = 3 then avg(signal) end as av from s group by 1, 2, 3)",
    body=f"select series_id, threshold, ts, {r('av', 'average')}, {r('ret * sign(av)', 'strategy')} from a"))
def _(spark, path):
    b = sg.bubble(weekly(spark, path), (3, 5, 8), TH)
    return sg.average_signal(b, ["series_id", "threshold"]).drop("ret")


@query("J8_abc_pattern", q(WEEKLY, rets("weekly"), """
z as (select *, min(ret) over a as lo2, max(ret) over a as hi2, min(ret) over b as lo3, max(ret) over g as hi4, count(ret) over g as k from rets where ret is not null
 window a as (partition by series_id order by ts rows between 2 preceding and 1 preceding), b as (partition by series_id order by ts rows between 3 preceding and 1 preceding), g as (partition by series_id order by ts rows between 4 preceding and 1 preceding)),
s as (select *, case when k < 4 then 0 when lo2 > 0 then 1 when lo3 > 0 then -1 when hi2 < 0 and hi4 > 0 then 1 else 0 end as s from z)""",
    body=f"select series_id, ts, coalesce({lag('s')}, 0) as signal from s"))
def _(spark, path):
    return sg.abc_pattern(weekly(spark, path), 2, 3, 4).select("series_id", "ts", "signal")


@query("J9_discounted_speculation", q(WEEKLY, f"""
p as (select series_id, ts, value, volume / 10000.0 as rate from weekly),
d as (select *, value - {lag("value")} as d, rate - {lag("rate")} as dr from p),
z as (select *, {full("avg(d)", "d", 8, 1)} as mu, {full("stddev_samp(d)", "d", 8, 1)} as sd, {lag("value")} as y, {lag("dr")} as r from d)""", body="""
select series_id, ts, kappa, case when mu is not null then sign(1 / (1 + greatest(r, 0)) * (y + mu + kappa * sd - r) - y) end as signal from z, (values (-0.5::double), (0.0::double), (0.5::double)) k(kappa)"""))
def _(spark, path):
    p = panels.ship_weekly(spark, path).withColumn("rate", F.col("volume") / 10000.0)
    return sg.discounted(p, 8, [-0.5, 0.0, 0.5]).select("series_id", "ts", "kappa", "signal")


J10 = f"""
x as (select * from rets where ret is not null),
i as (select *, {full("sum(ret)", "ret", 4, 2)} as i, {lag("ret", 2)} as r2 from x),
p as (select *, {full("avg((ret < 0)::int)", "ret", 10, 1)} as t, {full("avg((ret < 0)::int)", "ret", 10, 3)} as b, {full("avg((coalesce(i, 0) < 0)::int)", "ret", 10, 2)} as ib, {lag("i", 2)} as id from i)"""


@query("J10_probability_ratio_signals", q(WEEKLY, rets("weekly"), J10.strip(), body=f"""
select series_id, ts, {r("ret * case when r2 < 0 then -1 when r2 >= 0 then 1 end", "s00")}, {r("ret * case when i < 0 then -1 when i >= 0 then 1 end", "s01")},
 {r("ret * case when t is null or b is null then null when b <> 0 then sign(1 - 2 * (t / b) * coalesce((r2 < 0)::int, 0)) when t > 0 and r2 < 0 then -1 end", "s02")},
 {r("ret * case when t is null or ib is null then null when ib <> 0 then sign(1 - 2 * (t / ib) * (coalesce(id, 0) < 0)::int) when t > 0 and id < 0 then -1 end", "s03")} from p"""))
def _(spark, path):
    p = sg.probability_ratio_signals(weekly(spark, path), 2, 4, 10)
    return p.select("series_id", "ts", "s00", "s01", "s02", "s03")


NW = (2, 3, 5, 8)
J11 = "x as (select series_id, ts, ret, sign(ret) as y from rets where ret is not null),\nf as (select *, " + ", ".join(f"sign({full('avg(y)', 'y', n)}) as f{n}" for n in NW) + " from x),\n" + \
    "g as (select *, " + ", ".join(f"1 + ret * {lag(f'f{n}')} as g{n}" for n in NW) + " from f),\n" + \
    "w as (select *, " + ", ".join(f"case when g{n} is not null then round(product(g{n}) over {B} - 1, 12) end as w{n}" for n in NW) + " from g),\n" + \
    "t as (select *, greatest(w2, w3, w5, w8) as top from w),\n" + \
    "c as (select *, case when w2 = top then 2 when w3 = top then 3 when w5 = top then 5 when w8 = top then 8 end as win from t),\n" + \
    "k as (select *, case win when 2 then f2 when 3 then f3 when 5 then f5 when 8 then f8 end as fc from c)"


@query("J11_automatic_window", q(WEEKLY, rets("weekly"), J11, body=f"select series_id, ts, win as \"window\", fc as forecast, {r(f'ret * {lag(chr(102) + chr(99))}', 'strategy')} from k"))
def _(spark, path):
    return sg.automatic_window(weekly(spark, path), NW).select("series_id", "ts", "window", "forecast", "strategy")


J12 = f"""
s as (select series_id, ts, 3 as n, ret * sign({full("avg(ret)", "ret", 3, 1)}) as st, {full("avg(ret)", "ret", 8, 1)} as ok from rets union all select series_id, ts, 5, ret * sign({full("avg(ret)", "ret", 5, 1)}), {full("avg(ret)", "ret", 8, 1)} from rets
  union all select series_id, ts, 8, ret * sign({full("avg(ret)", "ret", 8, 1)}), {full("avg(ret)", "ret", 8, 1)} from rets),
w as (select *, round(product(1 + st) over (partition by series_id, n order by ts), 12) as w from s where ok is not null),
l as (select *, row_number() over (partition by series_id, ts order by w desc, n) as k from w),
c as (select series_id, ts, n as leader, coalesce(lag(n) over {B}, n) as chosen from l where k = 1)"""


@query("J12_wealth_rotation", q(WEEKLY, rets("weekly"), J12.strip(), body=f"select c.series_id, c.ts, leader, chosen, {r('w.st', 'rotation')} from c join w on w.series_id = c.series_id and w.ts = c.ts and w.n = c.chosen"))
def _(spark, path):
    p = win.rolling_rows(weekly(spark, path), "ret", (3, 5, 8), ["mean"], ["series_id", "ts", "ret"], delay=1)
    from pyspark.sql.window import Window

    complete = F.count("mean").over(Window.partitionBy("series_id", "ts")) == 3
    p = p.withColumn("st", F.col("ret") * F.signum("mean")).withColumn("_ok", complete).filter("_ok")
    return sg.wealth_rotation(p, "n", "st")


J13 = [WEEKLY, rets("weekly"), f"""
k as (select series_id, ts, ret, value, count(ret) over w as n, avg(ret) over w as m, avg(ret * ret) over w as m2, avg(ret ** 3) over w as m3, avg(ret ** 4) over w as m4, product(1 + ret) over w - 1 as mo, stddev_samp(ret) over w as sd,
      value / max(value) over w - 1 as d from rets window w as (partition by series_id order by ts rows between 19 preceding and current row)),
f as (select *, abs(min(d) over (partition by series_id order by ts rows between 19 preceding and current row)) as dd, case when n = 20 then (m3 - 3 * m * m2 + 2 * m ** 3) / pow(m2 - m * m, 1.5) end as sk,
      case when n = 20 then (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m ** 4) / pow(m2 - m * m, 2) - 3 end as ku from k),
g as (select series_id, ts, lag(case when n = 20 then mo end) over {B} as mo, lag(case when n = 20 then sd end) over {B} as vo, lag(sk) over {B} as sk, lag(ku) over {B} as ku, lag(dd) over {B} as dd, case when n = 20 then m end as mu from f),
h as (select *, lag(mu - vo * vo) over {B} as ut from g),
c as (select * from h where mo is not null and vo is not null and sk is not null and ku is not null and ut is not null and dd is not null),
e as (select *, quantile_cont(mo, 0.5) over {B} as q0, quantile_cont(vo, 0.5) over {B} as q1, quantile_cont(sk, 0.5) over {B} as q2, quantile_cont(ku, 0.5) over {B} as q3, quantile_cont(ut, 0.5) over {B} as q4, quantile_cont(dd, 0.5) over {B} as q5 from c)"""]
J13_CODE = "1 + (mo > q0)::int + 2 * (vo > q1)::int + 4 * (sk > q2)::int + 8 * (ku > q3)::int + 16 * (ut > q4)::int + 32 * (dd < q5)::int"


@query("J13_binary_code", q(*J13, body=f"select series_id, ts, {J13_CODE} as code from e"))
def _(spark, path):
    return sg.binary_code(sg.six_attributes(weekly(spark, path))).select("series_id", "ts", "code")


ACTIONS = "t(code, action, confidence) as (values " + ", ".join(f"({k}, {a}::double, {c}::double)" for k, (a, c) in CODE_ACTIONS.items()) + ")"


@query("J13_code_strategy", q(*J13, f"coded as (select *, {J13_CODE} as code from e)", ACTIONS, body=f"""
select d.series_id, d.ts, d.code, action, confidence, {r("x.ret * sign(action)", "strategy")} from coded d join t on t.code = d.code join rets x on x.series_id = d.series_id and x.ts = d.ts"""))
def _(spark, path):
    coded = sg.binary_code(sg.six_attributes(weekly(spark, path)))
    return sg.code_strategy(coded).select("series_id", "ts", "code", "action", "confidence", "strategy")



J15W = (3, 5, 8)
J15 = "x as (select * from rets where ret is not null),\nq as (select *, " + ", ".join(
    f"{full('avg(ret)', 'ret', n, 1)} as m{n}, {full('quantile_cont(ret, 0.5)', 'ret', n, 1)} as d{n}" for n in J15W) + """ from x),
s as (select *, (row_number() over (partition by series_id order by ts) - 1) // 6 as block, """ + ", ".join(f"sign(case when d{n} = 0 then m{n} else m{n} / d{n} end) as s{n}" for n in J15W) + """ from q where m3 is not null and m5 is not null and m8 is not null),
a as (select *, """ + ", ".join(
    f"coalesce(sum((sign(ret) - s{n} = 2)::int) over b, 0) as np{n}, coalesce(sum((sign(ret) - s{n} = -2)::int) over b, 0) as nm{n}, coalesce(product(1 + abs(ret) * (sign(ret) - s{n} = 2)::int) over b, 1) as lp{n}, coalesce(product(1 + abs(ret) * (sign(ret) - s{n} = -2)::int) over b, 1) as lm{n}" for n in J15W) + """,
  row_number() over (partition by series_id order by ts) as k from s window b as (partition by series_id, block order by ts rows between unbounded preceding and 1 preceding)),
t as (select series_id, ts, block, ret, k, """ + ", ".join([
    " + ".join(f"pow(2.0, pow(2.0, -np{n}) / lp{n} + pow(2.0, -nm{n}) / lm{n}) * s{n}" for n in J15W) + " as w1",
    " + ".join(f"pow(2.0, -np{n} - nm{n}) * s{n}" for n in J15W) + " as w2",
    " + ".join(f"pow(2.0, -lp{n} - lm{n}) * s{n}" for n in J15W) + " as w3"]) + " from a)"


@query("J15_block_learning", q(WEEKLY, rets("weekly"), J15, body=f"""
select series_id, ts, block, {r("case when k > 1 then ret * sign(round(w1, 12)) end", "by_both")}, {r("case when k > 1 then ret * sign(round(w2, 12)) end", "by_errors")}, {r("case when k > 1 then ret * sign(round(w3, 12)) end", "by_losses")} from t"""))
def _(spark, path):
    return sg.block_learning(weekly(spark, path), (3, 5, 8)).select("series_id", "ts", "block", "by_both", "by_errors", "by_losses")


J20 = f"""
k as (select series_id, ts, count(ret) over w as n, product(1 + ret) over w - 1 as mo, avg(ret) over w as mu, stddev_pop(ret) over w as sd from rets where ret is not null window w as (partition by series_id order by ts rows between 9 preceding and current row)),
b as (select *, (mo > 0)::int as b0, (mu / sd > 0.1)::int as b1, (mu - 0.05 * sd > 0)::int as b2 from k where n = 10),
s as (select series_id, ts, b0::varchar || b1::varchar || b2::varchar as state, (b0 + b1 + b2) / 3.0::double as e from b),
o as (select *, sum(case when e > 0 and e < 1 then ln(e / (1 - e)) else 0 end) over (partition by series_id, state order by ts) as o from s),
p as (select *, case when e = 0 then 0.0 when e = 1 then 1.0 else 1 / (1 + exp(-o)) end as p from o),
h as (select *, case when p > 0 and p < 1 then -(p * log2(p) + (1 - p) * log2(1 - p)) else 0 end as h from p)"""


@query("J20_belief_states", q(WEEKLY, rets("weekly"), J20.strip(), body=f"""
select series_id, ts, state, {r("e", "evidence")}, {r("p", "belief")}, {r("h", "entropy")}, case when h < 0.9 then case when p > 0.5 then 'BUY' else 'SELL' end else 'HOLD' end as signal from h"""))
def _(spark, path):
    p = sg.belief_states(weekly(spark, path), 10, gamma=0.05, limits=(0.0, 0.1, 0.0))
    return p.select("series_id", "ts", "state", "evidence", "belief", "entropy", "signal")


@query("J20_proposition_evidence", """
with z as (select event_id, (value - 50) / 40 as z, volume_k from (select event_id, value, user_id % 10 as volume_k from events))
select event_id, (case when z < -1 then '0' when z > 1 then '2' else '1' end) || '_' || (case when volume_k < 2 then '0' when volume_k > 7 then '2' else '1' end) as state from z""")
def _(spark, path):
    ev = panels.table(spark, path, "events")
    state, evidence = sg.proposition_evidence({"a_value": (F.col("value"), 50.0, 40.0), "b_user": ((F.col("user_id") % 10).cast("double"), 4.5, 2.5)})
    return ev.select("event_id", state.alias("state"))


def _cdf(z):
    """The approximation that the column function uses."""
    u = f"(abs({z}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911 * {u}))"
    half = f"0.5 * (1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{u} * {u}))"
    return f"case when {z} >= 0 then 0.5 + {half} else 0.5 - {half} end"


def _given(p):
    """Conditional entropy of a feature of belief p given the state's belief."""
    parts = (f"({p} * now)", f"({p} * (1 - now))", f"({1 - p} * now)")
    return "(" + " + ".join(f"case when {v} > 0 then {v} * log2({v} / now) else 0 end" for v in parts) + ")"


WEIGHED = f"""
k as (select series_id, ts, count(ret) over w as n, product(1 + ret) over w - 1 as mo, stddev_pop(ret) over w as sd from rets where ret is not null window w as (partition by series_id order by ts rows between 9 preceding and current row)),
z as (select *, row_number() over (partition by series_id order by ts) as i, (sd - 0.14) / 0.04 as z1, (mo - 0.015) / 0.15 as z2 from k where n = 10),
s as (select series_id, ts, i, case when z1 < -0.5 then 0 when z1 > 0.5 then 2 else 1 end as a, case when z2 < -0.5 then 0 when z2 > 0.5 then 2 else 1 end as b, {_cdf("z1")} as c1, {_cdf("z2")} as c2 from z),
f as (
select series_id, 0::bigint as i, [null, null, null, null, null, null, null, null, null]::double[] as bel, 0.5::double as w1, 0.5::double as w2, null::double as ev, null::double as now from s group by 1
union all
select series_id, i, bel, case when w1 + w2 > 0 then w1 / (w1 + w2) else 0.0 end, case when w1 + w2 > 0 then w2 / (w1 + w2) else 0.0 end, ev, now from (
 select series_id, i, bel, case when h > 0 and now > 0 then greatest(0, 1 - {_given(0.4)} / h) else w1 end as w1, case when h > 0 and now > 0 then greatest(0, 1 - {_given(0.2)} / h) else w2 end as w2, ev, now from (
  select *, -list_sum(list_transform(bel, lambda p: case when p > 0 then p * log2(p) else 0.0 end)) - case when i > 1 then 0.4 * log2(0.4) + 0.2 * log2(0.2) else 0.0 end as h from (
   select series_id, i, w1, w2, ev, now, list_transform(range(1, 10), lambda j: case when j = spot then now else bel[j] end) as bel from (
    select *, was * ev / (was * ev + (1 - was) * (1 - ev)) as now from (
     select s.series_id, s.i, f.bel, w1, w2, 3 * a + b + 1 as spot, coalesce(f.bel[3 * a + b + 1], 0.5) as was, case when w1 + w2 > 0 then (w1 * c1 + w2 * c2) / (w1 + w2) else 0.5 end as ev
     from f join s on s.series_id = f.series_id and s.i = f.i + 1)))))),
o as (select s.ts, s.a, s.b, f.*, case when now > 0 and now < 1 then -(now * log2(now) + (1 - now) * log2(1 - now)) else 0 end as h from f join s using (series_id, i))"""


@query("J20_relevance_weights", q(WEEKLY, rets("weekly"), WEIGHED.strip(), body=f"""
select series_id, ts, a || '_' || b as state, {r("ev", "evidence")}, {r("now", "belief")}, {r("h", "entropy")}, {r("w1", "weight_deviation")}, {r("w2", "weight_momentum")}, case when round(h, 9) < 0.6 then case when now > 0.7 then 'BUY' else 'SELL' end else 'HOLD' end as signal from o""", recursive=True))
def _(spark, path):
    p = win.rolling(weekly(spark, path).filter("ret is not null"), "ret", 10, ["compound"]).withColumn("sd", F.when(F.col("compound").isNotNull(), F.stddev_pop("ret").over(trailing(10))))
    features = {"momentum": (F.col("compound"), 0.015, 0.15), "deviation": (F.col("sd"), 0.14, 0.04)}
    return sg.weighted_beliefs(p, features, priors={"deviation": 0.4, "momentum": 0.2}, entropy_limit=0.6)


J24 = f"""
x as (select a.series_id, a.ts, b.ret, min(b.ret) over g as lo, max(b.ret) over g as hi, count(b.ret) over g as k from rets a join rets b on a.series_id = b.series_id and b.rn between a.rn - 29 and a.rn window g as (partition by a.series_id, a.ts)),
c as (select series_id, ts, least(floor((ret - lo) * 10 / (hi - lo)), 9) as bin, count(*) as n from x where k = 30 group by 1, 2, 3),
h as (select series_id, ts, -sum(n / 30.0 * ln(n / 30.0)) as h from c group by 1, 2),
e as (select rets.*, h, round(1 - h / ln(10), 9) as i, product(1 + coalesce(ret, 0)) over {B} as w, {full("kurtosis(ret)", "ret", 30)} as ku from rets left join h using (series_id, ts)),
f as (select *, w / max(w) over {B} - 1 as dd, (i - avg(i) over {B}) / nullif(stddev_pop(i) over {B}, 0) as z from e)"""


@query("J24_anomaly_and_breaker", q(WEEKLY, rets("weekly"), J24.strip(), body=f"""
select series_id, ts, {r("h", "entropy")}, {r("i", "information")}, {r("z", "information_z")}, coalesce(abs(z) > 2, false) as anomaly, coalesce(h > 1.5 and -dd > 0.1 and ku > 0, false) as stop from f"""))
def _(spark, path):
    p = sg.anomaly_and_breaker(weekly(spark, path), 30, z=2.0, drawdown_limit=0.1, kurtosis_limit=0.0)
    return p.select("series_id", "ts", "entropy", "information", "information_z", "anomaly", "stop")


@query("J25_sized_position", """
select event_id, case when 1 / (1 + value / 40) < 0.4 then 0.0 else round(sign(value - 20) * least(1 / (1 + value / 40) * abs(value - 20) / 100 * 10, 1.0), 6) + 0.0 end as position from events""")
def _(spark, path):
    ev = panels.table(spark, path, "events")
    return ev.select("event_id", sg.sized_position((F.col("value") - 20.0) / 100.0, F.col("value") / 40.0).alias("position"))
