"""Recursive strategies: queries with recursive-SQL oracles where SQL can state the recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog.crosscorr import weekly
from strandline.catalog.registry import query
from strandline.catalog.sqlparts import WEEKLY, full, q, r, rets
from strandline.frames import explode_rows, ordered
from strandline.operators import recursive as rc
from strandline.operators import signals as sg
from strandline.operators import window as win
from strandline.operators.sweep import grid

B = "(partition by series_id order by ts)"
X = "x as (select series_id, ts, ret, value, row_number() over (partition by series_id order by ts) as i from rets where ret is not null)"


@query("E10_ewma", q(WEEKLY, rets("weekly"), X, """
e as (select series_id, ts, i, ret as s from x where i = 1 union all select x.series_id, x.ts, x.i, 0.4 * x.ret + 0.6 * e.s from e join x on x.series_id = e.series_id and x.i = e.i + 1)""",
    body=f"select series_id, ts, {r('s', 'ewma')} from e", recursive=True))
def _(spark, path):
    return rc.ewma(weekly(spark, path).dropna(subset=["ret"]), "ret", 4.0)


def _corrected(m, total, hits, hit_sum, last):
    """Mean of m values plus the correction by their slope on the hits, as SQL."""
    v, c = f"({hits} * (1 - {hits} / {m}))", f"({hit_sum} - {hits} / {m} * {total})"
    return f"case when w.k <= 38 or {v} <= 0 or {c} = 0 then {total} / {m} else {total} / {m} + pow(case when {c} > 0 then e.gamma else 1 / e.gamma end, ln(w.k)) * 2 * abs({c}) / {v} * ({last} - {hits} / {m}) end"


ADAPT = f"""
w as (select series_id, ts, i, ret, i - 1 as k, sum(ret) over (partition by series_id order by i rows between 36 preceding and 1 preceding) as sr, sum(ret) over (partition by series_id order by i rows between unbounded preceding and 1 preceding) as se,
  list(ret) over (partition by series_id order by i rows between 36 preceding and 1 preceding) as xs from x),
e as (select series_id, gamma::double as gamma, ts, i, list_transform(range(36), lambda z: 0.0::double) as h, 0.0::double as cnt, 0.0::double as hs, 0.0::double as last, 0.0::double as mr, 0.0::double as fr, 0.0::double as me, 0.0::double as fe
   from w, (values (0.5), (0.9)) g(gamma) where i = 36
  union all select series_id, gamma, ts, i, list_append(h[2:], (ret - fr > 0)::int::double), cnt + (ret - fe > 0)::int, hs + (ret - fe > 0)::int * ret, (ret - fe > 0)::int::double, sr / 36, fr, se / k, fe
   from (select w.*, e.gamma, e.h, e.cnt, e.hs, {_corrected("36", "w.sr", "list_sum(e.h)", "list_inner_product(w.xs, e.h)", "e.h[36]")} as fr, {_corrected("w.k", "w.se", "e.cnt", "e.hs", "e.last")} as fe
     from e join w on w.series_id = e.series_id and w.i = e.i + 1))"""


@query("H21_adaptive_mean", q(WEEKLY, rets("weekly"), X, ADAPT.strip(), body=f"select series_id, gamma, ts, {r('mr', 'mean_rolling')}, {r('fr', 'adaptive_rolling')}, {r('me', 'mean_expanding')}, {r('fe', 'adaptive_expanding')} from e where i > 36", recursive=True))
def _(spark, path):
    p = explode_rows(weekly(spark, path).select("series_id", "ts", "ret"), grid(gamma=[0.5, 0.9]))
    return rc.adaptive_mean(p, "ret", 36)


@query("I4_neighbour_signal", q(WEEKLY, rets("weekly"), X, """
c as (select series_id, i, sum(ret) over (partition by series_id order by i) as s from x),
p as (select o.series_id, o.i as n, avg((o.s - coalesce(b.s, 0)) / (o.i - a.i + 1)) as f from c o join x a on a.series_id = o.series_id and a.i < o.i left join c b on b.series_id = a.series_id and b.i = a.i - 1 where o.i >= 3 group by 1, 2)""",
    body=f"select x.series_id, x.ts, {r('f', 'forecast')}, {r('ret * sign(f)', 'strategy')} from x join p on p.series_id = x.series_id and p.n = x.i - 1"))
def _(spark, path):
    return rc.neighbour_signal(weekly(spark, path), "ret")


BIAS = f"""
f as (select *, sign({full("avg(ret)", "ret", 5, 1)}) as xf from x),
g as (select *, row_number() over (partition by series_id order by i) - 1 as j from f where xf is not null),
h as (select *, avg(ret - xf) over (partition by series_id order by j rows between unbounded preceding and 1 preceding) as mex from g),
e as (select series_id, ts, j, ret, xf, xf as yf, 0.0::double as e0, 0.0::double as e1, 0.0::double as e2 from h where j = 0
  union all select h.series_id, h.ts, h.j, h.ret, h.xf, sign(h.xf - case when h.j <= 3 then h.mex else (e.e0 + e.e1 + e.e2) / 3 end),
   h.ret - sign(h.xf - case when h.j <= 3 then h.mex else (e.e0 + e.e1 + e.e2) / 3 end), e.e0, e.e1 from e join h on h.series_id = e.series_id and h.j = e.j + 1)"""


@query("J16_bias_learning", q(WEEKLY, rets("weekly"), X, BIAS.strip(), body=f"select series_id, ts, xf as plain, yf as learned, {r('ret * xf', 'strategy_plain')}, {r('ret * yf', 'strategy')} from e", recursive=True))
def _(spark, path):
    return rc.bias_learning(weekly(spark, path), "ret", 5, 3)


PROB = """
u as (select *, (ret > 0)::int::double as up, lead(ret) over (partition by series_id order by i) as nr, lead(ts) over (partition by series_id order by i) as nts from x),
v as (select *, case when i > 8 then avg(up) over (partition by series_id order by i rows between 8 preceding and 1 preceding) end as share, lag(up) over (partition by series_id order by i) as prev from u),
e as (select series_id, i, share as p0, 0.0::double as p1, share from v where i = 8
  union all select v.series_id, v.i, z.p1, z.p1, v.share from e join v on v.series_id = e.series_id and v.i = e.i + 1,
   lateral (select coalesce(e.p0, v.share) as p) pp,
   lateral (select case when p > 0 and p < 1 then p + 0.5 * (p + case when v.prev > 0 then -0.5 else 0.5 end) * (1 / (p - 1) + 1 / p) * (v.up - p - 0.5) else v.share end as raw) rr,
   lateral (select case when raw >= 0 and raw <= 1 then raw else v.share end as p1) z)"""


@query("J17_probability_updating", q(WEEKLY, rets("weekly"), X, PROB.strip(), body=f"""
select e.series_id, v.nts as ts, {r("e.share", "benchmark")}, {r("e.p1", "probability")}, {r("nr * case when e.share >= 0.45 then 1 else -1 end", "bench")}, {r("nr * case when e.p1 >= 0.45 then 1 else -1 end", "sp1")},
 {r("nr * case when e.p1 >= e.share then 1 else -1 end", "sp2")}, {r("nr * (case when e.share >= 0.45 and e.p1 > 0.45 then 1 else 0 end - case when e.share <= 0.45 or e.p1 < 0.45 then 1 else 0 end)", "sp3")}
from e join v on v.series_id = e.series_id and v.i = e.i where e.i > 8 and nts is not null""", recursive=True))
def _(spark, path):
    return rc.probability_updating(weekly(spark, path), "ret", 8, 0.45)


def _means_and_losses(n):
    """Expanding and n-row means and loss shares of the rows before, as SQL."""
    past, recent = "(partition by series_id order by i rows between unbounded preceding and 1 preceding)", f"(partition by series_id order by i rows between {n} preceding and 1 preceding)"
    return f"""select series_id, {n} as n, ts, i, ret, i - 1 as k, (lag(ret) over (partition by series_id order by i) <= 0)::int::double as loss,
  sum(ret) over {past} as me, sum(ret) over {recent} as mr, (sum((ret <= 0)::int) over {past})::double / (i - 1) as pe, (sum((ret <= 0)::int) over {recent})::double / {n} as pr from x"""


LEARNED = f"""
v as ({" union all ".join(f"select * from ({_means_and_losses(n)}) where i >= {n}" for n in (5, 10, 20))}),
s as (select series_id, n, i, k, loss, 'e' as kind, pe as share from v union all select series_id, n, i, k, loss, 'r', pr from v),
l as (select series_id, n, kind, i, 0.5::double as adt, 0.5::double as std, 0.1::double as gamma, null::double as last, 0.0::double as a, 0.0::double as b, 0.0::double as c from s where i = n
  union all select s.series_id, s.n, s.kind, s.i, z.adt, s.share + g.gamma * m.es, g.gamma, m.es, m.a, m.b, m.c
   from l join s on s.series_id = l.series_id and s.n = l.n and s.kind = l.kind and s.i = l.i + 1,
   lateral (select s.loss - l.adt as er) r,
   lateral (select case when s.share + r.er * r.er > 0 then r.er * r.er / (s.share + r.er * r.er) else 1 end as alpha) p,
   lateral (select p.alpha * p.alpha / (2 * p.alpha * p.alpha - 2 * p.alpha + 1) as alpha2) w,
   lateral (select w.alpha2 * s.share + (1 - w.alpha2) * r.er * r.er as adt) z,
   lateral (select s.loss - l.std as es, l.a + coalesce((s.loss - l.std) * l.last, 0) as a, l.b + coalesce((s.loss - s.share) * l.last, 0) as b, l.c + coalesce(l.last * l.last, 0) as c) m,
   lateral (select case when s.k > 10 then (m.a - m.b) / case when m.c <> 0 then m.c else s.k - 1 end else l.gamma end as gamma) g),
j as (select v.*, e.adt as ea, e.std as es, r.adt as ra, r.std as rs from v join l e on e.series_id = v.series_id and e.n = v.n and e.i = v.i and e.kind = 'e' join l r on r.series_id = v.series_id and r.n = v.n and r.i = v.i and r.kind = 'r' where v.i > v.n)"""
SIGNS = ", ".join(
    [r("ret * sign(me)", "me"), r("ret * sign(mr)", "mr")]
    + [r(f"ret * sign({by}(1 - 2 * {p}))", f"{side}_{name}{tail}") for name, pair in (("avg", ("pe", "pr")), ("adt", ("ea", "ra")), ("std", ("es", "rs")))
       for side, m, p in (("pe", "me", pair[0]), ("pr", "mr", pair[1])) for tail, by in (("", ""), ("_b", f"{m} * "))]
)


@query("J18_adaptive_probability", q(WEEKLY, rets("weekly"), X, LEARNED.strip(), body=f"select series_id, n, ts, {SIGNS} from j", recursive=True))
def _(spark, path):
    p = explode_rows(weekly(spark, path).select("series_id", "ts", "ret"), grid(n=[5, 10, 20]))
    return rc.adaptive_probability(p, "ret")


SWITCH = """
g(n, delay) as (values (3, 0), (3, 1), (6, 0), (6, 1)),
y as (select x.series_id, n, delay, x.ts, x.i, x.ret, row_number() over (partition by x.series_id, n, delay order by x.i) - n - delay as j,
  case when delay = 0 and n = 3 then sum(ret) over (partition by x.series_id, n, delay order by x.i rows between 3 preceding and 1 preceding)
       when delay = 1 and n = 3 then sum(ret) over (partition by x.series_id, n, delay order by x.i rows between 4 preceding and 2 preceding)
       when delay = 0 then sum(ret) over (partition by x.series_id, n, delay order by x.i rows between 6 preceding and 1 preceding)
       else sum(ret) over (partition by x.series_id, n, delay order by x.i rows between 7 preceding and 2 preceding) end as m from x, g),
e as (select series_id, n, delay, ts, j, 0.0::double as trade, ret, 1 as side, 0.0::double as h1, 0.0::double as s1, 0.0::double as h2, 0.0::double as s2 from y where j = 0
  union all select y.series_id, y.n, y.delay, y.ts, y.j, t.trade, y.ret,
   case when (hold > own and t.trade > 0) or (hold < own and t.trade < 0) then -e.side else e.side end, y.ret, y.ret * t.trade, e.h1, e.s1
   from e join y on y.series_id = e.series_id and y.n = e.n and y.delay = e.delay and y.j = e.j + 1,
   lateral (select e.side * case when y.m > 0 then 1.0::double else -1.0::double end as trade) t, lateral (select (1 + e.h2) * (1 + e.h1) as hold, (1 + e.s2) * (1 + e.s1) as own) w)"""


@query("J19_switching", q(WEEKLY, rets("weekly"), X, SWITCH.strip(), body=f"select series_id, n, delay, ts, trade, {r('ret * trade', 'strategy')} from e where j > 0", recursive=True))
def _(spark, path):
    p = explode_rows(weekly(spark, path).select("series_id", "ts", "ret"), grid(n=[3, 6], delay=[0, 1]))
    return rc.switching(p, "ret")


@query("J20_risk_position")
def _(spark, path):
    p = sg.belief_states(weekly(spark, path), 10, gamma=0.05, limits=(0.0, 0.1, 0.0))
    w = ordered()
    p = p.withColumn("s", F.lag("signal").over(w)).withColumn("h", F.lag("entropy").over(w))
    return rc.risk_position(p, "ret", "s", "h")


def _signals(spark, path):
    p = win.rolling(weekly(spark, path), "ret", 6, ["mean"])
    return p.withColumn("signal", F.when(F.abs("mean") < 0.002, 0.0).otherwise(F.signum("mean"))).dropna(subset=["ret"])


MACHINE = f"""
s as (select x.series_id, x.ts, x.i, x.value, x.ret, case when {full("avg(ret)", "ret", 6)} is null then 0 when abs({full("avg(ret)", "ret", 6)}) < 0.002 then 0 else sign({full("avg(ret)", "ret", 6)})::int end as want from x),
g(stop, take) as (values (0.02::double, 0.04::double), (0.02::double, 0.1::double), (0.05::double, 0.04::double), (0.05::double, 0.1::double)),
e as (select series_id, stop, take, i0 as i, null::date as ts, 0 as pos, 0.0::double as entry, 0.0::double as size, 10000.0::double as cap, '' as action, 0.0::double as pnl, 0.0::double as fee from (select distinct series_id, 0::bigint as i0 from s), g
 union all
 select e.series_id, e.stop, e.take, s.i, s.ts, o.npos, case when o.opened then s.value when o.npos = 0 then 0 else e.entry end, case when o.opened then (e.cap + p.pnl) * 0.5 when o.npos = 0 then 0 else e.size end,
  e.cap + p.pnl - o.fee, o.action, p.pnl, o.fee
 from e join s on s.series_id = e.series_id and s.i = e.i + 1,
  lateral (select case when e.pos = 1 then s.value / e.entry - 1 when e.pos = -1 then e.entry / s.value - 1 end as gain,
    coalesce((e.pos = 1 and s.value <= e.entry * (1 - e.stop)) or (e.pos = -1 and s.value >= e.entry * (1 + e.stop)), false) as lost,
    coalesce((e.pos = 1 and s.value >= e.entry * (1 + e.take)) or (e.pos = -1 and s.value <= e.entry * (1 - e.take)), false) as won) w,
  lateral (select case when e.pos = 0 then 0.0 when w.lost or w.won then e.size * w.gain else e.size * s.ret * e.pos end as pnl, case when w.lost or w.won then 0 else e.pos end as held) p,
  lateral (select (s.want <> 0 and p.held <> s.want) as opened, s.want as npos,
    case when p.held = 0 and s.want = 1 then 'BUY' when p.held = 0 and s.want = -1 then 'SELL' when p.held <> 0 and s.want = 0 then 'FLAT' when p.held <> 0 and s.want <> p.held then 'REVERSE'
         when w.lost then 'STOP_LOSS_' || case when e.pos = 1 then 'LONG' else 'SHORT' end when w.won then 'TAKE_PROFIT_' || case when e.pos = 1 then 'LONG' else 'SHORT' end else 'HOLD' end as action,
    (case when w.lost or w.won then e.size * 0.0001 else 0 end + case when p.held <> 0 and s.want <> p.held then e.size * 0.0001 else 0 end + case when s.want <> 0 and p.held <> s.want then (e.cap + p.pnl) * 0.5 * 0.0001 else 0 end) as fee) o)"""


@query("J21_position_machine", q(WEEKLY, rets("weekly"), X, MACHINE.strip(), body=f"select series_id, stop, take, ts, pos as position, action, {r('pnl', 'pnl')}, {r('fee', 'cost')}, {r('cap', 'capital')} from e where i > 0", recursive=True))
def _(spark, path):
    p = explode_rows(_signals(spark, path).select("series_id", "ts", "value", "ret", "signal"), grid(stop=[0.02, 0.05], take=[0.04, 0.1]))
    return rc.position_machine(p, "value", "ret", "signal", keys=("series_id", "stop", "take"))


LEDGER = f"""
s as (select x.*, {full("avg(ret)", "ret", 6)} as m from x),
o as (select *, case when m > 0.002 then 'BUY' when m < -0.002 then 'SELL' end as act from s),
e as (select series_id, ts, i, value, 0.0::double as traded, 0.0::double as fee, 10000.0::double as cash, 0.0::double as shares from o where i = 1
  union all select o.series_id, o.ts, o.i, o.value,
   case when o.act = 'BUY' and e.cash > 0 then e.cash * 0.5 / o.value when o.act = 'SELL' and e.shares > 0 then -e.shares * 0.5 else 0 end,
   case when o.act = 'BUY' and e.cash > 0 then e.cash * 0.5 * 0.001 when o.act = 'SELL' and e.shares > 0 then e.shares * 0.5 * o.value * 0.001 else 0 end,
   case when o.act = 'BUY' and e.cash > 0 then e.cash - (e.cash * 0.5 + e.cash * 0.5 * 0.001) when o.act = 'SELL' and e.shares > 0 then e.cash + (e.shares * 0.5 * o.value - e.shares * 0.5 * o.value * 0.001) else e.cash end,
   case when o.act = 'BUY' and e.cash > 0 then e.shares + e.cash * 0.5 / o.value when o.act = 'SELL' and e.shares > 0 then e.shares - e.shares * 0.5 else e.shares end
  from e join o on o.series_id = e.series_id and o.i = e.i + 1)"""


@query("J22_cash_share_ledger", q(WEEKLY, rets("weekly"), X, LEDGER.strip(), body=f"""
select series_id, ts, {r("traded", "traded")}, {r("fee", "fee")}, {r("cash", "cash")}, {r("shares", "shares")}, {r("cash + shares * value", "wealth")} from e""", recursive=True))
def _(spark, path):
    p = _signals(spark, path)
    p = p.withColumn("act", F.when(F.col("mean") > 0.002, "BUY").when(F.col("mean") < -0.002, "SELL")).withColumn("amount", F.lit(0.5))
    return rc.ledger(p, "value", "act", "amount")


CAPITAL = """
p as (select series_id, ts, ret, coalesce(fast, 0) as fast, coalesce(slow, 0) as slow, row_number() over (partition by series_id order by ts) as i from
  (select *, {fast} as fast, {slow} as slow from rets) where ret is not null),
e as (select series_id, ts, i, fast, slow, 1000.0::double as k, 0.0::double as added, 0.0::double as taken, [1000.0::double] as wealth from p where i = 1
  union all select p.series_id, p.ts, p.i, p.fast, p.slow, z.k, z.added, t.taken, list_append(e.wealth[-4:], z.k)
   from e join p on p.series_id = e.series_id and p.i = e.i + 1,
   lateral (select case when len(e.wealth) > 4 and e.wealth[-1] / e.wealth[-4] - 1 >= 0.06 and e.k > 0 then 0.25 * e.k else 0.0 end as taken) t,
   lateral (select case when (e.fast < -0.03 or e.slow < -0.1) and e.k - t.taken > 1000 then 0.5 * (e.k - t.taken - 1000) else 0.0 end as added,
     case when (e.fast < -0.03 or e.slow < -0.1) and e.k - t.taken > 1000 then (e.k - t.taken + 0.5 * (e.k - t.taken - 1000)) * (1 + p.ret)
          when not (e.fast < -0.03 or e.slow < -0.1) and e.fast > 0.03 and e.slow > 0.1 and e.k - t.taken > 1000 then (e.k - t.taken) * (1 - 0.5 * p.ret)
          else (e.k - t.taken) * (1 + p.ret) end as k) z)""".replace("{fast}", full("product(1 + ret)", "ret", 4) + " - 1").replace("{slow}", full("product(1 + ret)", "ret", 12) + " - 1")


@query("J22_capital_rule", q(WEEKLY, rets("weekly"), CAPITAL.strip(), body=f"select series_id, ts, {r('k', 'capital')}, {r('added', 'added')}, {r('taken', 'taken')} from e", recursive=True))
def _(spark, path):
    p = weekly(spark, path)
    p = win.momentum(win.momentum(p, 4).withColumnRenamed("momentum", "fast"), 12).withColumnRenamed("momentum", "slow")
    return rc.capital_rule(p, "ret", "fast", "slow")


@query("J23_online_kernel")
def _(spark, path):
    return rc.online_kernel(weekly(spark, path), "ret")


COMBINE = f"""
f as (select *, lag(ret) over (partition by series_id order by i) as f1, {full("avg(ret)", "ret", 6, 1, order="i")} as f2 from x),
a as (select *, avg(pow(ret - f1, 2)) over w as a1, avg(pow(ret - f2, 2)) over w as a2, avg(pow(ret, 2)) over w as a3 from f window w as (partition by series_id order by i rows between 19 preceding and current row)),
m as (select *, list_avg(list_filter([a1, a2, a3], lambda z: z is not null)) as am from a),
g as (select *, 1 / (1 + coalesce(a1, am) / (am + 1e-10)) as g1, 1 / (1 + coalesce(a2, am) / (am + 1e-10)) as g2, 1 / (1 + a3 / (am + 1e-10)) as g3 from m),
e as (select distinct series_id, null::date as ts, 0::bigint as i, 1 / 3::double as w1, 1 / 3::double as w2, 1 / 3::double as w3, []::double[] as own, 0.0::double as combined, 0.0::double as u1, 0.0::double as u2, 0.0::double as u3 from x
  union all select g.series_id, g.ts, g.i, case when n.s > 0 then least(greatest(n.n1 / n.s, 0), 1) else 1 / 3 end, case when n.s > 0 then least(greatest(n.n2 / n.s, 0), 1) else 1 / 3 end, case when n.s > 0 then least(greatest(n.n3 / n.s, 0), 1) else 1 / 3 end, o.own, c.combined, e.w1, e.w2, e.w3
   from e join g on g.series_id = e.series_id and g.i = e.i + 1,
   lateral (select case when f1 is null then 0 else e.w1 end + case when f2 is null then 0 else e.w2 end + e.w3 as total) t,
   lateral (select case when t.total > 0 then (coalesce(e.w1 * f1, 0) + coalesce(e.w2 * f2, 0)) / t.total else (coalesce(f1, 0) + coalesce(f2, 0)) / (1 + (f1 is not null)::int + (f2 is not null)::int) end as combined) c,
   lateral (select list_append(e.own[-19:], pow(ret - c.combined, 2)) as own) o,
   lateral (select case when len(o.own) >= 2 then 5 * (1 - exp(-list_avg(o.own))) else 0 end as step) p,
   lateral (select e.w1 + p.step * (g1 - (g1 + g2 + g3) / 3) as n1, e.w2 + p.step * (g2 - (g1 + g2 + g3) / 3) as n2, e.w3 + p.step * (g3 - (g1 + g2 + g3) / 3) as n3, e.w1 + e.w2 + e.w3 as s) n)"""


@query("L3_adaptive_weights", q(WEEKLY, rets("weekly"), X, COMBINE.strip(), body=f"select series_id, ts, {r('combined', 'combined')}, {r('u1', 'w0')}, {r('u2', 'w1')}, {r('u3', 'w2')} from e where i > 0", recursive=True))
def _(spark, path):
    from strandline.frames import trailing

    x = F.col("ret")
    p = weekly(spark, path).select("series_id", "ts", "ret", F.array(F.lag(x).over(ordered()), win.stat("mean", x, trailing(6, delay=1), 6), F.lit(0.0)).alias("f"))
    w = rc.adaptive_weights(p, "ret", "f", 3, rate=5.0)
    return w.select("series_id", "ts", "combined", *[F.col("weights")[i].alias(f"w{i}") for i in range(3)])
