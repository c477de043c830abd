"""Nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog.crosscorr import weekly
from strandline.catalog.registry import query
from strandline.catalog.sqlparts import WEEKLY, q, r, rets
from strandline.operators import analog as an
from strandline.sources import panels

X = "x as (select series_id, ts, ret as x, row_number() over (partition by series_id order by ts) - 1 as idx, count(*) over (partition by series_id) as n from rets where ret is not null)"


def pat(k, sign=False):
    v = "sign(greatest(x, 0))" if sign else "x"
    cols = ", ".join(f"lag({v}, {k - 1 - i}) over (partition by series_id order by idx) as p{i}" for i in range(k))
    return f"p as (select * from (select x.*, {cols} from x) where p0 is not null)"


LAST = "l as (select p.*, count(*) over (partition by series_id) - 1 as m from p qualify idx = max(idx) over (partition by series_id))"


def dist(k, p):
    if p == 1:
        return " + ".join(f"abs(p.p{i} - l.p{i})" for i in range(k))
    return f"pow({' + '.join(f'pow(abs(p.p{i} - l.p{i}), {p})' for i in range(k))}, 1.0 / {p})"


NN = ["nn as (select p.series_id, p.ts, p.x, p.idx, p.n, " + dist(4, 2) + " as score, row_number() over (partition by p.series_id order by " + dist(4, 2) + ", p.ts) as rank, l.m from p join l on p.series_id = l.series_id and p.idx < l.idx)",
      "kk as (select * from nn where rank <= floor(m * 0.1))"]


def neighbours(spark, path):
    p = an.patterns_with_index(weekly(spark, path), "ret", 4)
    return p, an.nearest_patterns(p, "pattern", 2.0, share=0.1)


@query("I1_nearest_patterns", q(WEEKLY, rets("weekly"), X, pat(4), LAST, *NN, body=f"select series_id, ts, rank, {r('score', 'score')} from kk"))
def _(spark, path):
    return neighbours(spark, path)[1].select("series_id", "ts", "rank", "score")


@query("I1_nearest_vectors", """
with e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
l as (select label, max(vec_id) as q from embeddings group by 1),
d as (select a.label, a.vec_id, sqrt(sum(pow(abs(a.x - b.x), 2))) as score from e a join l on a.label = l.label and a.vec_id < l.q join e b on b.vec_id = l.q and b.i = a.i group by 1, 2)
select label, vec_id, rank, round(score, 6) as score from (select *, row_number() over (partition by label order by score, vec_id) as rank from d) where rank <= 10""")
def _(spark, path):
    v = panels.vectors(spark, path)
    return an.nearest_patterns(v, "x", 2.0, k=10, keys=("label",), order="vec_id").select("label", "vec_id", "rank", "score")


@query("I2_matching_patterns", q(WEEKLY, rets("weekly"), X, pat(5, True), LAST, """
nn as (select p.series_id, p.ts, (p.p0 * l.p0 + p.p1 * l.p1 + p.p2 * l.p2 + p.p3 * l.p3 + p.p4 * l.p4)::double as score from p join l on p.series_id = l.series_id and p.idx < l.idx),
w as (select *, count(*) over (partition by series_id) as c, row_number() over (partition by series_id order by score desc, ts) as rank from nn where score >= 1)""",
    body="select series_id, ts, rank, score from w where rank <= floor(c * 0.2) + 1"))
def _(spark, path):
    p = weekly(spark, path).withColumn("up", F.when(F.col("ret").isNotNull(), F.signum(F.greatest(F.col("ret"), F.lit(0.0)))))
    p = an.patterns_with_index(p, "up", 5)
    return an.nearest_patterns(p, "pattern", -1, share=0.2).select("series_id", "ts", "rank", "score")


@query("I3_neighbour_mean", q(WEEKLY, rets("weekly"), X, pat(4), LAST, *NN, body=f"select series_id, {r('avg(x)', 'forecast')}, count(*) as neighbours from kk group by 1"))
def _(spark, path):
    p, nn = neighbours(spark, path)
    return an.neighbour_forecast(p, nn, "ret")


def span(lo, hi):
    return q(WEEKLY, rets("weekly"), X, pat(4), LAST, *NN, f"""
f as (select k.series_id, k.idx, avg(x.x) as f from kk k left join x on x.series_id = k.series_id and x.idx >= {lo} and x.idx < {hi} group by 1, 2)""",
             body=f"select series_id, {r('avg(f)', 'forecast')}, count(*) as neighbours from f group by 1")


def _span(spark, path, how):
    p, nn = neighbours(spark, path)
    full = weekly(spark, path).filter("ret is not null")
    from strandline.frames import ordered

    full = full.withColumn("idx", F.row_number().over(ordered()) - 1)
    return an.neighbour_forecast(full, nn, "ret", 0.05, how)


@query("I3_span_center", span("k.idx - floor(k.n * 0.05)", "k.idx + floor(k.n * 0.05)"))
def _(spark, path):
    return _span(spark, path, "center")


@query("I3_span_forward", span("k.idx", "k.idx + floor(k.n * 0.05)"))
def _(spark, path):
    return _span(spark, path, "forward")


@query("I3_span_backward", span("k.idx - floor(k.n * 0.05)", "k.idx"))
def _(spark, path):
    return _span(spark, path, "backward")


@query("I3_local_regression", q(WEEKLY, rets("weekly"), X, pat(4), LAST, *NN, """
z as (select series_id, idx, x, lead(x) over (partition by series_id order by idx) as nx, last_value(x) over (partition by series_id order by idx rows between unbounded preceding and unbounded following) as lx from x),
g as (select k.series_id, k.idx, any_value(z.lx) as lx, least(k.idx + floor(k.n * 0.05), k.n) as hi, regr_slope(case when z.idx < least(k.idx + floor(k.n * 0.05), k.n) - 1 then nx end, z.x) as b,
  regr_intercept(case when z.idx < least(k.idx + floor(k.n * 0.05), k.n) - 1 then nx end, z.x) as a, avg(z.x) as m, count(*) as c
  from kk k join z on z.series_id = k.series_id and z.idx >= k.idx and z.idx < least(k.idx + floor(k.n * 0.05), k.n) group by k.series_id, k.idx, k.n)""",
    body=f"select series_id, {r('avg(case when c > 3 then a + b * lx else m end)', 'forecast')}, count(*) as neighbours from g group by 1"))
def _(spark, path):
    return _span(spark, path, "regress")


PEAK = """
b as (select *, row_number() over (partition by series_id order by idx desc) as back from x),
v as (select a.series_id, a.ts, a.idx, a.back, list(c.x order by c.idx) filter (c.idx < a.idx + 4) as pat, list(c.x order by c.idx) filter (c.idx >= a.idx + 4) as path from b a join b c on c.series_id = a.series_id and c.idx between a.idx and a.idx + 9 group by all),
l as (select series_id, pat as q from v where back = 4),
c as (select v.series_id, v.ts, path, sqrt(pow(pat[1] - q[1], 2) + pow(pat[2] - q[2], 2) + pow(pat[3] - q[3], 2) + pow(pat[4] - q[4], 2)) as d from v join l using (series_id)
      where len(path) = 6 and back >= 8 and pat[1] > pat[2] and pat[1] > pat[3] and pat[1] > pat[4]),
t as (select *, row_number() over (partition by series_id order by d, ts) as k from c),
s as (select series_id, unnest(path) as x, generate_subscripts(path, 1) as step from t where k <= 5)"""


@query("I5_peak_path", q(WEEKLY, rets("weekly"), X, PEAK.strip(), body=f"""
select series_id, step::int as step, {r("avg(x)", "mean")}, {r("avg(x) - 2 * stddev_samp(x) / sqrt(count(*))", "lower")}, {r("avg(x) + 2 * stddev_samp(x) / sqrt(count(*))", "upper")}, count(*) as paths from s group by 1, 2"""))
def _(spark, path):
    return an.peak_path(weekly(spark, path), "ret", 4, 6, 5)


VAL = """
e as (select series_id, max(idx) as e, arg_max(x, idx) as v from x group by 1),
c as (select x.series_id, x.idx, row_number() over (partition by x.series_id order by abs(x.x - e.v), x.ts) as k, e.e from x join e on e.series_id = x.series_id and x.idx < e.e),
s as (select c.series_id, c.idx, c.k, f.idx - c.idx as step, f.x, c.e from c join x f on f.series_id = c.series_id and f.idx between c.idx + 1 and c.idx + 8 where c.k <= 8)"""


@query("I6_value_path", q(WEEKLY, rets("weekly"), X, VAL.strip(), body=f"""
select series_id, step::int as step, {r("avg(x)", "mean")}, {r("avg(x) - 2 * stddev_samp(x) / sqrt(8)", "lower")}, {r("avg(x) + 2 * stddev_samp(x) / sqrt(8)", "upper")}, count(*) as paths from s where idx + 8 <= e group by 1, 2"""))
def _(spark, path):
    return an.value_path(weekly(spark, path), "ret", 8, 8)


@query("I7_complexity_path", q(WEEKLY, rets("weekly"), X, VAL.strip(), "w as (select s.*, pow(2.0, -case when k = 1 then 0 when k < 8 then 1 else 2 end) as w from s)", body=f"""
select series_id, step::int as step, {r("sum(w * x) / 4.25", "forecast")}, count(*) as paths from w group by 1, 2"""))
def _(spark, path):
    return an.complexity_path(weekly(spark, path), "ret", 8, "prior")
