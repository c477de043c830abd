"""Resampling, filters and scalar transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog.registry import query
from strandline.catalog.sqlparts import DAILY, MONTHLY, NATION, WEEKLY, q, r, rets
from strandline.operators import align as al
from strandline.operators import resample as rs
from strandline.operators import transform as tr
from strandline.sources import panels



def lag(x, k=1):
    return f"lag({x}, {k}) over (partition by series_id order by ts)"


@query("C1_downsample_last_friday", q("""
d as (select event_type as series_id, cast(ts as date) + ((5 - isodow(cast(ts as date)) + 7) % 7)::int as wk, ts, value from events)""",
    body="select series_id, cast(wk as date) as ts, arg_max(value, ts) as value from d group by 1, 2"))
def _(spark, path):
    return rs.downsample(panels.event_ticks(spark, path), "W-FRI")


@query("C1_downsample_last_month_end", q(WEEKLY, body="""
select series_id, last_day(ts) as ts, round(arg_max(value, ts), 6) as value from weekly group by 1, 2"""))
def _(spark, path):
    return rs.downsample(panels.ship_weekly(spark, path), "ME")


@query("C1_downsample_last_quarter_start", q(MONTHLY, body="""
select series_id, cast(date_trunc('quarter', ts) as date) as ts, round(arg_max(value, ts), 6) as value from monthly group by 1, 2"""))
def _(spark, path):
    return rs.downsample(panels.orders_monthly(spark, path), "QS-OCT")


@query("C2_downsample_mean", q(WEEKLY, body="""
select series_id, last_day(cast(date_trunc('quarter', ts) + interval 2 month as date)) as ts, round(avg(value), 6) as value from weekly group by 1, 2"""))
def _(spark, path):
    return rs.downsample(panels.ship_weekly(spark, path), "QE", "mean")


@query("C3_upsample_forward_fill", q(MONTHLY, """
g as (select series_id, ts, value from monthly),
lim as (select series_id, min(ts) a, max(ts) b from g group by 1),
cal as (select series_id, cast(unnest(generate_series(a, b, interval 1 month)) as date) as ts from lim)""", body="""
select c.series_id, c.ts, round(last_value(g.value ignore nulls) over (partition by c.series_id order by c.ts), 6) as value,
       g.value is null as filled
from cal c left join g on g.series_id = c.series_id and g.ts = c.ts"""))
def _(spark, path):
    p = panels.orders_monthly(spark, path).select("series_id", "ts", "value")
    return rs.upsample_ffill(p)


@query("C4_date_crop", """
select event_id, value from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-21'""")
def _(spark, path):
    return rs.crop(panels.event_ticks(spark, path), "2024-01-05", "2024-01-20").select("event_id", "value")


@query("C5_outlier_cut", "select event_id, value from events where value > 1.5 and value < 60")
def _(spark, path):
    return rs.outlier_cut(panels.event_ticks(spark, path), "value", 1.5, 60.0).select("event_id", "value")


@query("C6_drop_sparse", q(MONTHLY, rets("monthly"), """
l as (select series_id, ts, ret, lag(ret, 3) over (partition by series_id order by ts) as ret3, lag(ret, 12) over (partition by series_id order by ts) as ret12 from rets)""",
    body=f"""select series_id, ts, {r("ret", "ret")}, {r("ret3", "ret3")}, {r("ret12", "ret12")} from l
where (ret is not null)::int + (ret3 is not null)::int + (ret12 is not null)::int >= 2"""))
def _(spark, path):
    p = panels.returns(panels.orders_monthly(spark, path))
    p = tr.shift(tr.shift(p, "ret", 3, out="ret3"), "ret", 12, out="ret12")
    return rs.drop_sparse(p.select("series_id", "ts", "ret", "ret3", "ret12"), ["ret", "ret3", "ret12"], thresh=2)


@query("C7_latest_per_key", q(NATION, body="""
select location, indicator, max(year) as year, round(arg_max(value, year), 6) as value from nation_scores group by 1, 2"""))
def _(spark, path):
    return rs.latest_per_key(panels.nation_scores(spark, path), ["location", "indicator"], "year")


@query("C8_blank_and_interpolate", q(WEEKLY, """
z as (select *, row_number() over (partition by series_id order by ts) as rn,
      case when abs((value - avg(value) over (partition by series_id)) / stddev_pop(value) over (partition by series_id)) <= 1.5 then value end as x from weekly),
n as (select *, last_value(x ignore nulls) over b as x0, first_value(x ignore nulls) over f as x1,
      last_value(case when x is not null then rn end ignore nulls) over b as n0,
      first_value(case when x is not null then rn end ignore nulls) over f as n1 from z
      window b as (partition by series_id order by ts rows between unbounded preceding and current row),
             f as (partition by series_id order by ts rows between current row and unbounded following))""", body=f"""
select series_id, ts, {r("case when x is not null then x else coalesce(x0 + (x1 - x0) * (rn - n0) / nullif(n1 - n0, 0), x0) end", "smoothed")},
 case when x is null then 1 else 0 end as blanked from n"""))
def _(spark, path):
    return rs.blank_and_interpolate(panels.ship_weekly(spark, path), "value", 1.5).select("series_id", "ts", "smoothed", "blanked")


@query("C9_top_k_rank", """
select event_type as series_id, event_id, value, rank from (
  select *, row_number() over (partition by event_type order by value desc, event_id) as rank from events) where rank <= 3""")
def _(spark, path):
    return rs.top_k(panels.event_ticks(spark, path), ["series_id"], "value", 3, "event_id").select("series_id", "event_id", "value", "rank")


@query("C10_every_nth", q(WEEKLY, body="""
select series_id, ts, round(value, 6) as value from (select *, row_number() over (partition by series_id order by ts) - 1 as rn from weekly) where rn % 7 = 0"""))
def _(spark, path):
    return rs.every_nth(panels.ship_weekly(spark, path), 7).select("series_id", "ts", "value")


@query("D1_shift", q(MONTHLY, body=f"""
select series_id, ts, {r("value", "lag0")}, {r(lag("value"), "lag1")}, {r(lag("value", 12), "lag12")},
  {r("lead(value, 2) over (partition by series_id order by ts)", "lead2")} from monthly"""))
def _(spark, path):
    p = panels.orders_monthly(spark, path)
    for k, name in ((0, "lag0"), (1, "lag1"), (12, "lag12"), (-2, "lead2")):
        p = tr.shift(p, "value", k, out=name)
    return p.select("series_id", "ts", "lag0", "lag1", "lag12", "lead2")


@query("D2_difference", q(WEEKLY, body=f"""
select series_id, ts, {r(f"value - {lag('value')}", "diff")}, {r(f"value - {lag('value', 4)}", "diff4")} from weekly"""))
def _(spark, path):
    p = tr.difference(panels.ship_weekly(spark, path), "value")
    return tr.difference(p, "value", 4, out="diff4").select("series_id", "ts", "diff", "diff4")


@query("D3_percent_change", q(MONTHLY, body=f"""
select series_id, ts, {r(f"value / {lag('value')} - 1", "ret")}, {r(f"value / {lag('value', 12)} - 1", "yoy")} from monthly"""))
def _(spark, path):
    p = panels.returns(panels.orders_monthly(spark, path))
    return tr.pct_change(p, "value", 12, out="yoy").select("series_id", "ts", "ret", "yoy")


@query("D4_log_growth", q(MONTHLY, body=f"""
select series_id, ts, {r(f"100 * (ln(value) - ln({lag('value')}))", "growth")}, {r(f"400 * (ln(value) - ln({lag('value', 3)}))", "annualised")} from monthly"""))
def _(spark, path):
    p = tr.log_growth(panels.orders_monthly(spark, path))
    return tr.log_growth(p, k=3, scale=400.0, out="annualised").select("series_id", "ts", "growth", "annualised")


@query("D5_ratio_and_spread", q(WEEKLY, """w as (
select ts, max(value) filter (series_id = 'A') a, max(value) filter (series_id = 'N') n, max(value) filter (series_id = 'R') r from weekly group by 1)""",
    body="select ts, round(a / n, 6) as ratio, round(a - r, 6) as spread from w where a is not null and n is not null and r is not null"))
def _(spark, path):
    w = al.wide(panels.ship_weekly(spark, path), ["A", "N", "R"]).dropna()
    return w.select("ts", F.try_divide("A", "N").alias("ratio"), (F.col("A") - F.col("R")).alias("spread"))


@query("D6_rebase", q(MONTHLY, body=f"""
select series_id, ts, {r('value / first_value(value) over (partition by series_id order by ts) * 100', 'index')} from monthly"""))
def _(spark, path):
    return tr.rebase(panels.orders_monthly(spark, path)).select("series_id", "ts", "index")


@query("D7_composite_index", q(WEEKLY, """
b as (select *, 100 * value / first_value(value) over (partition by series_id order by ts) as index from weekly)""", body="""
select ts, round(sum(case series_id when 'A' then 0.5 when 'N' then 0.3 else 0.2 end * index), 6) as composite, count(*) as members
from b group by ts having count(*) = 3"""))
def _(spark, path):
    return tr.composite_index(panels.ship_weekly(spark, path), {"A": 5.0, "N": 3.0, "R": 2.0})


@query("D7_composite_equal_weight", q(MONTHLY, """
b as (select *, 100 * value / first_value(value) over (partition by series_id order by ts) as index from monthly)""", body="""
select ts, round(avg(index), 6) as composite, count(*) as members from b group by ts"""))
def _(spark, path):
    return tr.composite_index(panels.orders_monthly(spark, path))


@query("D8_sign", q(WEEKLY, rets("weekly"), body="""
select series_id, ts, cast(sign(ret) as int) as sgn, case when ret > 0 then 1 when ret <= 0 then -1 end as binary, case when ret > 0 then 1 when ret <= 0 then 0 end as up from rets"""))
def _(spark, path):
    x = F.col("ret")
    p = panels.returns(panels.ship_weekly(spark, path))
    return p.select("series_id", "ts", tr.sign_of(x).alias("sgn"), tr.sign_of(x, -1).alias("binary"), (x > 0).cast("int").alias("up"))


@query("D9_quadrant_dummies", q(WEEKLY, rets("weekly"), "d as (select *, ret - lag(ret) over (partition by series_id order by ts) as dr from rets)", body="""
select series_id, ts, (dr > 0 and ret > 0)::int as up_gain, (dr > 0 and ret <= 0)::int as up_loss,
       (dr <= 0 and ret > 0)::int as down_gain, (dr <= 0 and ret <= 0)::int as down_loss from d where dr is not null"""))
def _(spark, path):
    p = tr.quadrant_dummies(panels.returns(panels.ship_weekly(spark, path)))
    return p.select("series_id", "ts", "up_gain", "up_loss", "down_gain", "down_loss").dropna()


@query("D10_threshold_interaction", q(WEEKLY, rets("weekly"), body=f"""
select series_id, ts, case when ret < -0.05 then 1.0 when ret is not null then 0.0 end as below,
 {r("case when ret < -0.05 then ret when ret is not null then 0.0 end", "interaction")} from rets"""))
def _(spark, path):
    p = tr.threshold_interaction(panels.returns(panels.ship_weekly(spark, path)), "ret", -0.05)
    return p.select("series_id", "ts", "below", "interaction")


@query("D11_iso_elastic", q(WEEKLY, body=f"""
select series_id, ts, {r("0.25 * pow(100, 0.75) * pow(value, 0.25)", "iso_price")},
 {r(f"0.031623 * (value - {lag('value')}) / pow(value, 0.75)", "iso_ret")} from weekly"""))
def _(spark, path):
    return tr.iso_elastic(panels.ship_weekly(spark, path)).select("series_id", "ts", "iso_price", "iso_ret")


@query("D12_deannualise", "select l_orderkey, l_linenumber, round(pow(1 + l_tax, 1.0 / 12) - 1, 9) as monthly_rate from lineitem", digits=9)
def _(spark, path):
    li = panels.table(spark, path, "lineitem")
    return li.select("l_orderkey", "l_linenumber", tr.deannualise(F.col("l_tax")).alias("monthly_rate"))


@query("D13_range_volume_booster", q(DAILY, body=f"""
select series_id, ts, {r(f"high / {lag('low')} - 1", "reach")}, {r(f"volume::double / {lag('volume')}", "volume_ratio")},
 {r(f"(high / {lag('low')} - 1) * (volume::double / {lag('volume')})", "booster")} from daily"""))
def _(spark, path):
    return tr.range_volume_booster(panels.daily_events(spark, path)).select("series_id", "ts", "reach", "volume_ratio", "booster")


@query("D14_time_basis", q(MONTHLY, """
s as (select series_id, ts, row_number() over (partition by series_id order by ts)::double / count(*) over (partition by series_id) as x from monthly)""",
    body="select series_id, ts, round(x, 12) as t1, round(2 * x * x - 1, 12) + 0.0 as t2, round(4 * x * x * x - 3 * x, 12) + 0.0 as t3 from s"), digits=12)
def _(spark, path):
    b = tr.time_basis(panels.orders_monthly(spark, path), 3)
    return b.select("series_id", "ts", *[F.col("basis")[k].alias(f"t{k}") for k in (1, 2, 3)])


@query("D14_lag_basis", q(WEEKLY, """
l as (select series_id, ts, lag(value, 1) over w as a, lag(value, 2) over w as b from weekly window w as (partition by series_id order by ts)),
z as (select series_id, ts, 2 * (a - min(a) over p) / (max(a) over p - min(a) over p) - 1 as a,
             2 * (b - min(b) over p) / (max(b) over p - min(b) over p) - 1 as b from l window p as (partition by series_id))""", body=f"""
select series_id, ts, {r("a", "t1_lag1")}, {r("2 * a * a - 1", "t2_lag1")}, {r("b", "t1_lag2")}, {r("2 * b * b - 1", "t2_lag2")}, {r("a * b", "lag1_x_lag2")} from z"""))
def _(spark, path):
    return tr.lag_basis(panels.ship_weekly(spark, path), "value", [1, 2], 2).drop("value", "volume")


def _scaled(a, b):
    return q(WEEKLY, f"s as (select series_id, {a} as a, {b} as b from weekly where ts < date '1999-01-01' group by 1)",
             body=f"select series_id, ts, {r('(value - a) / b', 'scaled')} from weekly join s using (series_id)")


@query("D15_standardise_by_training", _scaled("avg(value)", "stddev_samp(value)"))
def _(spark, path):
    train = F.col("ts") < F.lit("1999-01-01").cast("date")
    return tr.standardise_by_training(panels.ship_weekly(spark, path), "value", train).select("series_id", "ts", "scaled")


@query("D15_minmax_by_training", _scaled("min(value)", "max(value) - min(value)"))
def _(spark, path):
    train = F.col("ts") < F.lit("1999-01-01").cast("date")
    return tr.standardise_by_training(panels.ship_weekly(spark, path), "value", train, how="minmax").select("series_id", "ts", "scaled")


@query("D16_iterated_log_weights", q("n as (select distinct l_quantity::int as n from lineitem)", """
s as (select n, case when n <= 1 then 0 when floor(ln(n)) <= 1 then 1 when floor(ln(floor(ln(n)))) <= 1 then 2 else 3 end as log_star from n)""",
    body="select n, log_star, round(pow(2.0, -log_star), 6) as weight from s"))
def _(spark, path):
    from strandline.functions.scalar import iterated_log_of

    n = panels.table(spark, path, "lineitem").select(F.col("l_quantity").cast("int").alias("n")).distinct()
    return n.withColumn("log_star", iterated_log_of(F.col("n"))).withColumn("weight", F.pow(F.lit(2.0), -F.col("log_star")))


@query("D17_bit_packing", """
select event_id, 1 + (value > 10)::int + 2 * (value > 50)::int + 4 * (user_id % 2)::int + 8 * (event_type = 'click')::int as code from events""")
def _(spark, path):
    ev = panels.table(spark, path, "events")
    bits = [F.col("value") > 10, F.col("value") > 50, F.col("user_id") % 2, F.col("event_type") == "click"]
    return ev.select("event_id", tr.pack_bits(bits).alias("code"))


@query("D18_period_label", q(MONTHLY, body="""
select year(ts) || '-Q' || quarter(ts) as period, count(*) as n, round(sum(value), 3) as total from monthly group by 1"""), digits=3)
def _(spark, path):
    m = panels.orders_monthly(spark, path)
    return m.groupBy(tr.period_label(F.col("ts")).alias("period")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
