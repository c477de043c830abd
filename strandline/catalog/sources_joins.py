"""Ingest, reshaping, joins and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog.registry import query
from strandline.catalog.sqlparts import MONTHLY, NATION, WEEKLY, q, r
from strandline.frames import explode_rows
from strandline.operators import align as al
from strandline.operators import resample as rs
from strandline.operators import segment as sg
from strandline.session import shared_dir
from strandline.sources import files, panels

FLAGS = ["A", "N", "R"]


@query("A1_series_ingest", q(MONTHLY, body=f"""
select series_id, ts, value, {r("value / nullif(lag(value, 12) over (partition by series_id order by ts), 0) - 1", "changed")}
from monthly where ts between date '1995-06-01' and date '2000-06-01' and series_id in ('1-URGENT', '5-LOW')"""))
def _(spark, path):
    p = panels.orders_monthly(spark, path)
    return files.ingest(p, "1995-06-01", "2000-06-01", ["1-URGENT", "5-LOW"], "yoy").select("series_id", "ts", "value", "changed")


@query("A2_A4_csv_round_trip", q(WEEKLY, body="select series_id, ts, round(value, 6) as value from weekly"))
def _(spark, path):
    out = shared_dir(spark)
    p = panels.ship_weekly(spark, path).select("series_id", F.date_format("ts", "M/d/yyyy").alias("day"), "value")
    files.write_table(p, out, "csv", ["series_id"])
    back = files.read_csv(spark, out, "day string, value double, series_id string", "day", "M/d/yyyy")
    return back.select("series_id", "ts", "value")


@query("A3_column_coalescing", """
select event_id, value as price from events""")
def _(spark, path):
    ev = panels.table(spark, path, "events").withColumn("Adj Close", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return files.coalesce_columns(ev.withColumnRenamed("value", "Close"), ["Adj Close", "Close", "Price"], "price").select("event_id", "price")


@query("A3_candidate_order", """
select event_id, round(coalesce(case when event_id % 3 = 0 then value * 0.5 end, case when event_id % 2 = 0 then value + 1 end, value), 6) as price from events""")
def _(spark, path):
    ev = panels.table(spark, path, "events").withColumn("Adj Close", F.when(F.col("event_id") % 3 == 0, F.col("value") * 0.5)).withColumn("Price", F.when(F.col("event_id") % 2 == 0, F.col("value") + 1))
    return files.coalesce_columns(ev.withColumnRenamed("value", "Close"), ["Adj Close", "Missing", "Price", "Close"], "price").select("event_id", "price")


@query("A5_reshape_wide", q(WEEKLY, body="""
select ts, round(max(value) filter (series_id = 'A'), 6) as "A", round(max(value) filter (series_id = 'N'), 6) as "N",
       round(max(value) filter (series_id = 'R'), 6) as "R" from weekly group by ts"""))
def _(spark, path):
    return al.wide(panels.ship_weekly(spark, path), FLAGS)


@query("A5_reshape_long", q(WEEKLY, body="select ts, series_id, round(value, 6) as value from weekly"))
def _(spark, path):
    return al.long(al.wide(panels.ship_weekly(spark, path), FLAGS), FLAGS)


@query("A6_vertical_append", q(MONTHLY, body="""
select series_id, ts, round(value, 6) as value, 'history' as origin from monthly where ts < date '2000-01-01'
union all select series_id, ts, round(value, 6), 'update' from monthly where ts >= date '2000-01-01'"""))
def _(spark, path):
    p = panels.orders_monthly(spark, path).select("series_id", "ts", "value")
    cut = F.lit("2000-01-01").cast("date")
    return al.append(p.filter(F.col("ts") < cut).withColumn("origin", F.lit("history")),
                     p.filter(F.col("ts") >= cut).withColumn("origin", F.lit("update")))


def _joined(how):
    return q(MONTHLY, WEEKLY, f"""
a as (select ts, sum(volume) as a, round(sum(cast(value as decimal(20, 2))), 2)::double as amount from monthly group by ts),
b as (select cast(date_trunc('month', ts) as date) as ts, sum(volume) as b, count(*) as weeks from weekly group by 1)""",
             body=f"select coalesce(a.ts, b.ts) as ts, a::double as a, amount, b::double as b, weeks from a {how} join b on a.ts = b.ts")


def _sides(spark, path):
    # counts and whole cents: sums do not depend on the order of addition
    m, w = panels.orders_monthly(spark, path), panels.ship_weekly(spark, path)
    a = m.groupBy("ts").agg(F.sum("volume").cast("double").alias("a"), panels.exact_sum(F.col("value")).alias("amount"))
    month = F.to_date(F.date_trunc("month", "ts")).alias("ts")
    b = w.groupBy(month).agg(F.sum("volume").cast("double").alias("b"), F.count("*").alias("weeks"))
    return a, b


@query("B1_outer_alignment", _joined("full"))
def _(spark, path):
    return al.align(*_sides(spark, path), "full")


@query("B2_inner_alignment", _joined("inner"))
def _(spark, path):
    return al.align(*_sides(spark, path), "inner")


@query("B3_left_alignment", _joined("left"))
def _(spark, path):
    return al.align(*_sides(spark, path), "left")


@query("B4_keyed_cross_section_join", q(NATION, body="""
select a.location, a.year, round(a.value, 6) as sales, round(b.value, 6) as orders
from nation_scores a join nation_scores b on a.location = b.location and a.year = b.year
where a.indicator = 'SALES' and b.indicator = 'ORDERS'"""))
def _(spark, path):
    n = panels.nation_scores(spark, path)
    a = n.filter("indicator = 'SALES'").select("location", "year", F.col("value").alias("sales"))
    b = n.filter("indicator = 'ORDERS'").select("location", "year", F.col("value").alias("orders"))
    return a.join(b, ["location", "year"])


@query("B5_period_alignment", q(MONTHLY, body="""
select a.series_id, a.ts as period, round(a.value, 6) as level, a.volume as n
from monthly a"""))
def _(spark, path):
    m = panels.orders_monthly(spark, path)
    ends = m.select("series_id", F.last_day("ts").alias("ts"), F.col("volume").alias("n"))
    starts = m.select("series_id", "ts", F.col("value").alias("level"))
    return al.align_by_period(starts, ends, "month", ["series_id"])


@query("B5_two_panels", q(MONTHLY, """
s as (select cast(date_trunc('month', l_shipdate) as date) as period, sum(cast(l_quantity as decimal(18,2)))::double as shipped, count(*) as lines from lineitem group by 1)""", body="""
select m.series_id, m.period, round(m.value, 6) as level, s.shipped, s.lines from (select series_id, ts as period, value from monthly) m join s using (period)"""))
def _(spark, path):
    ends = panels.table(spark, path, "lineitem").groupBy(F.last_day(F.to_date("l_shipdate")).alias("ts")).agg(panels.exact_sum(F.col("l_quantity")).alias("shipped"), F.count("*").alias("lines"))
    starts = panels.orders_monthly(spark, path).select("series_id", "ts", F.col("value").alias("level"))
    return al.align_by_period(starts, ends, "month")


@query("B6_trailing_range_join", q(WEEKLY, """
quarters as (select distinct series_id, cast(date_trunc('quarter', ts) + interval 3 month - interval 1 day as date) as ts from weekly),
hits as (select qr.series_id, qr.ts, w.value, row_number() over (partition by qr.series_id, qr.ts order by w.ts desc) as n
         from quarters qr join weekly w on w.series_id = qr.series_id and w.ts <= qr.ts and w.ts >= qr.ts - 91)""", body="""
select qr.series_id, qr.ts, round(max(value) filter (n = 1), 6) as w1, round(max(value) filter (n = 2), 6) as w2,
       round(max(value) filter (n = 3), 6) as w3, round(max(value) filter (n = 4), 6) as w4
from quarters qr left join hits h on h.series_id = qr.series_id and h.ts = qr.ts group by 1, 2"""))
def _(spark, path):
    w = panels.ship_weekly(spark, path)
    quarters = rs.downsample(w, "QE").select("series_id", "ts")
    return al.trailing_values(quarters, w, days=91, n=4)


@query("B6_asof_ticks", q("""
p as (select event_id, ts, value from events where event_type = 'purchase'),
v as (select ts, value from events where event_type = 'view')""", body="""
select p.event_id, p.ts, p.value, v.value as asof_value, v.ts as asof_ts from p asof left join v on p.ts >= v.ts"""))
def _(spark, path):
    t = panels.event_ticks(spark, path)
    left = t.filter("series_id = 'purchase'").withColumn("series_id", F.lit("site"))
    right = t.filter("series_id = 'view'").withColumn("series_id", F.lit("site")).drop("event_id")
    return al.asof(left, right).drop("series_id")


@query("B6_asof_event_types", q("""
v as (select ts, value from events where event_type = 'view')""", body="""
select e.event_id, e.event_type, e.ts, e.value, v.value as asof_value, v.ts as asof_ts from events e asof left join v on e.ts >= v.ts"""))
def _(spark, path):
    # every event, of whatever type, against the views
    t = panels.event_ticks(spark, path).withColumnRenamed("series_id", "event_type").withColumn("series_id", F.lit("site"))
    return al.asof(t, t.filter("event_type = 'view'").select("series_id", "ts", "value")).drop("series_id")


@query("B7_dimension_lookup", """
select o_orderkey, o_orderstatus,
       case o_orderstatus when 'F' then 'filled' when 'O' then 'open' else 'other' end as label,
       case o_orderstatus when 'F' then 1.0 when 'O' then -0.5 else 0.0 end as action
from orders""")
def _(spark, path):
    o = panels.table(spark, path, "orders").select("o_orderkey", "o_orderstatus").withColumn("code", F.ascii("o_orderstatus"))
    codes = {ord("F"): {"label": "filled", "action": 1.0}, ord("O"): {"label": "open", "action": -0.5}}
    return al.lookup(o, "code", codes, {"label": "other", "action": 0.0}).drop("code")


MONTHS = {"spring": "1996-03-01", "autumn": "1997-10-15", "edge": "1995-02-01"}


@query("B8_event_window", q(MONTHLY, """
ev(event, m) as (values ('spring', date '1996-03-01'), ('autumn', date '1997-10-01'), ('edge', date '1995-02-01')),
w as (select series_id, event, datediff('month', m, ts) as off, value from monthly join ev on abs(datediff('month', m, ts)) <= 12)""",
    body="""select series_id, event, off as "offset", round(value, 6) as value,
round(value / max(case when off = 0 then value end) over (partition by series_id, event), 6) as rebased from w"""))
def _(spark, path):
    return al.event_window(panels.orders_monthly(spark, path), MONTHS)


@query("B9_interval_flag", q(MONTHLY, body="""
select series_id, ts, case when ts between date '1996-02-01' and date '1996-08-31' or ts between date '1998-11-15' and date '1999-04-01'
 then 1 else 0 end as recession from monthly"""))
def _(spark, path):
    m = panels.orders_monthly(spark, path).select("series_id", "ts")
    return m.withColumn("recession", al.flag_intervals(m, [("1996-02-01", "1996-08-31"), ("1998-11-15", "1999-04-01")]))


@query("B9_interval_join", q(WEEKLY, MONTHLY, """
spans as (select series_id as span, min(ts) as s, cast(min(ts) + interval 200 day as date) as e from monthly group by 1)""", body="""
select w.series_id, w.ts, span from weekly w join spans on w.ts between s and e"""))
def _(spark, path):
    m = panels.orders_monthly(spark, path)
    spans = m.groupBy(F.col("series_id").alias("span")).agg(F.min("ts").alias("start")).withColumn("end", F.date_add("start", 200))
    return al.join_intervals(panels.ship_weekly(spark, path).select("series_id", "ts"), spans).select("series_id", "ts", "span")


@query("B10_label_drop", q(NATION, body="""
select location, year, round(value, 6) as value from nation_scores n where indicator = 'SALES'
and not exists (select 1 from nation join region on n_regionkey = r_regionkey where n_name = n.location and r_name = 'ASIA')"""))
def _(spark, path):
    n = panels.nation_scores(spark, path).filter("indicator = 'SALES'").select("location", "year", "value")
    asia = panels.table(spark, path, "nation").join(
        panels.table(spark, path, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return al.align(n, asia.select(F.col("n_name").alias("location")), "left_anti", ["location"])


@query("B11_index_restriction", q(WEEKLY, MONTHLY, body="""
select series_id, ts, round(value, 6) as value from weekly
where cast(date_trunc('month', ts) as date) in (select ts from monthly where series_id = '5-LOW' and ts < date '1996-01-01')"""))
def _(spark, path):
    w = panels.ship_weekly(spark, path).select("series_id", "ts", "value").withColumn("month", F.to_date(F.date_trunc("month", "ts")))
    idx = panels.orders_monthly(spark, path).filter("series_id = '5-LOW' and ts < '1996-01-01'").select(F.col("ts").alias("month"))
    return al.align(w, idx, "left_semi", ["month"]).drop("month")


@query("B12_parameter_product", q(WEEKLY, """
g as (select n, d, k from (values (3), (5), (8)) a(n), (values (1), (2)) b(d), (values (0.1), (0.5)) c(k))""", body="""
select series_id, n, d, k, count(*) as "rows", round(sum(value) * k, 6) as scaled from weekly, g group by series_id, n, d, k"""))
def _(spark, path):
    from strandline.operators.sweep import grid

    p = panels.ship_weekly(spark, path).groupBy("series_id").agg(F.count("*").alias("rows"), F.sum("value").alias("s"))
    g = explode_rows(p, grid(n=[3, 5, 8], d=[1, 2], k=[0.1, 0.5]))
    return g.select("series_id", "n", "d", "k", "rows", (F.col("s") * F.col("k")).alias("scaled"))


@query("B13_named_pairs", q(WEEKLY, body="""
select a.series_id || '~' || b.series_id as pair, a.ts, round(a.value, 6) as y, round(b.value, 6) as x
from weekly a join weekly b on a.ts = b.ts and a.series_id < b.series_id"""))
def _(spark, path):
    return al.pair_rows(panels.ship_weekly(spark, path), al.all_pairs(FLAGS)).filter("x is not null and y is not null")


@query("row_numbers_of_ticks", """
select event_id, row_number() over (partition by event_type order by ts) as rn from events""")
def _(spark, path):
    t = panels.event_ticks(spark, path)
    return sg.number_rows(t, tie=["event_id"]).select("event_id", "rn")
