"""Common table expressions shared by the DuckDB oracles."""

from __future__ import annotations

DAILY = """daily as (
  select event_type as series_id, cast(ts as date) as ts,
         cast(sum(cast(value as decimal(18,2))) as double) / count(value) as value,
         count(*) as volume, arg_min(value, ts) as open, max(value) as high,
         min(value) as low, arg_max(value, ts) as close
  from events group by 1, 2)"""

MONTHLY = """monthly as (
  select o_orderpriority as series_id, cast(date_trunc('month', o_orderdate) as date) as ts,
         cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value, count(*) as volume
  from orders group by 1, 2)"""

WEEKLY = """weekly as (
  select l_returnflag as series_id, cast(date_trunc('week', l_shipdate) as date) as ts,
         cast(sum(cast(l_extendedprice as decimal(18,2))) as double)
           / cast(sum(cast(l_quantity as decimal(18,2))) as double) as value,
         count(*) as volume
  from lineitem group by 1, 2)"""

SUPPLIER = """supplier_m as (
  select cast(l_suppkey as varchar) as series_id, cast(date_trunc('month', l_shipdate) as date) as ts,
         cast(sum(cast(l_extendedprice as decimal(18,2))) as double)
           / cast(sum(cast(l_quantity as decimal(18,2))) as double) as value,
         count(*) as volume
  from lineitem group by 1, 2)"""

NATION = """nation_scores as (
  with s as (select n_name as location, year(o_orderdate) as year,
                    cast(sum(cast(o_totalprice as decimal(18,2))) as double) as sales, count(*) as orders
             from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
             group by 1, 2)
  select location, 'SALES' as indicator, year, sales as value from s
  union all select location, 'ORDERS', year, cast(orders as double) from s)"""


def rets(source: str, name: str = "rets") -> str:
    """Growth rates of a panel, with the row number inside the series."""
    return f"""{name} as (
  select *, value / nullif(lag(value) over (partition by series_id order by ts), 0) - 1 as ret,
         row_number() over (partition by series_id order by ts) as rn
  from {source})"""


def q(*ctes: str, body: str, recursive: bool = False) -> str:
    return "with " + ("recursive " if recursive else "") + ",\n".join(ctes) + "\n" + body


def r(expr: str, name: str, digits: int = 6) -> str:
    """A rounded output column without negative zero."""
    return f"round({expr}, {digits}) + 0.0 as {name}"


def full(fn: str, x: str, n: int, delay: int = 0, part: str = "series_id", order: str = "ts") -> str:
    """A windowed aggregate over exactly n non-null rows, else null."""
    frame = f"(partition by {part} order by {order} rows between {n - 1 + delay} preceding and {delay} preceding)"
    if delay == 0:
        frame = f"(partition by {part} order by {order} rows between {n - 1} preceding and current row)"
    return f"case when count({x}) over {frame} = {n} then {fn} over {frame} end"
