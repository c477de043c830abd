"""Panels built from the warehouse tables.

Raw ticks and line items are reduced to calendar bars by one partial (map-side)
aggregate before anything is ordered, so a series that holds a third of all rows
costs its scan tasks a few counters per bar instead of one overloaded window
task.  Amounts are added as whole cents: sums do not depend on the order in which
shuffled rows arrive, so reruns after a lost executor give identical bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def exact_sum(c: Column) -> Column:
    """Sum of a two-decimal amount, exact and independent of row order.

    Cents are added as longs (fast in generated code); a bar whose sum leaves the
    range of a long raises an error instead of wrapping round, and so does an amount
    with a fraction of a cent: nothing is cut off unseen.
    """
    cents = F.rint(c * 100)
    whole = F.abs(c * 100 - cents) <= F.lit(1e-6) * F.greatest(F.lit(1.0), F.abs(cents) * 1e-6)
    return F.sum(F.when(whole | c.isNull(), cents.cast("long")).otherwise(F.raise_error(F.lit("amount with more than two decimals")).cast("long"))) / F.lit(100.0)


def event_ticks(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, ts, value) per event, irregular in time."""
    return table(spark, path, "events").select(
        F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "event_id"
    )


def daily_events(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars per event type: value (mean), volume, open, high, low, close."""
    ev = table(spark, path, "events")
    return ev.groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("ts")).agg(
        (exact_sum(F.col("value")) / F.count("value")).alias("value"),
        F.count("*").alias("volume"),
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
    )


def orders_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Monthly order value per priority; ts is the first day of the month."""
    o = table(spark, path, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("series_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("ts")
    ).agg(exact_sum(F.col("o_totalprice")).alias("value"), F.count("*").alias("volume"))


def ship_weekly(spark: SparkSession, path: str) -> DataFrame:
    """Weekly volume-weighted unit price per return flag; ts is the Monday."""
    li = table(spark, path, "lineitem")
    return li.groupBy(
        F.col("l_returnflag").alias("series_id"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("ts")
    ).agg(
        (exact_sum(F.col("l_extendedprice")) / exact_sum(F.col("l_quantity"))).alias("value"),
        F.count("*").alias("volume"),
    )


def supplier_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Monthly unit price for every supplier: the panel with many series."""
    li = table(spark, path, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").cast("string").alias("series_id"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("ts"),
    ).agg(
        (exact_sum(F.col("l_extendedprice")) / exact_sum(F.col("l_quantity"))).alias("value"),
        F.count("*").alias("volume"),
    )


def nation_scores(spark: SparkSession, path: str) -> DataFrame:
    """Cross-section nation x year: (location, indicator, year, value)."""
    o, c, n = (table(spark, path, t) for t in ("orders", "customer", "nation"))
    sales = o.join(c, o.o_custkey == c.c_custkey)
    by_key = sales.groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(
        exact_sum(F.col("o_totalprice")).alias("sales"), F.count("*").alias("orders")
    )
    named = by_key.join(n, by_key.c_nationkey == n.n_nationkey)
    return named.select(
        F.col("n_name").alias("location"),
        "year",
        F.explode(
            F.array(
                F.struct(F.lit("SALES").alias("indicator"), F.col("sales").alias("value")),
                F.struct(F.lit("ORDERS").alias("indicator"), F.col("orders").cast("double").alias("value")),
            )
        ).alias("s"),
    ).select("location", "s.indicator", "year", "s.value")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), "label"
    )


def returns(panel: DataFrame, value: str = "value", keys=("series_id",)) -> DataFrame:
    """Add ``ret``, the one-period growth rate (null on the first row)."""
    from strandline.operators.transform import pct_change

    return pct_change(panel, value, 1, keys=keys, out="ret")
