"""Joins and alignment of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import KEYS
from strandline.functions.scalar import div


def wide(df: DataFrame, names: Sequence[str], col: str = "value", ts: str = "ts") -> DataFrame:
    """Long to wide for named series: one partial aggregate by date, no join.

    With the names given there is no extra pass to discover pivot values.
    """
    return df.groupBy(ts).pivot("series_id", list(names)).agg(F.first(col, ignorenulls=True))


def long(df: DataFrame, names: Sequence[str], ts: str = "ts", col: str = "value") -> DataFrame:
    return df.unpivot([ts], list(names), "series_id", col).filter(F.col(col).isNotNull())


def append(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def align(a: DataFrame, b: DataFrame, how: str = "inner", on: Sequence[str] = ("ts",)) -> DataFrame:
    """Join two series on their dates.  The planner picks the join; AQE splits skewed dates."""
    if how not in ("inner", "full", "left", "left_semi", "left_anti"):
        raise ValueError(f"unknown alignment {how!r}")
    return a.join(b, list(on), how)


def align_by_period(a: DataFrame, b: DataFrame, unit: str, on: Sequence[str] = ()) -> DataFrame:
    """Join two series whose dates differ inside a period (month against month end)."""
    pa = a.withColumn("period", F.to_date(F.date_trunc(unit, F.col("ts")))).drop("ts")
    pb = b.withColumn("period", F.to_date(F.date_trunc(unit, F.col("ts")))).drop("ts")
    return pa.join(pb, [*on, "period"])


def trailing_values(left: DataFrame, right: DataFrame, days: int, n: int, keys=KEYS, col: str = "value", bucket_days: int | None = None) -> DataFrame:
    """Up to n latest right values in ``[ts - days, ts]`` of every left row, as w1..wn (latest first).

    The range condition becomes an equality on time buckets as wide as the range,
    so the join hashes on (keys, bucket) and a hot series spreads over its
    buckets.  A right row is sent to its own bucket and the next.
    """
    size = bucket_days or days
    if size < days:
        raise ValueError("buckets must be at least as wide as the range")
    day = F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date"))
    a = left.withColumn("_b", F.floor(day / size))
    b = right.select(
        *keys, F.col("ts").alias("_rts"), F.col(col).alias("_rv"), F.explode(F.array(F.floor(day / size), F.floor(day / size) + 1)).alias("_b")
    )
    hit = a.join(b, [*keys, "_b"]).filter((F.col("_rts") <= F.col("ts")) & (F.col("_rts") >= F.date_sub(F.col("ts"), days)))
    newest = Window.partitionBy(*keys, "ts").orderBy(F.col("_rts").desc())
    last = hit.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)
    picks = last.groupBy(*keys, "ts").agg(*[F.max(F.when(F.col("_n") == i, F.col("_rv"))).alias(f"w{i}") for i in range(1, n + 1)])
    return left.select(*keys, "ts").join(picks, [*keys, "ts"], "left")


def asof(left: DataFrame, right: DataFrame, keys=KEYS, col: str = "value", order: str = "ts", bucket=None) -> DataFrame:
    """Last right value at or before each left row.

    Rows are cut into time buckets (``bucket(ts)``, or buckets of similar size from
    a quantile sketch of both sides).  Left and right rows of one bucket are
    ordered together; the last right row of every bucket is carried forward over
    the bucket totals.  No task ever sees a whole series.
    """
    empty = F.lit(None).cast(right.select(F.struct(F.col(order).alias("t"), F.col(col).cast("double").alias("v"))).schema[0].dataType)
    a = left.withColumn("_side", F.lit(1)).withColumn("_r", empty)
    b = right.select(*keys, F.col(order), F.lit(0).alias("_side"), F.struct(F.col(order).alias("t"), F.col(col).cast("double").alias("v")).alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    if bucket is not None:
        both = both.withColumn("_b", bucket(F.col(order)))
    else:
        from strandline.operators.quantiles import balanced_buckets

        both = balanced_buckets(both, order, keys)
    totals = both.groupBy(*keys, "_b").agg(F.max("_r").alias("_last"))
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_b", F.last("_last", ignorenulls=True).over(prior).alias("_carry"))
    local = Window.partitionBy(*keys, "_b").orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_r", ignorenulls=True).over(local), F.col("_carry"))
    out = both.join(carry.hint("shuffle_hash"), [*keys, "_b"]).withColumn("_f", found).filter(F.col("_side") == 1)
    return out.select(*left.columns, F.col("_f.v").alias("asof_value"), F.col("_f.t").alias("asof_ts"))


def lookup(df: DataFrame, code: str, table: dict[int, dict], defaults: dict) -> DataFrame:
    """Attach attributes of a small fixed code table by map literal, with defaults for unknown codes."""
    out = df
    for attr, default in defaults.items():
        pairs = [F.lit(x) for k, row in table.items() for x in (k, row[attr])]
        out = out.withColumn(attr, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(code)), F.lit(default)))
    return out


def event_window(df: DataFrame, events: dict[str, str], before: int = 12, after: int = 12, col: str = "value", keys=KEYS) -> DataFrame:
    """Months -before..after round named event months, rebased on the event month.

    Events are literals: each row is tested against the few event months it can
    touch, so the range join turns into a filter of an exploded literal array.
    """
    ev = F.array(*[F.struct(F.lit(k).alias("event"), F.lit(v).cast("date").alias("month")) for k, v in events.items()])
    offset = lambda m: F.round(F.months_between(F.trunc("ts", "month"), F.trunc(m, "month"))).cast("int")
    hits = df.withColumn("_e", F.explode(F.filter(ev, lambda e: offset(e["month"]).between(-before, after))))
    rows = hits.select(*keys, F.col("_e.event").alias("event"), offset(F.col("_e.month")).alias("offset"), F.col(col).alias("_v"))
    w = Window.partitionBy(*keys, "event")
    base = F.max(F.when(F.col("offset") == 0, F.col("_v"))).over(w)
    return rows.select(*keys, "event", "offset", F.col("_v").alias(col), div(F.col("_v"), base).alias("rebased"))


def flag_intervals(df: DataFrame, intervals: Sequence[tuple[str, str]]) -> Column:
    """1 where ts falls in any closed interval.  Literal intervals need no join."""
    hit = F.lit(False)
    for a, b in intervals:
        hit = hit | F.col("ts").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return hit.cast("int")


def join_intervals(df: DataFrame, intervals: DataFrame, unit: str = "month") -> DataFrame:
    """Rows inside (start, end) intervals held in a table of any size.

    Each interval is expanded into the periods it touches; the join is an
    equality on the period with the exact bounds as residual filter.
    """
    step = F.expr(f"interval 1 {unit}")
    spans = intervals.withColumn(
        "_p", F.explode(F.sequence(F.to_date(F.date_trunc(unit, "start")), F.to_date(F.date_trunc(unit, "end")), step))
    )
    rows = df.withColumn("_p", F.to_date(F.date_trunc(unit, "ts")))
    return rows.join(spans, "_p").filter(F.col("ts").between(F.col("start"), F.col("end"))).drop("_p")


def pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]], col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(pair, ts, y, x) for named pairs (y, x), by one aggregate instead of a self-join.

    Every row is copied once for each pair it takes part in; rows meet on
    (pair, ts), so no date and no series is a hot key and no pair is formed that
    nobody asked for.
    """
    roles: dict[str, list[tuple[str, str]]] = {}
    for y, x in pairs:
        roles.setdefault(y, []).append((f"{y}~{x}", "y"))
        roles.setdefault(x, []).append((f"{y}~{x}", "x"))
    entry = lambda name: F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(r).alias("role")) for p, r in roles[name]])
    mapping = F.create_map(*[x for name in roles for x in (F.lit(name), entry(name))])
    tagged = df.filter(F.col("series_id").isin(list(roles))).withColumn("_r", F.explode(mapping[F.col("series_id")]))
    return tagged.groupBy(F.col("_r.pair").alias("pair"), "ts").agg(
        F.max(F.when(F.col("_r.role") == "y", F.col(col))).alias("y"),
        F.max(F.when(F.col("_r.role") == "x", F.col(col))).alias("x"),
    )


def all_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    names = sorted(names)
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def bounded_broadcast(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """Broadcast a reduced side if it has at most ``limit`` rows, else leave the join to the planner.

    The side is persisted (it spills to disk), counted once, and reused.  Beyond
    the limit the join shuffles and AQE splits skewed keys.
    """
    kept = df.persist()
    return F.broadcast(kept) if kept.limit(limit + 1).count() <= limit else kept
