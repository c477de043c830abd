"""Calendar resampling, filters, gaps and top-k selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import KEYS, ordered, trailing, whole
from strandline.functions.scalar import div

# Weekly anchors: the weekday a week ends on.
_WEEKDAYS = {"W-MON": "MON", "W-TUE": "TUE", "W-WED": "WED", "W-THU": "THU", "W-FRI": "FRI", "W-SAT": "SAT", "W-SUN": "SUN"}


def period_end(ts: Column, freq: str) -> Column:
    """The last day of the period that holds ``ts``: W-FRI.., ME, QE, YE or QS-OCT (start label)."""
    d = F.to_date(ts)
    if freq in _WEEKDAYS:
        return F.next_day(F.date_sub(d, 1), _WEEKDAYS[freq])
    if freq == "ME":
        return F.last_day(d)
    if freq == "QE":
        return F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", d)), 2))
    if freq == "QS-OCT":
        return F.to_date(F.date_trunc("quarter", d))
    if freq == "YE":
        return F.make_date(F.year(d), F.lit(12), F.lit(31))
    raise ValueError(f"unknown frequency {freq!r}")


def downsample(df: DataFrame, freq: str, how: str = "last", col: str = "value", ts: str = "ts", keys=KEYS) -> DataFrame:
    """One row per period: the last value by time, or the mean.  Both combine on the map side."""
    agg = {
        "last": F.max_by(col, ts),
        "first": F.min_by(col, ts),
        "mean": F.avg(col),
        "sum": F.sum(col),
    }
    if how not in agg:
        raise ValueError(f"unknown resampling rule {how!r}")
    return df.groupBy(*keys, period_end(F.col(ts), freq).alias("period")).agg(agg[how].alias(col)).withColumnRenamed("period", "ts")


def upsample_ffill(df: DataFrame, step: str = "interval 1 month", col: str = "value", keys=KEYS) -> DataFrame:
    """Calendar rows between a series' first and last date, filled forward.

    Each row emits the dates up to the next observation itself (a lead and a
    sequence), so no calendar table is built, joined or broadcast.
    """
    nxt = F.lead("ts").over(ordered(keys))
    dates = F.when(nxt.isNull(), F.array(F.col("ts"))).otherwise(
        F.filter(F.sequence(F.col("ts"), nxt, F.expr(step)), lambda d: d < nxt)
    )
    out = df.withColumn("_d", dates)
    rest = [c for c in df.columns if c not in (*keys, "ts", col)]
    filled = out.select(*keys, F.explode("_d").alias("ts"), F.col(col), (F.col("ts").alias("_src")), *rest)
    return filled.withColumn("filled", F.col("ts") != F.col("_src")).drop("_src")


def crop(df: DataFrame, start, end) -> DataFrame:
    """Inclusive date range on the raw column, so the filter reaches the scan; the last day counts whole."""
    return df.filter((F.col("ts") >= F.lit(start).cast("date")) & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1)))


def outlier_cut(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    c = F.col(col)
    return df.filter(c.isNotNull() & ~F.isnan(c) & (c > low) & (c < high))


def drop_sparse(df: DataFrame, cols: Sequence[str], thresh: int | None = None) -> DataFrame:
    """Drop rows with any null, or with fewer than ``thresh`` non-nulls."""
    return df.na.drop(subset=list(cols)) if thresh is None else df.na.drop(thresh=thresh, subset=list(cols))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, col: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(order).alias(order), F.max_by(col, order).alias(col))


def blank_and_interpolate(df: DataFrame, col: str, threshold: float, keys=KEYS) -> DataFrame:
    """Blank |z| above the threshold, then interpolate linearly by row between kept values.

    After the last kept value the last value is carried on; before the first,
    the result stays null.
    """
    every = whole(keys)
    w = ordered(keys)
    z = div(F.col(col) - F.avg(col).over(every), F.stddev_pop(col).over(every))
    base = df.withColumn("_z", z).withColumn("_rn", F.row_number().over(w))
    kept = F.when(F.abs(F.col("_z")) <= threshold, F.col(col))
    base = base.withColumn("_x", F.when(F.col("_z").isNull(), F.col(col)).otherwise(kept))
    at = F.when(F.col("_x").isNotNull(), F.col("_rn"))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # the rows from here on, as a running frame of the reversed order: one pass instead of one per row
    fore = Window.partitionBy(*keys).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    base = (
        base.withColumn("_x0", F.last("_x", ignorenulls=True).over(back))
        .withColumn("_x1", F.last("_x", ignorenulls=True).over(fore))
        .withColumn("_n0", F.last(at, ignorenulls=True).over(back))
        .withColumn("_n1", F.last(at, ignorenulls=True).over(fore))
    )
    line = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * div(F.col("_rn") - F.col("_n0"), F.col("_n1") - F.col("_n0"))
    smooth = F.when(F.col("_x").isNotNull(), F.col("_x")).otherwise(F.coalesce(line, F.col("_x0")))
    return base.select(*df.columns, smooth.alias("smoothed"), (F.col("_x").isNull() & F.col(col).isNotNull()).cast("int").alias("blanked"))


def top_k(df: DataFrame, keys: Sequence[str], by: str, k: int, tie: str) -> DataFrame:
    """The k largest rows per key with ranks; equal values rank by the tie column.

    Candidates are cut per input partition by Spark's window group limit before
    the shuffle, so a hot key ships k rows per task and not its whole group.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def every_nth(df: DataFrame, n: int, keys=KEYS, offset: int = 0) -> DataFrame:
    rn = F.row_number().over(ordered(keys)) - 1
    return df.withColumn("_rn", rn).filter(F.col("_rn") % n == offset).drop("_rn")
