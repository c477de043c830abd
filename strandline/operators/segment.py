"""Row numbers and windows for series too long for one task.

A plain ``Window.partitionBy(series)`` sends a whole series to one task.  The
functions here cut every series into segments of bounded size:

* ``number_rows`` gives the global row number from per-bucket counts,
* ``segmented`` copies the last rows of a segment into the next one (halo), so any
  trailing window operator gives exact results with keys ``(..., "seg")``,
* ``running`` carries cumulative sums, products and maxima over segment totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import KEYS, SEG_KEYS  # noqa: F401
from strandline.operators.quantiles import balanced_buckets



def number_rows(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", bucket: Column | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Add ``rn``: position in the series, without ordering a whole series in one task.

    Rows of one time are numbered by the ``tie`` columns.  Name them where times repeat:
    numbers may be computed more than once (in two branches of a plan, or again after a
    lost task) and must then agree.

    Rows are cut into time buckets: a column monotone in ts, or by default buckets
    of similar size from a quantile sketch.  Counts per bucket are a partial
    aggregate and only they are ordered per series; the rows are numbered by
    (series, bucket), the partitioning of the join that brings the offset.
    """
    b = df.withColumn("_b", bucket) if bucket is not None else balanced_buckets(df, ts, keys)
    counts = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_off"))
    joined = b.join(offsets.hint("shuffle_hash"), [*keys, "_b"])
    w = Window.partitionBy(*keys, "_b").orderBy(ts, *tie)
    return joined.withColumn("rn", F.col("_off") + F.row_number().over(w)).drop("_b", "_off")


def segmented(df: DataFrame, before: int, rows: int = 100_000, rn: str = "rn") -> DataFrame:
    """Add ``seg`` and ``halo``; each segment starts with the ``before`` rows that precede it.

    A halo may be longer than a segment: a row is copied to every segment that it reaches.

    Window operators run with keys ``SEG_KEYS`` and ``drop_halo`` removes the copies.
    """
    own = F.floor((F.col(rn) - 1) / rows)
    segs = F.sequence(own, F.floor((F.col(rn) - 1 + before) / rows))
    out = df.withColumn("_own", own).withColumn("seg", F.explode(segs))
    return out.withColumn("halo", F.col("seg") != F.col("_own")).drop("_own")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("halo")).drop("seg", "halo")


_RUNNING = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0.0)) + b),
    "product": (F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * b),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(df: DataFrame, outputs: dict[str, tuple[Column, str]], rows: int = 100_000, keys: Sequence[str] = KEYS, rn: str = "rn") -> DataFrame:
    """Cumulative sums, products, maxima or minima over long series.

    ``outputs`` maps a new column to (expression, kind).  Each segment is scanned
    on its own; one total per segment and output is combined in order and joined
    back on (keys, seg).  The scan reuses the partitioning of that join.
    """
    base = df.withColumn("seg", F.floor((F.col(rn) - 1) / rows))
    for i, (x, _) in enumerate(outputs.values()):
        base = base.withColumn(f"_x{i}", x)
    kinds = [how for _, how in outputs.values()]
    totals = base.groupBy(*keys, "seg").agg(*[_RUNNING[k][0](f"_x{i}").alias(f"_t{i}") for i, k in enumerate(kinds)])
    w = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "seg", *[_RUNNING[k][0](f"_t{i}").over(w).alias(f"_c{i}") for i, k in enumerate(kinds)])
    local = Window.partitionBy(*keys, "seg").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    joined = base.join(carry.hint("shuffle_hash"), [*keys, "seg"])
    made = [_RUNNING[k][1](F.col(f"_c{i}"), _RUNNING[k][0](f"_x{i}").over(local)).alias(out) for i, (out, k) in enumerate(zip(outputs, kinds))]
    return joined.select(*df.columns, *made)
