"""Balanced buckets and exact quantiles of groups too large for one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer.
Here values are counted first, cut into buckets of similar size by an approximate
(mergeable) quantile sketch, and only the buckets that hold a wanted rank are
ordered.  The answer is exact; the sketch only decides how the work is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.operators.align import bounded_broadcast

#: Largest table of cut points that may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def place(df: DataFrame, x: Column, splits: DataFrame, keys: Sequence[str], buckets: int, out: str = "_b") -> DataFrame:
    """Join the cut points (array ``_s``) and add the number of them at or below x."""
    kept = bounded_broadcast(splits, limit=max(1, BROADCAST_BYTES // (8 * buckets)))
    steps = [1 << i for i in range((buckets - 1).bit_length() - 1, -1, -1)]
    # binary search as one expression: a chain of projections would be inlined into itself
    search = F.aggregate(
        F.array(*[F.lit(v) for v in steps]), F.lit(0), lambda at, w: at + F.when(F.get("_s", at + w - 1) <= F.col("_x"), w).otherwise(0)
    )
    return df.withColumn("_x", x).join(kept, list(keys)).withColumn(out, search)


def cut_points(x: str, buckets: int) -> Column:
    """Approximate, mergeable quantiles that split a group into ``buckets`` parts."""
    return F.percentile_approx(x, [i / buckets for i in range(1, buckets)], 10 * buckets)


def _time_number(df: DataFrame, ts: str) -> Column:
    """A long that grows with the time column; local timestamps are read without a time zone."""
    kind, t = dict(df.dtypes)[ts], F.col(ts)
    if kind == "timestamp_ntz":
        day = F.unix_date(F.to_date(t)).cast("long") * 86_400_000_000
        return day + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")
    if kind == "timestamp":
        return F.unix_micros(t)
    if kind == "date":
        return F.unix_date(t).cast("long")
    return t.cast("long")


def balanced_buckets(df: DataFrame, ts: str, keys: Sequence[str], buckets: int = 512, rows: int = 100_000, out: str = "_b") -> DataFrame:
    """Time buckets of at most about ``rows`` rows per key, monotone in ts, however rows crowd together.

    A quantile sketch cuts every key into ``buckets`` parts of equal size, and each
    part into as many equal spans of time as its size asks for.  Only the balance
    depends on the sketch: any monotone buckets give right results.
    """
    marked = df.withColumn("_u", _time_number(df, ts))
    splits = marked.groupBy(*keys).agg(cut_points("_u", buckets).alias("_s"), F.count("*").alias("_n"), F.min("_u").alias("_lo"), F.max("_u").alias("_hi"))
    p = place(marked, F.col("_u"), splits, keys, buckets, "_part")
    lo = F.coalesce(F.get("_s", F.col("_part") - 1), F.col("_lo"))
    hi = F.coalesce(F.get("_s", F.col("_part")), F.col("_hi"))
    spans = F.ceil(F.col("_n") / F.lit(float(buckets * rows)))
    share = (F.col("_u") - lo).cast("double") / (F.greatest(hi - lo, F.lit(0)) + 1)
    span = F.least(F.floor(share * spans), spans - 1)
    return p.withColumn(out, F.col("_part").cast("long") * F.lit(1 << 32) + span).drop("_u", "_s", "_n", "_lo", "_hi", "_x", "_part")


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float], keys: Sequence[str], buckets: int = 512) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per name in ``probs``."""
    keys = list(keys)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    splits = counts.groupBy(*keys).agg(cut_points("_x", buckets).alias("_s"), F.sum("_c").alias("_n"))
    placed = place(counts.withColumnRenamed("_x", "_v"), F.col("_v"), splits, keys, buckets).drop("_s", "_x").withColumnRenamed("_v", "_x")
    sums = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_cb"), F.max("_n").alias("_n"))
    before = F.coalesce(F.sum("_cb").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_off", before)
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos")) for n, p in probs.items()])
    lo, hi = (lambda w: F.floor(w["pos"])), (lambda w: F.ceil(w["pos"]))
    inside = lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_cb"))
    needed = sums.withColumn("_w", F.filter(wanted, lambda w: inside(lo(w)) | inside(hi(w)))).filter(F.size("_w") > 0)
    rows = placed.drop("_n").join(needed.select(*keys, "_b", "_off", "_w"), [*keys, "_b"])
    w = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.col("_off") + F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    hits = rows.withColumn("_t", F.explode("_w"))
    at = lambda r: (r >= F.col("_start")) & (r < F.col("_end"))
    pos = F.col("_t.pos")
    ends = hits.groupBy(*keys, F.col("_t.name").alias("_name")).agg(
        F.max(F.when(at(F.floor(pos)), F.col("_x"))).alias("_lo"), F.max(F.when(at(F.ceil(pos)), F.col("_x"))).alias("_hi"), F.max(pos).alias("_p")
    )
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_p") - F.floor("_p"))
    return ends.withColumn("_v", value).groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in probs])
