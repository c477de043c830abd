"""Analogue forecasts: find past patterns near the latest one and use what followed.

There is one query pattern per series, so a search costs one distance per row.
Spans around neighbours come from prefix sums and equality joins on the row
index; no pair of rows inside a series is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import KEYS, ordered
from strandline.functions.scalar import div, iterated_log, literal_array
from strandline.operators.align import bounded_broadcast
from strandline.operators.window import delay_embedding


def distance(a: Column, b: Column, p: float) -> Column:
    """L_p distance of two arrays; p = 0 and p = 1 give the sum of absolute differences."""
    q = 1.0 if p == 0 else float(p)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(q)) if q != 1.0 else F.abs(x - y)), F.lit(0.0), lambda s, d: s + d)
    return total if q == 1.0 else F.pow(total, F.lit(1.0 / q))


def matches(a: Column, b: Column) -> Column:
    """Number of positions where both patterns are non-zero."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) & (y != 0)).cast("int")), F.lit(0), lambda s, d: s + d)


def nearest_patterns(df: DataFrame, pattern: str, p: float = 2.0, share: float | None = None, k: int | None = None, step: int = 1, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """Earlier patterns ranked by closeness to the last one of their key.

    ``k`` keeps a fixed number, cut on the map side before the shuffle; ``share``
    keeps that part of the sample.  With p < 0 closeness is the number of matching
    non-zero positions, of which at least -p are required.  ``step`` keeps every
    step-th neighbour.
    """
    if (share is None) == (k is None):
        raise ValueError("give either share or k")
    last = df.groupBy(*keys).agg(F.max_by(pattern, order).alias("_q"), F.max(order).alias("_end"), (F.count("*") - 1).alias("_n"))
    j = df.join(bounded_broadcast(last), list(keys)).filter(F.col(order) < F.col("_end"))
    if p < 0:
        j = j.withColumn("score", matches(F.col(pattern), F.col("_q")).cast("double")).filter(F.col("score") >= -p)
        by = F.col("score").desc()
        total = F.count("*").over(Window.partitionBy(*keys)) if share is not None else None
    else:
        j = j.withColumn("score", distance(F.col(pattern), F.col("_q"), p))
        by = F.col("score")
        total = F.col("_n")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(by, F.col(order)))
    ranked = j.withColumn("rank", rank)
    if k is not None:
        kept = ranked.filter(F.col("rank") <= k)
    else:
        limit = F.floor(total * F.lit(float(share))) + (1 if p < 0 else 0)
        kept = ranked.withColumn("_m", limit).filter(F.col("rank") <= F.col("_m"))
    return kept.filter((F.col("rank") - 1) % step == 0).drop("_q", "_end", "_n", "_m")


def neighbour_forecast(panel: DataFrame, neighbours: DataFrame, col: str, span: float = 0.2, how: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean over neighbours of a value, a span mean, or a local autoregression.

    ``panel`` holds ``idx`` (row number from zero) and ``neighbours`` the same
    index.  ``how`` is None (the value itself), center, forward, backward or regress;
    the span is that share of the series' length.
    """
    if how is None:
        return neighbours.groupBy(*keys).agg(F.avg(col).alias("forecast"), F.count("*").alias("neighbours"))
    if how not in ("center", "forward", "backward", "regress"):
        raise ValueError(f"unknown neighbour forecast {how!r}")
    w = ordered(keys, "idx")
    every = Window.partitionBy(*keys)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    base = panel.filter(F.col(col).isNotNull()).withColumn("_n", F.count("*").over(every)).withColumn("_mean", F.avg(col).over(every))
    base = base.withColumn("_c", F.col(col) - F.col("_mean")).withColumn("_next", F.lead("_c").over(w))
    prefix = base.select(
        *keys, (F.col("idx") + 1).alias("_e"), F.sum("_c").over(run).alias("s"), F.sum(F.col("_c") * F.col("_c")).over(run).alias("s2"),
        F.sum(F.coalesce(F.col("_c") * F.col("_next"), F.lit(0.0))).over(run).alias("sl"),
    )
    facts = base.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max("_mean").alias("_mean"), F.max_by(col, "idx").alias("_last"))
    nb = neighbours.select(*keys, "idx").join(bounded_broadcast(facts), list(keys))
    reach = F.floor(F.col("_n") * F.lit(float(span)))
    lo = F.greatest(F.lit(0), F.col("idx") - reach) if how in ("center", "backward") else F.col("idx")
    hi = F.col("idx") if how == "backward" else F.least(F.col("idx") + reach, F.col("_n"))
    nb = nb.withColumn("_lo", lo).withColumn("_hi", hi)

    def at(d: DataFrame, edge: str, tag: str) -> DataFrame:
        renamed = prefix.select(*keys, F.col("_e").alias(edge), *[F.col(c).alias(f"{c}_{tag}") for c in ("s", "s2", "sl")])
        return d.join(renamed, [*keys, edge], "left")

    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    j = at(at(nb, "_lo", "a"), "_hi", "b")
    m = F.col("_hi") - F.col("_lo")
    mean = F.col("_mean") + div(z("s_b") - z("s_a"), m)
    if how == "regress":
        # pairs (x_t, x_t+1) for t = lo .. hi - 2
        j = at(j.withColumn("_h1", F.col("_hi") - 1), "_h1", "c")
        j = at(j.withColumn("_l1", F.col("_lo") + 1), "_l1", "d")
        k = m - 1
        sx, sxx, sxy = z("s_c") - z("s_a"), z("s2_c") - z("s2_a"), z("sl_c") - z("sl_a")
        sy = z("s_b") - z("s_d")
        slope = div(sxy - sx * sy / k, sxx - sx * sx / k)
        line = F.col("_mean") + sy / k + slope * (F.col("_last") - F.col("_mean") - sx / k)
        value = F.when(m > 3, line).otherwise(mean)
    else:
        value = F.when(m > 0, mean)
    return j.groupBy(*keys).agg(F.avg(value).alias("forecast"), F.count("*").alias("neighbours"))


def _followers(df: DataFrame, col: str, width: int, h: int, keys: Sequence[str]) -> DataFrame:
    """Each row with the ``width`` values that start there and the ``h`` values after them."""
    w = ordered(keys).rowsBetween(0, width + h - 1)
    base = df.filter(F.col(col).isNotNull()).withColumn("_a", F.collect_list(col).over(w))
    return base.withColumn("pattern", F.slice("_a", 1, width)).withColumn("path", F.slice("_a", width + 1, h)).drop("_a")


def _summarise(chosen: DataFrame, keys: Sequence[str], divisor: Column) -> DataFrame:
    steps = chosen.select(*keys, F.posexplode("path").alias("step", "_v"))
    s = steps.groupBy(*keys, (F.col("step") + 1).alias("step")).agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("_sd"), F.count("*").alias("paths"))
    se = F.col("_sd") / F.sqrt(divisor)
    return s.select(*keys, "step", "mean", (F.col("mean") - 2 * se).alias("lower"), (F.col("mean") + 2 * se).alias("upper"), "paths")


def peak_path(df: DataFrame, col: str, width: int, h: int, k: int, first_point_only: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean path after the k windows, each starting at its own peak, nearest to the last window.

    Candidate windows end before the last window starts and have h values after them.
    """
    base = _followers(df, col, width, h, keys)
    base = base.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"))))
    last = base.filter(F.col("_back") == width).select(*keys, F.col("pattern").alias("_q"))
    ok = (F.size("path") == h) & (F.col("_back") >= 2 * width)
    peak = F.forall(F.slice("pattern", 2, width - 1), lambda v: v < F.get("pattern", F.lit(0)))
    cand = base.filter(ok).filter(peak).join(bounded_broadcast(last), list(keys))
    d = F.abs(F.get("pattern", F.lit(0)) - F.get("_q", F.lit(0))) if first_point_only else distance(F.col("pattern"), F.col("_q"), 2.0)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "ts"))
    near = cand.withColumn("distance", d).withColumn("rank", rank).filter(F.col("rank") <= k)
    return _summarise(near, keys, F.col("paths"))


def _nearest_values(df: DataFrame, col: str, h: int, k: int, keys: Sequence[str]) -> DataFrame:
    base = _followers(df, col, 1, h, keys)
    last = base.groupBy(*keys).agg(F.max("ts").alias("_end"), F.max_by(col, "ts").alias("_v"))
    cand = base.join(bounded_broadcast(last), list(keys)).filter(F.col("ts") < F.col("_end"))
    cand = cand.withColumn("distance", F.abs(F.col(col) - F.col("_v")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "ts"))
    return cand.withColumn("rank", rank).filter(F.col("rank") <= k)


def value_path(df: DataFrame, col: str, h: int, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the h values that followed the k rows nearest to the last value; short paths are dropped."""
    near = _nearest_values(df, col, h, k, keys).filter(F.size("path") == h)
    return _summarise(near, keys, F.lit(float(k)))


def complexity_path(df: DataFrame, col: str, h: int, scheme: str = "prior", keys: Sequence[str] = KEYS) -> DataFrame:
    """Path of the h nearest rows, neighbour j weighted equally, 2^-j or 2^-log*(j).

    Weights of neighbours whose path has ended still count in the divisor.
    """
    if scheme == "equal":
        weights = None
    else:
        exponent = {"complexity": lambda j: j, "prior": iterated_log}[scheme]
        weights = [2.0 ** -exponent(j) for j in range(1, h + 1)]
    near = _nearest_values(df, col, h, h, keys)
    steps = near.select(*keys, "rank", F.posexplode("path").alias("step", "_v"))
    if weights is None:
        value = F.avg("_v")
    else:
        value = F.sum(F.get(literal_array(weights), F.col("rank") - 1) * F.col("_v")) / sum(weights)
    return steps.groupBy(*keys, (F.col("step") + 1).alias("step")).agg(value.alias("forecast"), F.count("*").alias("paths"))


def patterns_with_index(df: DataFrame, col: str, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows with value numbered from zero (``idx``), with their trailing pattern where complete."""
    rows = df.filter(F.col(col).isNotNull()).withColumn("idx", F.row_number().over(ordered(keys)) - 1)
    return delay_embedding(rows, col, k, keys)
