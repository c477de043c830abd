"""Lead/lag correlation: tables over lags, best lags, rolling selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strandline.frames import KEYS, ordered, trailing, whole
from strandline.functions.scalar import corr_from, div


def _lag_array(df: DataFrame, x: str, max_lag: int, keys: Sequence[str], order: str) -> Column:
    """Array whose element k is (ts, x) k rows earlier; shorter at the start of a series."""
    w = ordered(keys, order).rowsBetween(-max_lag, 0)
    return F.reverse(F.collect_list(F.struct(F.col(order).alias("t"), F.col(x).alias("x"))).over(w))


def lag_correlations(df: DataFrame, lags: Sequence[int], y: str = "y", x: str = "x", keys: Sequence[str] = ("pair",), order: str = "ts", starts: Sequence[str] | None = None) -> DataFrame:
    """corr(y_t, x_{t-k}) per key and lag, optionally for several sample start dates.

    The panel is ordered once.  Lags (and start dates) are exploded right before a
    partial aggregate in the same stage, so the n x K pairs never shuffle.
    With a start date both rows of a pair must lie in the sample.
    """
    rows = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    base = rows.withColumn("_a", _lag_array(rows, x, max(lags), keys, order))
    pairs = base.select(*keys, F.col(y).alias("_y"), F.posexplode("_a").alias("lag", "_p")).filter(F.col("lag").isin(list(lags)))
    group = [*keys, "lag"]
    if starts is not None:
        options = F.array(*[F.lit(s).cast("date") for s in starts])
        pairs = pairs.withColumn("start", F.explode(F.filter(options, lambda s: s <= F.col("_p.t"))))
        group.append("start")
    return pairs.groupBy(*group).agg(corr_from(F.col("_y"), F.col("_p.x")).alias("rho"), F.count("*").alias("n"))


def both_directions(df: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Correlations with x leading (k >= 0) and, as negative lags, with y leading."""
    ahead = lag_correlations(df, lags, keys=keys)
    swapped = df.select(*keys, "ts", F.col("x").alias("y"), F.col("y").alias("x"))
    behind = lag_correlations(swapped, [k for k in lags if k > 0], keys=keys).withColumn("lag", -F.col("lag"))
    return ahead.unionByName(behind)


def best_lag(table: DataFrame, keys: Sequence[str] = ("pair",), by: str = "abs") -> DataFrame:
    """Lag with the largest (absolute) correlation; the smallest lag wins ties."""
    score = {"abs": F.abs("rho"), "max": F.col("rho"), "min": -F.col("rho")}[by]
    pick = F.max(F.struct(score.alias("s"), (-F.col("lag")).alias("k"), F.col("rho").alias("rho")))
    best = table.filter(F.col("rho").isNotNull()).groupBy(*keys).agg(pick.alias("_b"))
    return best.select(*keys, (-F.col("_b.k")).alias("best_lag"), F.col("_b.rho").alias("best_rho"))


def information_from_corr(rho: Column) -> Column:
    """1 - sqrt(1 - rho^2), clamped against rounding above one."""
    return 1.0 - F.sqrt(F.greatest(F.lit(0.0), 1.0 - rho * rho))


def rolling_best_lag(df: DataFrame, n: int, lags: Sequence[int], y: str = "y", x: str = "x", keys: Sequence[str] = ("pair",), by: str = "abs", complete_only: bool = False) -> DataFrame:
    """Per row, the lag with the best correlation over the last n rows and the driver to use next.

    Lagged pairs must both lie in the window, so lag k has n - k pairs.  ``driver``
    is the value that leads the next row by the chosen lag.  All frames share one sort.
    """
    if min(lags) < 1 or max(lags) >= n - 1:
        raise ValueError("lags must be at least 1 and leave two pairs in the window")
    w = ordered(keys)
    base = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    base = base.select("*", *[F.lag(x, k).over(w).alias(f"_x{k}") for k in lags], F.count("*").over(trailing(n, keys)).alias("_n"))
    cors = [corr_from(F.col(y), F.col(f"_x{k}"), trailing(n - k, keys)) for k in lags]
    drivers = F.array(*[F.lag(x, k - 1).over(w) if k > 1 else F.col(x) for k in lags])
    base = base.withColumn("_c", F.when(F.col("_n") == n, F.array(*cors))).withColumn("_d", drivers)
    if complete_only:
        base = base.filter(F.col("_n") == n)
    score = {"abs": lambda c: F.abs(c), "max": lambda c: c, "min": lambda c: -c, "least": lambda c: -F.abs(c)}[by]
    scores = F.transform("_c", score)
    base = base.withColumn("_i", F.array_position(scores, F.array_max(scores)).cast("int"))
    known = F.col("_i") > 0
    return base.select(
        *df.columns,
        F.when(known, F.get(F.array(*[F.lit(int(k)) for k in lags]), F.col("_i") - 1)).alias("best_lag"),
        F.when(known, F.get("_c", F.col("_i") - 1)).alias("best_rho"),
        F.when(known, F.get("_d", F.col("_i") - 1)).alias("driver"),
    )


def autocorrelation(df: DataFrame, col: str, lags: Sequence[int], keys=KEYS) -> DataFrame:
    """Sample autocorrelations, all with the full-sample mean and variance."""
    w, x = ordered(keys), F.col(col)
    base = df.filter(x.isNotNull()).withColumn("_c", x - F.avg(x).over(whole(keys)))
    base = base.select("*", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in lags])
    s = base.groupBy(*keys).agg(F.sum(F.col("_c") * F.col("_c")).alias("_v"), *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in lags])
    rows = F.array(*[F.struct(F.lit(int(k)).alias("lag"), div(F.col(f"_s{k}"), F.col("_v")).alias("acf")) for k in lags])
    return s.select(*keys, F.inline(rows))


def correlation_matrix(df: DataFrame, names: Sequence[str], col: str = "value") -> DataFrame:
    """Correlation and covariance (i, j) of named series on common dates, in one aggregate.

    For hundreds of columns use ``ml.correlation_matrix_ml`` instead.
    """
    wide = df.filter(F.col("series_id").isin(list(names))).groupBy("ts").pivot("series_id", list(names)).agg(F.first(col, ignorenulls=True))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    c = lambda s: F.col(f"`{s}`")
    one = wide.agg(*[e for k, (a, b) in enumerate(pairs) for e in (corr_from(c(a), c(b)).alias(f"r{k}"), F.covar_samp(c(a), c(b)).alias(f"c{k}"))])
    rows = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"r{k}").alias("corr"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))
