"""Rolling, expanding and block operators.

All trailing operators need only the rows of their frame, so on long series they
run unchanged on ``segment.segmented`` input with ``keys=SEG_KEYS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from strandline.frames import KEYS, expanding, full_only, ordered, trailing
from strandline.functions.scalar import corr_from, div, weighted_sum, window_weights

_SIMPLE = {
    "mean": F.avg,
    "sum": F.sum,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
}


def stat(name: str, x: Column, w: WindowSpec, n: int) -> Column:
    """One rolling statistic over a full window of n non-null values."""
    if name == "count":
        return F.count(x).over(w)
    if name == "compound":
        return full_only(F.product(1.0 + x).over(w) - 1.0, x, w, n)
    if name == "median":
        return full_only(F.percentile(x, F.lit(0.5)).over(w), x, w, n)
    if name not in _SIMPLE:
        raise ValueError(f"unknown rolling statistic {name!r}")
    return full_only(_SIMPLE[name](x).over(w), x, w, n)


def rolling(df: DataFrame, col: str, n: int, stats: Sequence[str], keys=KEYS, delay: int = 0, prefix: str = "") -> DataFrame:
    w = trailing(n, keys, delay=delay)
    return df.select("*", *[stat(s, F.col(col), w, n).alias(f"{prefix}{s}") for s in stats])


def expanding_stats(df: DataFrame, col: str, keys=KEYS, quantile: float | None = None) -> DataFrame:
    from strandline.operators.ranked import expanding_quantiles

    w = expanding(keys)
    out = df.select("*", F.avg(col).over(w).alias("mean"), F.sum(col).over(w).alias("sum"))
    return out if quantile is None else expanding_quantiles(out, {col: "quantile"}, quantile, keys)


def momentum(df: DataFrame, n: int, ret: str = "ret", keys=KEYS) -> DataFrame:
    return df.withColumn("momentum", stat("compound", F.col(ret), trailing(n, keys), n))


def rolling_quantile(df: DataFrame, col: str, n: int, q: float, keys=KEYS, out: str = "quantile") -> DataFrame:
    w = trailing(n, keys)
    return df.withColumn(out, full_only(F.percentile(F.col(col), F.lit(q)).over(w), F.col(col), w, n))


def rolling_shape(df: DataFrame, col: str, n: int, keys=KEYS) -> DataFrame:
    """Skewness and excess kurtosis: population moments, and the bias-corrected sample form."""
    x, w = F.col(col), trailing(n, keys)
    g1, g2 = F.skewness(x).over(w), F.kurtosis(x).over(w)
    sample_skew = (n * (n - 1)) ** 0.5 / (n - 2) * g1 if n > 2 else F.lit(None).cast("double")
    sample_kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 else F.lit(None).cast("double")
    cols = {"skew": g1, "kurt": g2, "sample_skew": sample_skew, "sample_kurt": sample_kurt}
    return df.select("*", *[full_only(c, x, w, n).alias(k) for k, c in cols.items()])


def rolling_corr(df: DataFrame, x: str, y: str, n: int, lag: int = 0, keys=KEYS, out: str = "corr") -> DataFrame:
    """Correlation of x with y lagged; needs n complete pairs."""
    base = df.withColumn("_y", F.lag(y, lag).over(ordered(keys)) if lag else F.col(y))
    w = trailing(n, keys)
    both = F.when(F.col("_y").isNotNull(), F.col(x))
    return base.withColumn(out, full_only(corr_from(F.col(x), F.col("_y"), w), both, w, n)).drop("_y")


def rolling_drawdown(df: DataFrame, n: int, price: str = "value", keys=KEYS) -> DataFrame:
    """Largest drop from the rolling maximum in the window, partial windows allowed."""
    w = trailing(n, keys)
    base = df.withColumn("_dd", div(F.col(price), F.max(price).over(w)) - 1.0)
    return base.withColumn("max_drawdown", F.abs(F.min("_dd").over(w))).drop("_dd")


def equity(df: DataFrame, ret: str = "ret", keys=KEYS, order: str = "ts") -> DataFrame:
    """Wealth of one unit and its drop from the running peak.

    On segmented long series use ``segment.running`` for the same columns.
    """
    w = expanding(keys, order)
    base = df.withColumn("wealth", F.product(1.0 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))
    return base.withColumn("drawdown", div(F.col("wealth"), F.max("wealth").over(w)) - 1.0)


def power_weighted_mean(df: DataFrame, col: str, n: int, alpha: float, keys=KEYS, out: str = "weighted_mean") -> DataFrame:
    """Rolling mean with weights 1^alpha .. n^alpha, newest heaviest."""
    w, x = trailing(n, keys), F.col(col)
    total = sum(float(i) ** alpha for i in range(1, n + 1))
    dot = weighted_sum("_a", (float(i) ** alpha for i in range(1, n + 1)))
    base = df.withColumn("_a", full_only(F.collect_list(x).over(w), x, w, n))
    return base.withColumn(out, dot / total).drop("_a")


def finite_memory_mean(df: DataFrame, col: str, n: int, decay: float, keys=KEYS, out: str = "memory_mean") -> DataFrame:
    """Exponentially weighted mean over the last n values, newest weight 1."""
    w, x = trailing(n, keys), F.col(col)
    total = sum(decay ** (n - i) for i in range(1, n + 1))
    dot = weighted_sum("_a", (decay ** (n - i) for i in range(1, n + 1)))
    base = df.withColumn("_a", full_only(F.collect_list(x).over(w), x, w, n))
    return base.withColumn(out, dot / total).drop("_a")


def multi_window_mean(df: DataFrame, col: str, windows: Sequence[int], scheme: str, keys=KEYS, out: str = "mean") -> DataFrame:
    """Weighted sum of rolling means over several windows; unfilled windows contribute nothing."""
    x, total = F.col(col), F.lit(0.0)
    for n, weight in window_weights(windows, scheme).items():
        total = total + F.lit(weight) * F.coalesce(stat("mean", x, trailing(n, keys), n), F.lit(0.0))
    return df.withColumn(out, total)


def martingale_gain(df: DataFrame, col: str, windows: Sequence[int], scheme: str, keys=KEYS, out: str = "gain") -> DataFrame:
    """Twice the value times the previous rolling sum, weighted over windows."""
    x, total = F.col(col), F.lit(0.0)
    for n, weight in window_weights(windows, scheme).items():
        before = stat("sum", x, trailing(n, keys, delay=1), n)
        total = total + weight * F.coalesce(2.0 * x * before, F.lit(0.0))
    return df.withColumn(out, total)


def cross_moment_gain(df: DataFrame, col: str, windows: Sequence[int], scheme: str, lags: int = 3, keys=KEYS, out: str = "gain") -> DataFrame:
    """Twice the rolling mean of summed products with the first ``lags`` lags, weighted over windows."""
    x, w = F.col(col), ordered(keys)
    products = F.lit(0.0)
    for j in range(1, lags + 1):
        products = products + F.coalesce(x * F.lag(x, j).over(w), F.lit(0.0))
    base = df.withColumn("_m", products)
    total = F.lit(0.0)
    for n, weight in window_weights(windows, scheme).items():
        total = total + weight * F.coalesce(2.0 * stat("mean", F.col("_m"), trailing(n, keys), n), F.lit(0.0))
    return base.withColumn(out, total).drop("_m")


def runs_ratio(df: DataFrame, col: str, n: int, keys=KEYS, out: str = "runs_ratio") -> DataFrame:
    """Share of runs p in the last n signs, as p / (1 - p)."""
    w, x = ordered(keys), F.col(col)
    base = df.withColumn("_c", (x != F.lag(x).over(w)).cast("int"))
    inside = w.rowsBetween(-(n - 2), 0)
    p = (F.sum("_c").over(inside) + 1) / F.lit(float(n))
    return base.withColumn(out, full_only(div(p, 1.0 - p), x, trailing(n, keys), n)).drop("_c")


def mean_to_median(df: DataFrame, col: str, n: int, keys=KEYS, delay: int = 0, out: str = "ratio") -> DataFrame:
    x, w = F.col(col), trailing(n, keys, delay=delay)
    mean, median = stat("mean", x, w, n), stat("median", x, w, n)
    return df.withColumn(out, F.when(median == 0, mean).otherwise(div(mean, median)))


def _bins(values: Column, bins: int) -> Column:
    """Equal-width bin of each array element over the array's own range, last bin closed."""
    lo, hi = F.array_min(values), F.array_max(values)
    span = hi - lo
    return F.transform(
        values,
        lambda v: F.when(span == 0, F.lit(bins // 2)).otherwise(
            F.least(F.floor(F.try_divide((v - lo) * bins, span)).cast("int"), F.lit(bins - 1))
        ),
    )


def histogram_entropy(df: DataFrame, col: str, n: int, bins: int, keys=KEYS, bits: bool = False) -> DataFrame:
    """Entropy of the window's histogram and the share of the maximum it leaves unused.

    The array in each row is one window of n values, never a series.
    """
    x, w = F.col(col), trailing(n, keys)
    base = df.withColumn("_b", F.when(F.count(x).over(w) == n, _bins(F.collect_list(x).over(w), bins)))
    counts = F.transform(F.array_distinct("_b"), lambda b: F.size(F.filter(F.col("_b"), lambda v: v == b)).cast("double"))
    log = F.log2 if bits else F.log
    h = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - c / n * log(c / n))
    top = log(F.lit(float(bins)))
    return base.withColumn("entropy", h).withColumn("information", 1.0 - F.col("entropy") / top).drop("_b")


def sample_entropy(df: DataFrame, col: str, n: int, m: int = 2, tolerance: float = 0.2, keys=KEYS, out: str = "sample_entropy") -> DataFrame:
    """-ln(A / B): matching template pairs of length m + 1 over those of length m.

    Pairs are counted inside one window's array of n values and never become
    rows.  A constant window gives 0; no match gives null.
    """
    x, w = F.col(col), trailing(n, keys)
    full = F.count(x).over(w) == n
    base = df.withColumn("_vals", F.when(full, F.collect_list(x).over(w))).withColumn(
        "_tol", F.greatest(F.lit(tolerance) * F.stddev_pop(x).over(w), F.lit(1e-9))
    )

    def matches(length: int) -> Column:
        def close(i: Column, j: Column) -> Column:
            cond = F.lit(True)
            for k in range(length):
                cond = cond & (F.abs(F.get(F.col("_vals"), i + k) - F.get(F.col("_vals"), j + k)) < F.col("_tol"))
            return cond

        starts = F.sequence(F.lit(0), F.lit(n - m - 2))
        return F.aggregate(
            starts,
            F.lit(0),
            lambda acc, i: acc + F.size(F.filter(F.sequence(i + 1, F.lit(n - m - 1)), lambda j: close(i, j))),
        )

    base = base.withColumn("_hits_long", F.when(F.col("_vals").isNotNull(), matches(m + 1))).withColumn(
        "_hits_short", F.when(F.col("_vals").isNotNull(), matches(m))
    )
    ratio = F.when((F.col("_hits_long") > 0) & (F.col("_hits_short") > 0), -F.log(F.try_divide(F.col("_hits_long"), F.col("_hits_short"))))
    return base.withColumn(out, F.when(F.array_max("_vals") == F.array_min("_vals"), 0.0).otherwise(ratio)).drop("_vals", "_tol", "_hits_long", "_hits_short")


def trend(df: DataFrame, col: str, n: int, keys=KEYS) -> DataFrame:
    """Slope on row number and population variance around the line, per window."""
    w, x = trailing(n, keys), F.col(col)
    base = df.withColumn("_t", F.row_number().over(ordered(keys)).cast("double"))
    sxy, sxx, syy = F.covar_pop("_t", x).over(w), F.var_pop("_t").over(w), F.var_pop(x).over(w)
    slope = div(sxy, sxx)
    return base.select("*", full_only(slope, x, w, n).alias("slope"), full_only(syy - slope * sxy, x, w, n).alias("residual_variance")).drop("_t")


def delay_embedding(df: DataFrame, col: str, k: int, keys=KEYS, out: str = "pattern") -> DataFrame:
    """Array of the last k values, oldest first; rows without k values are dropped."""
    w, x = trailing(k, keys), F.col(col)
    return df.withColumn(out, full_only(F.collect_list(x).over(w), x, w, k)).filter(F.col(out).isNotNull())


def error_tail_share(df: DataFrame, col: str, n: int, keys=KEYS) -> DataFrame:
    """Share of the last n errors of the lagged rolling mean that lie at or below minus the mean."""
    x = F.col(col)
    base = df.withColumn("mean", stat("mean", x, trailing(n, keys), n))
    base = base.withColumn("_mu1", F.lag("mean").over(ordered(keys)))
    base = base.withColumn("_e", x - F.col("_mu1"))
    w = trailing(n, keys)
    errors = F.when(F.count("_e").over(w) == n, F.collect_list("_e").over(w))
    share = F.size(F.filter(errors, lambda e: e <= -F.col("_mu1"))) / F.lit(float(n))
    return base.withColumn("tail_share", F.when(errors.isNotNull(), share)).drop("_mu1", "_e")


def negative_share(df: DataFrame, col: str, n: int, alpha: float = 1.0, beta: float = 1.0, keys=KEYS) -> DataFrame:
    """Rolling share of negatives and the beta posterior mean of non-negatives."""
    x, w = F.col(col), trailing(n, keys)
    neg = F.when(x.isNotNull(), (x < 0).cast("double"))
    pos = F.when(x.isNotNull(), (x >= 0).cast("double"))
    return df.select(
        "*",
        full_only(F.avg(neg).over(w), x, w, n).alias("negative_share"),
        full_only((F.sum(pos).over(w) + alpha) / (alpha + beta + n), x, w, n).alias("posterior_mean"),
    )


def past_conditions(df: DataFrame, col: str, k: int, keys=KEYS) -> DataFrame:
    """All positive, all negative, any positive over the k rows before the current one."""
    x, w = F.col(col), ordered(keys).rowsBetween(-k, -1)
    known = F.count(x).over(w) == k
    return df.select(
        "*",
        F.when(known, F.min(x).over(w) > 0).alias("all_up"),
        F.when(known, F.max(x).over(w) < 0).alias("all_down"),
        F.when(known, F.max(x).over(w) > 0).alias("any_up"),
    )


def block_returns(df: DataFrame, n: int, ret: str = "ret", keys=KEYS) -> DataFrame:
    """Compounded return of consecutive blocks of n rows; the last block is dropped, full or not."""
    rn = F.row_number().over(ordered(keys)) - 1
    base = df.filter(F.col(ret).isNotNull()).withColumn("block", F.floor(rn / n))
    blocks = base.groupBy(*keys, "block").agg((F.product(1.0 + F.col(ret)) - 1.0).alias("block_ret"), F.min("ts").alias("ts"))
    last = F.max("block").over(Window.partitionBy(*keys))
    return blocks.withColumn("_l", last).filter(F.col("block") < F.col("_l")).drop("_l")


def reset_blocks(df: DataFrame, n: int, keys=KEYS, order: str = "ts") -> DataFrame:
    """Block number that increases every n rows; use it as a further key for accumulators that restart."""
    return df.withColumn("block", F.floor((F.row_number().over(ordered(keys, order)) - 1) / n))


def centred_mean(df: DataFrame, col: str, n: int, keys=KEYS, out: str = "centred_mean") -> DataFrame:
    """Centred mean over n rows, partial windows allowed."""
    w = ordered(keys).rowsBetween(-(n // 2), n - n // 2 - 1)
    return df.withColumn(out, F.avg(col).over(w))


def flag_spans(df: DataFrame, flag: str, keys=KEYS, open_start: bool = False) -> DataFrame:
    """(start, end) of every run of ones; an open run ends at the last row of the series.

    ``start`` is the first flagged row after an unflagged one, ``end`` the first
    unflagged row after it.  A run that is already open on the first row has no
    observed start and is reported only with ``open_start``, from that row on.
    """
    w = ordered(keys)
    before = F.lag(flag, 1, 0).over(w) if open_start else F.lag(flag).over(w)
    base = df.withColumn("_c", F.col(flag) - before).withColumn("_last", F.max("ts").over(Window.partitionBy(*keys)))
    edges = base.filter(F.col("_c") != 0)
    nxt = F.lead("ts").over(w)
    return (
        edges.withColumn("end", F.coalesce(nxt, F.col("_last")))
        .filter(F.col("_c") == 1)
        .select(*keys, F.col("ts").alias("start"), "end")
    )


def kinematics(df: DataFrame, col: str, w_v: int = 5, w_a: int = 3, keys=KEYS) -> DataFrame:
    """Velocity, acceleration, coherence, dispersion and regime of a series at each row."""
    w = ordered(keys)
    base = df.withColumn("v", F.col(col) - F.lag(col).over(w))
    base = base.withColumn("a", F.col("v") - F.lag("v").over(w))
    wv, wa, v, a = trailing(w_v, keys), trailing(w_a, keys), F.col("v"), F.col("a")
    enough = (F.count(v).over(wv) == w_v) & (F.count(a).over(wa) == w_a)
    return base.select(
        "*",
        F.when(enough, F.avg(v).over(wv)).alias("velocity"),
        F.when(enough, F.avg(a).over(wa)).alias("acceleration"),
        F.when(enough, F.abs(F.avg(F.signum(v)).over(wv))).alias("coherence"),
        F.when(enough, F.stddev_samp(v).over(wv)).alias("dispersion"),
        F.when(enough, F.when((F.signum(v) == F.signum(a)) & (a != 0), "momentum").otherwise("reversal")).alias("regime"),
    )


_SQL = {"mean": "avg({x})", "sum": "sum({x})", "std": "stddev_samp({x})", "var": "var_samp({x})", "min": "min({x})", "max": "max({x})"}


def stat_sql(name: str, col: str, n: int, keys=KEYS, order: str = "ts", delay: int = 0) -> str:
    """SQL text of ``stat``: sweeps with hundreds of frames are parsed far faster than built call by call."""
    end = "CURRENT ROW" if delay == 0 else f"{delay} PRECEDING"
    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `{order}` ROWS BETWEEN {n - 1 + delay} PRECEDING AND {end})"
    x = f"`{col}`"
    if name == "compound":
        body = f"product(1 + {x}) {over} - 1"
    else:
        body = _SQL[name].format(x=x) + " " + over
    return f"CASE WHEN count({x}) {over} = {n} THEN {body} END"


def rolling_rows(df: DataFrame, col: str, windows: Sequence[int], stats: Sequence[str], keep: Sequence[str], keys=KEYS, delay: int = 0) -> DataFrame:
    """Rolling statistics for many window lengths, as rows keyed by ``n``.

    All frames share one sort of the panel; rows multiply only afterwards.
    """
    wide = df.selectExpr("*", *[f"{stat_sql(s, col, n, keys, delay=delay)} AS `_{s}_{n}`" for n in windows for s in stats])
    structs = ", ".join("named_struct('n', " + str(int(n)) + "".join(f", '{s}', `_{s}_{n}`" for s in stats) + ")" for n in windows)
    return wide.selectExpr(*[f"`{k}`" for k in keep], f"inline(array({structs}))")


def sign_rule_rows(df: DataFrame, windows: Sequence[int], delays: Sequence[int], ret: str = "ret", keys=KEYS, order: str = "ts") -> DataFrame:
    """Rolling-mean sign strategy for windows x delays, as rows over the dates all of them cover."""
    pairs = [(n, d) for n in windows for d in delays]
    wide = df.filter(F.col(ret).isNotNull()).selectExpr("*", *[f"signum({stat_sql('mean', ret, n, keys, order, d)}) AS `_s_{n}_{d}`" for n, d in pairs])
    # the longest frame with the longest delay fills last
    ready = wide.filter(F.col(f"_s_{max(windows)}_{max(delays)}").isNotNull())
    structs = ", ".join(f"named_struct('n', {int(n)}, 'delay', {int(d)}, 'strategy', `{ret}` * `_s_{n}_{d}`)" for n, d in pairs)
    return ready.selectExpr(*[f"`{k}`" for k in (*keys, order, ret)], f"inline(array({structs}))")
