"""Forecasters at every origin, as columns of one panel pass."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from strandline.frames import KEYS, expanding, ordered, trailing
from strandline.functions.scalar import div
from strandline.operators.window import kinematics, stat


def _z(alpha: float) -> float:
    return NormalDist().inv_cdf(1.0 - alpha / 2.0)


def no_change(df: DataFrame, col: str, h: int, n: int, alpha: float = 0.05, keys=KEYS) -> DataFrame:
    """Last value, with a band from the deviation of recent changes growing with sqrt(h)."""
    v = F.col(col) - F.lag(col).over(ordered(keys))
    base = df.withColumn("_v", v)
    half = _z(alpha) * stat("std", F.col("_v"), trailing(n, keys), n) * h**0.5
    return base.select(*df.columns, F.col(col).alias("forecast"), (F.col(col) - half).alias("lower"), (F.col(col) + half).alias("upper"))


def rolling_mean_forecast(df: DataFrame, col: str, n: int, alpha: float = 0.05, keys=KEYS) -> DataFrame:
    x, w = F.col(col), trailing(n, keys)
    mean = stat("mean", x, w, n)
    half = _z(alpha) * stat("std", x, w, n) / n**0.5
    return df.select("*", mean.alias("forecast"), (mean - half).alias("lower"), (mean + half).alias("upper"))


def ar1(df: DataFrame, col: str, h: int, n: int | None = None, alpha: float = 0.05, keys=KEYS, min_rows: int = 10) -> DataFrame:
    """First-order autoregression per origin, h steps ahead with a band.

    |phi| of .999 or more is treated as a random walk with drift; origins with
    fewer than ``min_rows`` rows repeat the last value.  A window of n rows
    holds n - 1 pairs of neighbours.
    """
    x, lag = F.col(col), F.col("_l")
    base = df.withColumn("_l", F.lag(col).over(ordered(keys)))
    w = trailing(n - 1, keys) if n else expanding(keys)
    rows = F.count(x).over(trailing(n, keys) if n else expanding(keys))
    both = F.when(lag.isNotNull(), x)
    base = base.select(
        "*", F.regr_slope(both, lag).over(w).alias("phi"), F.regr_intercept(both, lag).over(w).alias("c"), F.count(both).over(w).alias("_m"),
        F.var_pop(F.when(both.isNotNull(), both)).over(w).alias("_sy"), F.covar_pop(both, lag).over(w).alias("_sxy"), rows.alias("_rows"),
    )
    phi, c = F.col("phi"), F.col("c")
    s2 = div(F.col("_m") * F.greatest(F.lit(0.0), F.col("_sy") - phi * F.col("_sxy")), F.col("_m") - 2)
    calm = F.abs(phi) < 0.999
    mu = div(c, 1.0 - phi)
    point = F.when(calm, mu + F.pow(phi, F.lit(float(h))) * (x - mu)).otherwise(x + h * c)
    # sum of phi^(2i), i < h, written out: no division by 1 - phi^2
    var = F.when(calm, s2 * sum((F.pow(phi, F.lit(float(2 * i))) for i in range(1, h)), F.lit(1.0))).otherwise(s2 * h)
    known = F.col("_rows") >= (max(n, min_rows) if n else min_rows)
    half = _z(alpha) * F.sqrt(F.greatest(var, F.lit(1e-10)))
    out = base.withColumn("forecast", F.when(known & phi.isNotNull(), point).when(F.col("_rows") < min_rows, x)).withColumn("_h", F.when(known, half))
    return out.select(*df.columns, "phi", "forecast", (F.col("forecast") - F.col("_h")).alias("lower"), (F.col("forecast") + F.col("_h")).alias("upper"))


def _kinematic_point(col: str, h: int) -> Column:
    y, k = F.col(col), F.col("coherence")
    strong = y + h * k * F.col("velocity") + h * (h + 1) / 2.0 * F.col("acceleration")
    return F.when(F.col("regime") == "momentum", strong).otherwise(y + 0.5 * h * k * F.col("velocity"))


def kinematic(df: DataFrame, col: str, h: int, w_v: int = 5, w_a: int = 3, alpha: float = 0.05, width: float = 1.5, keys=KEYS) -> DataFrame:
    """Extrapolate velocity and acceleration; coherence scales the step and the band."""
    base = kinematics(df, col, w_v, w_a, keys)
    half = _z(alpha) * F.col("dispersion") * h**0.5 * width * (1.0 + 0.5 * (1.0 - F.col("coherence")))
    out = base.withColumn("forecast", F.when(F.col("velocity").isNotNull(), _kinematic_point(col, h)))
    return out.withColumn("lower", F.col("forecast") - half).withColumn("upper", F.col("forecast") + half)


def mean_reverting(df: DataFrame, col: str, h: int, strategy: str = "fixed", lam: float = 0.2, mean_window: int = 30, keys=KEYS, **kw) -> DataFrame:
    """Blend of the kinematic forecast and a rolling mean with weight lambda.

    ``fixed`` uses lam, ``coherence`` lam * (1 - coherence), ``acf`` one minus the
    mean absolute autocorrelation of the window at lags 1-5, kept within .05 and .5.
    """
    base = kinematic(df, col, h, keys=keys, **kw)
    x, w = F.col(col), trailing(mean_window, keys)
    mu = stat("mean", x, w, mean_window)
    if strategy == "fixed":
        weight = F.lit(lam)
    elif strategy == "coherence":
        weight = lam * (1.0 - F.col("coherence"))
    elif strategy == "acf":
        base = base.withColumn("_a", F.when(F.count(x).over(w) == mean_window, F.collect_list(x).over(w)))
        base = base.withColumn("_c", F.transform("_a", lambda v: v - F.aggregate("_a", F.lit(0.0), lambda s, u: s + u) / mean_window))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        c0 = dot(F.col("_c"), F.col("_c"))
        acf = [F.abs(div(dot(F.slice("_c", 1, mean_window - k), F.slice("_c", k + 1, mean_window - k)), c0)) for k in range(1, 6)]
        weight = F.coalesce(F.least(F.lit(0.5), F.greatest(F.lit(0.05), 1.0 - sum(acf, F.lit(0.0)) / 5.0)), F.lit(0.3))
    else:
        raise ValueError(f"unknown blending strategy {strategy!r}")
    base = base.withColumn("lambda", weight).withColumn("_mu", mu)
    lam_c = F.col("lambda")
    half = 0.5 * (F.col("upper") - F.col("lower")) * (1.0 - 0.3 * lam_c)
    point = (1.0 - lam_c) * F.col("forecast") + lam_c * F.col("_mu")
    out = base.withColumn("_p", point).withColumn("_h", half)
    keep = [c for c in base.columns if not c.startswith("_") and c not in ("forecast", "lower", "upper")]
    return out.select(*keep, F.col("_p").alias("forecast"), (F.col("_p") - F.col("_h")).alias("lower"), (F.col("_p") + F.col("_h")).alias("upper"))


def ensemble(df: DataFrame, col: str, h: int, configs: Sequence[tuple[int, int]] = ((3, 2), (5, 3), (7, 3), (10, 5)), alpha: float = 0.05, width: float = 2.0, keys=KEYS) -> DataFrame:
    """Median of several kinematic configurations, all frames in one sort, combined inside the row."""
    out = df
    rows = []
    for w_v, w_a in configs:
        tag = f"_{w_v}_{w_a}"
        k = kinematic(out, col, h, w_v, w_a, alpha, 1.0, keys)
        s = F.struct(F.col("forecast").alias("f"), (F.col("upper") - F.col("lower")).alias("w"), F.col("coherence").alias("k"), F.col("regime").alias("r"))
        out = k.withColumn(tag, s).drop("v", "a", "velocity", "acceleration", "coherence", "dispersion", "regime", "forecast", "lower", "upper")
        rows.append(F.col(tag))
    m = len(configs)
    ready = F.lit(True)
    for c in rows:
        ready = ready & c["f"].isNotNull()
    out = out.withColumn("_e", F.when(ready, F.array(*rows)))
    fs = F.array_sort(F.transform("_e", lambda e: e["f"]))
    median = (F.get(fs, (m - 1) // 2) + F.get(fs, m // 2)) / 2.0
    mean = lambda name: F.aggregate("_e", F.lit(0.0), lambda s, e: s + e[name]) / m
    out = out.withColumn("forecast", median).withColumn("_mean", mean("f"))
    sd = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda s, e: s + (e["f"] - F.col("_mean")) * (e["f"] - F.col("_mean"))) / m)
    half = F.greatest(mean("w"), 2.0 * _z(alpha) * sd) * width / 2.0
    votes = F.size(F.filter("_e", lambda e: e["r"] == "momentum"))
    return out.select(
        *df.columns, "forecast", (F.col("forecast") - half).alias("lower"), (F.col("forecast") + half).alias("upper"), mean("k").alias("coherence"),
        F.when(F.col("_e").isNotNull(), F.when(2 * votes >= m, "momentum").otherwise("reversal")).alias("regime"),
    )


def error_weighted(df: DataFrame, actual: str, a: str, b: str, warmup: int = 10, keys=KEYS) -> DataFrame:
    """Combine two forecasts of the row with weights exp(-MSE) of their earlier errors."""
    w = expanding(keys, delay=1)
    ea, eb = F.col(actual) - F.col(a), F.col(actual) - F.col(b)
    ma, mb = F.avg(ea * ea).over(w), F.avg(eb * eb).over(w)
    weight = F.when(F.count(ea + eb).over(w) >= warmup, 1.0 / (1.0 + F.exp(ma - mb))).otherwise(0.5)
    return df.withColumn("weight", weight).withColumn("combined", F.col("weight") * F.col(a) + (1.0 - F.col("weight")) * F.col(b))


def switch_models(df: DataFrame, n: int, keys: Sequence[str] = KEYS, model: str = "model") -> DataFrame:
    """Forecast of whichever model had the best rolling precision one period earlier."""
    from strandline.operators.evaluate import rolling_precision

    p = rolling_precision(df, n, [*keys, model]).filter(F.col("precision").isNotNull())
    best = p.groupBy(*keys, "ts").agg(F.max(F.struct(F.round("precision", 12).alias("p"), F.col(model).alias("m"))).alias("b"))
    prior = best.select(*keys, "ts", F.lag(F.col("b.m")).over(ordered(keys)).alias("chosen"))
    return df.join(prior, [*keys, "ts"]).filter(F.col(model) == F.col("chosen"))


def subsample_forecasts(df: DataFrame, col: str, h: int, shares: Sequence[float] = (0.25, 0.5, 0.75, 1.0), keys=KEYS) -> DataFrame:
    """AR(1) forecasts h steps past the end from the last share of each series."""
    w = ordered(keys)
    n = F.count("*").over(w.rowsBetween(*_ALL))
    base = df.filter(F.col(col).isNotNull()).withColumn("_r", F.row_number().over(w)).withColumn("_n", n).withColumn("_l", F.lag(col).over(w))
    opts = F.array(*[F.lit(float(s)) for s in shares])
    rows = base.withColumn("share", F.explode(opts)).withColumn("_size", F.floor(F.col("share") * F.col("_n")))
    rows = rows.filter(F.col("_r") > F.col("_n") - F.col("_size"))
    # the first row of a sub-sample has no predecessor inside it
    pair = F.when(F.col("_r") > F.col("_n") - F.col("_size") + 1, F.col("_l"))
    rows = rows.withColumn("_l", pair)
    y = F.when(F.col("_l").isNotNull(), F.col(col))
    fit = rows.groupBy(*keys, "share").agg(
        F.regr_slope(y, F.col("_l")).alias("phi"), F.regr_intercept(y, F.col("_l")).alias("c"), F.max_by(col, "ts").alias("last"), F.count("*").alias("n")
    )
    mu = div(F.col("c"), 1.0 - F.col("phi"))
    calm = F.abs(F.col("phi")) < 0.999
    f = F.when(calm, mu + F.pow("phi", F.lit(float(h))) * (F.col("last") - mu)).otherwise(F.col("last") + h * F.col("c"))
    return fit.withColumn("forecast", f).drop("c", "last")


from pyspark.sql.window import Window  # noqa: E402

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
