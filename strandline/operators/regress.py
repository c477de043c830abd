"""Least squares from sufficient statistics.

Means and covariances are ordinary Spark aggregates, grouped or windowed.  What
is solved per row is a matrix of a few regressors, never data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from strandline.frames import KEYS, expanding, ordered, trailing
from strandline.functions.scalar import div, eliminate


def _moments(y: str, xs: Sequence[str], over: WindowSpec | None) -> list[Column]:
    """Aggregates over rows where y and every x are present."""
    ok = F.col(y).isNotNull()
    for x in xs:
        ok = ok & F.col(x).isNotNull()
    v = lambda c: F.when(ok, F.col(c).cast("double"))
    aggs = {"_n": F.count(F.when(ok, 1)), "_my": F.avg(v(y)), "_syy": F.var_pop(v(y))}
    for i, x in enumerate(xs):
        aggs[f"_m{i}"] = F.avg(v(x))
        aggs[f"_sy{i}"] = F.covar_pop(v(x), v(y))
        for j in range(i, len(xs)):
            aggs[f"_s{i}_{j}"] = F.covar_pop(v(x), v(xs[j])) if i != j else F.var_pop(v(x))
    return [(a.over(over) if over is not None else a).alias(k) for k, a in aggs.items()]


def _solve(df: DataFrame, p: int, keep: str | None = None, min_rows: int = 0) -> DataFrame:
    """Turn moment columns into coef, intercept, se, t, n, rss, sigma, r2 and _inv (inverse of S).

    ``keep`` names an array<boolean>: excluded regressors get zero coefficients.
    """
    k = lambda i: F.col(keep)[i] if keep else F.lit(True)
    s = lambda i, j: F.col(f"_s{min(i, j)}_{max(i, j)}")

    def row(i: int) -> Column:
        left = [F.when(k(i) & k(j), s(i, j)).otherwise(F.lit(1.0 if i == j else 0.0)) for j in range(p)]
        right = [F.when(k(i), F.col(f"_sy{i}")).otherwise(0.0)]
        return F.array(*left, *right, *[F.lit(1.0 if i == j else 0.0) for j in range(p)])

    enough = F.col("_n") >= max(min_rows, p + 2)
    out = df.withColumn("_g", F.when(enough, eliminate(F.array(*[row(i) for i in range(p)]), p)["m"]))
    out = out.withColumn("coef", F.transform("_g", lambda r: r[p])).withColumn("_inv", F.transform("_g", lambda r: F.slice(r, p + 2, p)))
    explained = sum((F.col("coef")[i] * F.col(f"_sy{i}") for i in range(p)), F.lit(0.0))
    used = sum((k(i).cast("int") for i in range(p)), F.lit(1))
    out = out.withColumn("intercept", F.col("_my") - sum((F.col("coef")[i] * F.col(f"_m{i}") for i in range(p)), F.lit(0.0)))
    out = out.withColumn("rss", F.greatest(F.lit(0.0), F.col("_n") * (F.col("_syy") - explained)) + F.col("intercept") * 0.0)
    out = out.withColumn("sigma", F.sqrt(div(F.col("rss"), F.col("_n") - used))).withColumn("r2", 1.0 - div(F.col("rss"), F.col("_n") * F.col("_syy")))
    se = [F.when(k(i), F.col("sigma") * F.sqrt(F.greatest(F.lit(0.0), F.col("_inv")[i][i]) / F.col("_n"))) for i in range(p)]
    out = out.withColumn("se", F.array(*se)).withColumn("t", F.zip_with("coef", "se", lambda b, e: F.try_divide(b, e)))
    return out.withColumn("n", F.col("_n")).withColumn("used", used)


def _public(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = KEYS, private: bool = False) -> DataFrame:
    """One regression with constant per key, in a single partial aggregate."""
    fit = _solve(df.groupBy(*keys).agg(*_moments(y, xs, None)), len(xs))
    return fit if private else fit.select(*_public(fit))


def rolling_ols(df: DataFrame, y: str, xs: Sequence[str], n: int | None, keys: Sequence[str] = KEYS, delay: int = 0, min_rows: int = 0, refit_every: int = 1) -> DataFrame:
    """A regression per row over the last n rows (or all past rows), ending ``delay`` rows back.

    With ``refit_every`` the coefficients of an epoch's first row serve the epoch.
    """
    w = trailing(n, keys, delay=delay) if n else expanding(keys, delay=delay)
    base = df.select("*", *_moments(y, xs, w))
    if n:
        base = base.withColumn("_n", F.when(F.count("*").over(w) == n, F.col("_n")))
    fit = _solve(base, len(xs), min_rows=min_rows)
    if refit_every > 1:
        epoch = F.floor((F.row_number().over(ordered(keys)) - 1) / refit_every)
        first = Window.partitionBy(*keys, "_epoch").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        fit = fit.withColumn("_epoch", epoch)
        fit = fit.withColumn("coef", F.first("coef").over(first)).withColumn("intercept", F.first("intercept").over(first))
    return fit.select(*_public(fit))


def predict(coef: Column, intercept: Column, xs: Sequence[Column]) -> Column:
    out = intercept
    for i, x in enumerate(xs):
        out = out + coef[i] * x
    return out


def delay_regression_path(df: DataFrame, lags: Sequence[int], months: int = 1, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Regress y on the driver at its best positive lag L and forecast the next L periods.

    The last L drivers are already known, so no driver has to be forecast.
    """
    from strandline.operators.crosscorr import _lag_array

    rows = df.filter(F.col("y").isNotNull() & F.col("x").isNotNull())
    base = rows.withColumn("_a", _lag_array(rows, "x", max(lags), keys, "ts"))
    pairs = base.select(*keys, F.col("y").alias("_y"), F.posexplode("_a").alias("lag", "_p")).filter(F.col("lag").isin([k for k in lags if k > 0]))
    t = pairs.groupBy(*keys, "lag").agg(
        F.corr(F.col("_y"), F.col("_p.x")).alias("rho"), F.regr_slope(F.col("_y"), F.col("_p.x")).alias("beta"), F.regr_intercept(F.col("_y"), F.col("_p.x")).alias("alpha")
    )
    best = t.groupBy(*keys).agg(F.max(F.struct(F.round(F.abs("rho"), 9).alias("s"), (-F.col("lag")).alias("k"), "beta", "alpha")).alias("b"))
    best = best.select(*keys, (-F.col("b.k")).alias("lag"), F.col("b.beta").alias("beta"), F.col("b.alpha").alias("alpha"))
    back = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    tail = rows.withColumn("_j", F.row_number().over(back)).filter(F.col("_j") <= max(lags))
    last = F.max("ts").over(Window.partitionBy(*keys))
    path = tail.withColumn("_last", last).join(best, list(keys)).filter(F.col("_j") <= F.col("lag"))
    step = F.col("lag") - F.col("_j") + 1
    return path.select(
        *keys, step.alias("step"), F.add_months("_last", (step * months).cast("int")).alias("target"), "lag", (F.col("alpha") + F.col("beta") * F.col("x")).alias("forecast")
    )


def ar_orders(df: DataFrame, col: str, max_order: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """AIC, BIC, HQIC and MDL of AR(1)..AR(max_order) on their common sample, as rows.

    One aggregate serves all orders: a smaller model uses a corner of the same
    covariance matrix.  Orders above a quarter of the sample are left out.
    """
    w = ordered(keys)
    lags = [f"_lag{k}" for k in range(1, max_order + 1)]
    base = df.select(*keys, "ts", F.col(col).alias("_y"), *[F.lag(col, k).over(w).alias(f"_lag{k}") for k in range(1, max_order + 1)])
    m = base.groupBy(*keys).agg(*_moments("_y", lags, None)).withColumn("order", F.explode(F.sequence(F.lit(1), F.lit(max_order))))
    m = m.withColumn("_keep", F.array(*[F.col("order") > i for i in range(max_order)]))
    fit = _solve(m, max_order, keep="_keep")
    n, s2, p = F.col("n"), div(F.col("rss"), F.col("n")), F.col("order")
    loglik = -0.5 * n * (math.log(2 * math.pi) + F.log(s2) + 1.0)
    return fit.filter((n >= 4 * p) & F.col("rss").isNotNull()).select(
        *keys, "order", "n", "intercept", F.slice("coef", F.lit(1), p).alias("coef"), "sigma",
        (2.0 * (p + 1) - 2.0 * loglik).alias("aic"), (F.log(n) * (p + 1) - 2.0 * loglik).alias("bic"),
        (2.0 * F.log(F.log(n)) * (p + 1) - 2.0 * loglik).alias("hqic"), (n * F.log(s2) + p * F.log(n)).alias("mdl"),
    )


def best_order(table: DataFrame, criterion: str, keys: Sequence[str] = KEYS) -> DataFrame:
    pick = F.min(F.struct(F.round(F.col(criterion), 9).alias("c"), "order", "intercept", "coef", "sigma", "n"))
    b = table.groupBy(*keys).agg(pick.alias("b"))
    return b.select(*keys, F.col("b.order").alias("order"), F.col("b.c").alias(criterion), F.col("b.intercept").alias("intercept"), F.col("b.coef").alias("coef"))


def threshold_search(df: DataFrame, y: str, own: str, x: str, quantiles: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Regress y on own lag, x, I(x < tau) and their product; pick tau with the smallest residual MSE.

    Candidate thresholds are quantiles of x.  They are few, so they are attached
    per key and exploded next to the partial aggregate.
    """
    from strandline.operators.align import bounded_broadcast

    rows = df.filter(F.col(y).isNotNull() & F.col(own).isNotNull() & F.col(x).isNotNull())
    taus = rows.groupBy(*keys).agg(F.percentile(F.col(x), F.array(*[F.lit(q) for q in quantiles])).alias("_q"))
    cand = rows.join(bounded_broadcast(taus), list(keys)).withColumn("tau", F.explode(F.array_distinct("_q")))
    cand = cand.withColumn("_i", (F.col(x) < F.col("tau")).cast("double")).withColumn("_xi", F.col("_i") * F.col(x))
    fit = ols(cand, y, [own, x, "_i", "_xi"], [*keys, "tau"])
    mse = F.col("rss") / (F.col("n") - 5)
    fits = fit.filter(F.col("coef")[0].isNotNull()).withColumn("mse", mse)
    best = fits.groupBy(*keys).agg(F.min(F.struct(F.round("mse", 12).alias("mse"), "tau", "intercept", "coef", "n")).alias("b"))
    return best.select(*keys, F.col("b.tau").alias("tau"), F.col("b.mse").alias("mse"), F.col("b.intercept").alias("intercept"), F.col("b.coef").alias("coef"), F.col("b.n").alias("n"))


def threshold_scan(df: DataFrame, y: str, own: str, x: str, trim: float = 0.1, buckets: int = 512, keys: Sequence[str] = KEYS) -> DataFrame:
    """Regress y on own lag, x, I(x < tau) and their product, with tau any observed x between two quantiles.

    Every value of x from the ``trim`` to the 1 - ``trim`` quantile is tried exactly.  Rows of one x
    become one row of sums; running sums in order of x are the moments left of each candidate and
    the key's totals less them those right of it, so a candidate costs one row, not a pass.  Each
    side fits its own line; the coefficient of the own lag is what both sides share.  The smallest
    tau wins ties.  Each key is cut into ``buckets`` ranges of x of similar size: windows stay inside a
    range and start from the totals of the ranges before it.
    """
    from strandline.operators.align import bounded_broadcast
    from strandline.operators.quantiles import cut_points, place

    base = df.filter(F.col(y).isNotNull() & F.col(own).isNotNull() & F.col(x).isNotNull())
    base = base.select(*keys, *[F.col(c).cast("double").alias(a) for c, a in ((y, "_y"), (own, "_o"), (x, "_x"))])
    means = base.groupBy(*keys).agg(F.avg("_y").alias("_my"), F.avg("_o").alias("_mo"), F.avg("_x").alias("_mx"))
    # moments about the key's means: differences of running sums keep their digits
    d = {v: F.col(f"_{v}") - F.col(f"_m{v}") for v in "yox"}
    names = ["n", "y", "o", "x", "xx", "xy", "xo", "yy", "oo", "yo"]
    value = lambda name: F.lit(1.0) if name == "n" else d[name] if len(name) == 1 else d[name[0]] * d[name[1]]
    mids = ["_my", "_mo", "_mx"]
    points = base.join(bounded_broadcast(means), list(keys)).groupBy(*keys, *mids, "_x").agg(*[F.sum(value(c)).alias(f"_s_{c}") for c in names])
    totals = points.groupBy(*keys).agg(cut_points("_x", buckets).alias("_s"), *[F.sum(f"_s_{c}").alias(f"_t_{c}") for c in names])
    placed = place(points, F.col("_x"), totals, keys, buckets, "_part").drop("_s")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_part").agg(*[F.sum(f"_s_{c}").alias(f"_b_{c}") for c in names])
    parts = parts.select(*keys, "_part", *[F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0.0)).alias(f"_b_{c}") for c in names])
    inside = Window.partitionBy(*keys, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(parts.hint("shuffle_hash"), [*keys, "_part"])
    ranked = ranked.select("*", *[(F.col(f"_b_{c}") + F.sum(f"_s_{c}").over(inside)).alias(f"_c_{c}") for c in names])
    sides = ranked.select(
        *keys, F.col("_x").alias("tau"), *mids, F.col("_t_n").alias("_n"), F.col("_c_n").alias("_upto"),
        *[(F.col(f"_c_{c}") - F.col(f"_s_{c}")).alias(f"_l_{c}") for c in names], *[(F.col(f"_t_{c}") - F.col(f"_c_{c}") + F.col(f"_s_{c}")).alias(f"_r_{c}") for c in names],
    )
    # between the quantiles, by rank: some row at or above the lower one, some at or below the upper one
    low, high = F.ceil(trim * (F.col("_n") - 1) - 1e-9), F.floor((1.0 - trim) * (F.col("_n") - 1) + 1e-9)
    sides = sides.filter((F.col("_upto") - 1 >= low) & (F.col("_l_n") <= high) & (F.col("_l_n") > 0))

    def about(side: str, a: str, b: str) -> Column:
        """Centred sum of products of one side."""
        return F.col(f"_{side}_{a}{b}") - F.col(f"_{side}_{a}") * F.col(f"_{side}_{b}") / F.col(f"_{side}_n")

    for side in "lr":
        sides = sides.withColumns({f"_{side}{a}{b}": about(side, a, b) for a, b in ("xx", "xy", "xo", "yy", "oo", "yo")})
    flat = lambda side: F.col(f"_{side}xx") > 1e-12 * F.col(f"_{side}_xx")
    sides = sides.filter(flat("l") & flat("r"))
    rest = lambda a, b: sum((F.col(f"_{s}{a}{b}") - F.col(f"_{s}x{a}") * F.col(f"_{s}x{b}") / F.col(f"_{s}xx") for s in "lr"), F.lit(0.0))
    fits = sides.withColumn("_yy", rest("y", "y")).withColumn("_oo", rest("o", "o")).withColumn("_yo", rest("y", "o"))
    fits = fits.withColumn("_own", div(F.col("_yo"), F.col("_oo"))).withColumn("_rss", F.col("_yy") - F.col("_own") * F.col("_yo")).filter(F.col("_own").isNotNull() & (F.col("_n") > 5))
    slope, level = {}, {}
    for s in "lr":
        slope[s] = (F.col(f"_{s}xy") - F.col("_own") * F.col(f"_{s}xo")) / F.col(f"_{s}xx")
        centre = lambda v: F.col(f"_m{v}") + F.col(f"_{s}_{v}") / F.col(f"_{s}_n")  # noqa: B023, E731
        level[s] = centre("y") - slope[s] * centre("x") - F.col("_own") * centre("o")
    fits = fits.select(
        *keys, "tau", "_rss", F.col("_n").cast("long").alias("n"), level["r"].alias("intercept"), F.col("_own").alias("own"), slope["r"].alias("slope"),
        (level["l"] - level["r"]).alias("below"), (slope["l"] - slope["r"]).alias("slope_below"),
    )
    fields = ["n", "intercept", "own", "slope", "below", "slope_below"]
    size = F.greatest(F.lit(0.0), F.col("_rss"))
    best = fits.groupBy(*keys).agg(F.min(F.struct(size.alias("rss"), "tau", *fields)).alias("b"), F.count("*").alias("tried"))
    return best.select(*keys, F.col("b.tau").alias("tau"), (F.col("b.rss") / (F.col("b.n") - 5)).alias("mse"), *[F.col(f"b.{f}").alias(f) for f in fields], "tried")


def sequential_elimination(df: DataFrame, y: str, xs: Sequence[str], cutoffs: Sequence[float], keys: Sequence[str] = KEYS, always: Sequence[str] = ()) -> DataFrame:
    """Refit after dropping regressors whose |t| lies below each successive cutoff.

    The data are aggregated once; every round solves the same moments with a
    smaller mask.  A round that would drop everything keeps the mask it had.
    """
    p = len(xs)
    m = df.groupBy(*keys).agg(*_moments(y, xs, None)).withColumn("_keep", F.array(*[F.lit(True)] * p))
    moment_cols = m.columns
    for cut in cutoffs:
        fit = _solve(m, p, keep="_keep")
        strong = [F.col("_keep")[i] & ((F.abs(F.coalesce(F.col("t")[i], F.lit(0.0))) >= cut) | F.lit(xs[i] in always)) for i in range(p)]
        new = F.array(*strong)
        mask = F.when(F.exists(new, lambda b: b), new).otherwise(F.col("_keep"))
        m = fit.withColumn("_keep2", mask).select(*[c for c in moment_cols if c != "_keep"], F.col("_keep2").alias("_keep"))
    return _solve(m, p, keep="_keep").withColumn("kept", F.col("_keep"))


def ardl_long_run(df: DataFrame, y: str, x: str, y_lags: int, x_lags: int, cutoff: float = 1.780, keys: Sequence[str] = KEYS) -> DataFrame:
    """Autoregressive distributed lag model, reduced once, with a Wald statistic of the x lags.

    The default cutoff is the normal quantile of a 7.5 % two-sided level.  The
    statistic tests that the kept x coefficients sum to zero (one degree of freedom).
    """
    w = ordered(keys)
    ys = [f"y_lag{k}" for k in range(1, y_lags + 1)]
    xl = [f"x_lag{k}" for k in range(0, x_lags + 1)]
    base = df.select(*keys, "ts", F.col(y).alias("_y"), *[F.lag(y, k).over(w).alias(f"y_lag{k}") for k in range(1, y_lags + 1)],
                     *[(F.lag(x, k).over(w) if k else F.col(x)).alias(f"x_lag{k}") for k in range(0, x_lags + 1)])
    names = [*ys, *xl]
    fit = sequential_elimination(base, "_y", names, [cutoff], keys, always=ys)
    xi = range(len(ys), len(names))
    b = sum((F.when(F.col("kept")[i], F.col("coef")[i]).otherwise(0.0) for i in xi), F.lit(0.0))
    v = F.lit(0.0)
    for i in xi:
        for j in xi:
            v = v + F.when(F.col("kept")[i] & F.col("kept")[j], F.col("_inv")[i][j]).otherwise(0.0)
    var = F.col("sigma") * F.col("sigma") * v / F.col("n")
    return fit.select(
        *keys, "n", "coef", "kept", b.alias("sum_x"), div(b * b, var).alias("wald"),
        div(b, 1.0 - sum((F.col("coef")[i] for i in range(len(ys))), F.lit(0.0))).alias("long_run"),
    )


def two_equation_system(df: DataFrame, ret: str, keys: Sequence[str] = KEYS, min_rows: int = 60, refit_every: int = 24) -> DataFrame:
    """One-step forecasts of the return and of its change, with sign-state dummies, expanding fit.

    Lags of the change are differences of return lags and one of four exclusive
    dummies repeats the constant, so the identified regressors are three return
    lags and three dummies; the change equation shares them and its forecast is
    the return forecast less the current return.
    """
    w = ordered(keys)
    r = F.col(ret)
    base = df.filter(r.isNotNull()).withColumn("_d", r - F.lag(ret).over(w))
    flags = {"_z1": (F.col("_d") > 0) & (r > 0), "_z2": (F.col("_d") <= 0) & (r > 0), "_z3": (F.col("_d") <= 0) & (r <= 0)}
    for name, c in flags.items():
        base = base.withColumn(name, F.when(F.col("_d").isNotNull(), F.when(c, 1.0).otherwise(-1.0)))
    now = [F.col(ret), F.lag(ret, 1).over(w), F.lag(ret, 2).over(w), F.col("_z1"), F.col("_z2"), F.col("_z3")]
    base = base.select("*", *[c.alias(f"_now{i}") for i, c in enumerate(now)])
    base = base.select("*", *[F.lag(f"_now{i}").over(w).alias(f"_was{i}") for i in range(6)])
    fit = rolling_ols_keep(base, ret, [f"_was{i}" for i in range(6)], keys, min_rows, refit_every)
    f = predict(F.col("coef"), F.col("intercept"), [F.col(f"_now{i}") for i in range(6)])
    out = fit.withColumn("forecast", f).withColumn("forecast_change", F.col("forecast") - r)
    a, b = F.col("forecast"), F.col("forecast_change")
    return out.select(
        *df.columns, "forecast", "forecast_change",
        F.when((a > 0) | (b > 0), 1).when((a < 0) | (b < 0), -1).alias("rule_either"), F.signum((a + b) / 2.0).alias("rule_mean"), F.signum(a).alias("rule_return"),
    )


def rolling_ols_keep(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], min_rows: int, refit_every: int) -> DataFrame:
    """Expanding regression per row that keeps the input's working columns."""
    moments = _moments(y, xs, expanding(keys))
    fit = _solve(df.select("*", *moments), len(xs), min_rows=min_rows)
    epoch = F.floor((F.row_number().over(ordered(keys)) - 1) / refit_every)
    first = Window.partitionBy(*keys, "_epoch").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    fit = fit.withColumn("_epoch", epoch)
    return fit.select(*df.columns, F.first("coef").over(first).alias("coef"), F.first("intercept").over(first).alias("intercept"))


def basis_regression(df: DataFrame, y: str, features: Sequence[str], n: int, priors: Sequence[float], noises: Sequence[float], keys: Sequence[str] = KEYS, complete_only: bool = False) -> DataFrame:
    """Bayesian linear regression on given features over rolling windows, predictive mean and deviation.

    Equals a Gaussian process with a linear kernel on the features.  Prior and
    noise variances are chosen per row by log evidence on a grid; the window's
    sums of products are computed once for the whole grid.
    """
    q = len(features)
    w = trailing(n, keys, delay=1)
    ok = F.col(y).isNotNull()
    for f in features:
        ok = ok & F.col(f).isNotNull()
    v = lambda c: F.when(ok, F.col(c))
    sums = [F.count(F.when(ok, 1)).over(w).alias("_n"), F.sum(v(y) * v(y)).over(w).alias("_yy")]
    for i in range(q):
        sums.append(F.sum(v(features[i]) * v(y)).over(w).alias(f"_b{i}"))
        sums += [F.sum(v(features[i]) * v(features[j])).over(w).alias(f"_a{i}_{j}") for j in range(i, q)]
    base = df.select("*", *sums)
    base = base.withColumn("_ok", (F.col("_n") == n) & ok)
    if complete_only:
        base = base.filter("_ok")
    options = []
    for s2 in priors:
        for g2 in noises:
            rows = [
                F.array(*[F.col(f"_a{min(i, j)}_{max(i, j)}") / g2 + (1.0 / s2 if i == j else 0.0) for j in range(q)],
                        F.col(f"_b{i}") / g2, *[F.lit(1.0 if i == j else 0.0) for j in range(q)])
                for i in range(q)
            ]
            options.append(F.struct(F.lit(float(s2)).alias("prior"), F.lit(float(g2)).alias("noise"), eliminate(F.array(*rows), q).alias("e")))
    base = base.withColumn("_o", F.when(F.col("_ok"), F.array(*options)))
    b = F.array(*[F.col(f"_b{i}") for i in range(q)])

    def evidence(o: Column) -> Column:
        fit = F.aggregate(F.zip_with(F.transform(o["e"]["m"], lambda r: r[q]), b, lambda m, c: m * c), F.lit(0.0), lambda a, c: a + c)
        quad = (F.col("_yy") - fit) / o["noise"]
        det = n * F.log(o["noise"]) + q * F.log(o["prior"]) + o["e"]["logdet"]
        return -0.5 * (quad + det + n * math.log(2 * math.pi))

    scored = base.withColumn("_best", F.array_max(F.transform("_o", lambda o: F.struct(evidence(o).alias("evidence"), o.alias("o")))))
    m = F.transform(F.col("_best.o.e.m"), lambda r: r[q])
    x = F.array(*[F.col(f) for f in features])
    dot = lambda a, c: F.aggregate(F.zip_with(a, c, lambda p, r: p * r), F.lit(0.0), lambda p, r: p + r)
    spread = F.aggregate(
        F.zip_with(F.transform(F.col("_best.o.e.m"), lambda r: dot(F.slice(r, q + 2, q), x)), x, lambda p, r: p * r), F.lit(0.0), lambda p, r: p + r
    )
    return scored.select(
        *df.columns, F.col("_best.evidence").alias("evidence"), F.col("_best.o.prior").alias("prior"), F.col("_best.o.noise").alias("noise"),
        dot(m, x).alias("mean"), F.sqrt(spread + F.col("_best.o.noise")).alias("deviation"),
    )


def wilks_lambda(df: DataFrame, cols: Sequence[str], group: str, keys: Sequence[str] = ()) -> DataFrame:
    """|E| / |E + H| of a one-way layout, from one set of moments per group."""
    p = len(cols)
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    g = df.filter(ok).groupBy(*keys, group).agg(
        F.count("*").alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)], *[F.covar_pop(cols[i], cols[j]).alias(f"_c{i}_{j}") for i, j in pairs]
    )
    n = F.col("_n")
    s = g.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count("*").alias("groups"), *[F.sum(n * F.col(f"_m{i}")).alias(f"_s{i}") for i in range(p)],
        *[F.sum(n * F.col(f"_c{i}_{j}")).alias(f"_e{i}_{j}") for i, j in pairs],
        *[F.sum(n * F.col(f"_m{i}") * F.col(f"_m{j}")).alias(f"_q{i}_{j}") for i, j in pairs],
    )
    e = lambda i, j: F.col(f"_e{min(i, j)}_{max(i, j)}")
    h = lambda i, j: F.col(f"_q{min(i, j)}_{max(i, j)}") - F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("n")
    mat = lambda f: F.array(*[F.array(*[f(i, j) for j in range(p)]) for i in range(p)])
    lam = F.exp(eliminate(mat(e), p)["logdet"] - eliminate(mat(lambda i, j: e(i, j) + h(i, j)), p)["logdet"])
    return s.select(*keys, "n", "groups", lam.alias("wilks_lambda"))


def trend_cycle(df: DataFrame, col: str, max_degree: int, criterion: str = "bic", keys: Sequence[str] = KEYS) -> DataFrame:
    """Deviation (in percent) of ln(col) from a Chebyshev time trend of selected degree.

    ``criterion`` is aic, bic or median (of the two degrees).
    """
    from strandline.operators.align import bounded_broadcast
    from strandline.operators.transform import time_basis

    base = time_basis(df.filter(F.col(col) > 0), max_degree, keys).withColumn("_ln", F.log(col))
    names = [f"_t{d}" for d in range(1, max_degree + 1)]
    base = base.select("*", *[F.col("basis")[d].alias(f"_t{d}") for d in range(1, max_degree + 1)])
    m = base.groupBy(*keys).agg(*_moments("_ln", names, None)).withColumn("degree", F.explode(F.sequence(F.lit(1), F.lit(max_degree))))
    m = m.withColumn("_keep", F.array(*[F.col("degree") > i for i in range(max_degree)]))
    n, d = F.col("n"), F.col("degree")
    fits = _solve(m, max_degree, keep="_keep").select(
        *keys, "degree", "intercept", "coef", (n * F.log(F.col("rss") / n) + 2.0 * (d + 1)).alias("aic"), (n * F.log(F.col("rss") / n) + F.log(n) * (d + 1)).alias("bic")
    )
    best = fits.groupBy(*keys).agg(F.min_by("degree", F.round("aic", 9)).alias("_da"), F.min_by("degree", F.round("bic", 9)).alias("_db"))
    want = {"aic": F.col("_da"), "bic": F.col("_db"), "median": F.floor((F.col("_da") + F.col("_db")) / 2)}[criterion]
    chosen = fits.join(best, list(keys)).filter(F.col("degree") == want).select(*keys, "degree", "intercept", "coef")
    j = base.join(bounded_broadcast(chosen), list(keys))
    fitted = F.col("intercept") + F.aggregate(
        F.zip_with("coef", F.slice("basis", F.lit(2), F.size("coef")), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b
    )
    return j.select(*df.columns, "degree", (100.0 * (F.col("_ln") - fitted)).alias("cycle"))
