"""Performance tables, forecast accuracy and comparison tests.

Summaries are single grouped aggregates with map-side partials, so a group that
holds a third of all rows reduces inside its scan tasks.  The one ordered measure,
drawdown, is computed with the equity curve.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import KEYS, expanding, ordered, trailing
from strandline.functions.scalar import corr_from, div, norm_cdf
from strandline.operators.quantiles import exact_quantiles


def _drawdown(df: DataFrame, ret: str, keys, order: str) -> DataFrame:
    w = expanding(keys, order)
    base = df.filter(F.col(ret).isNotNull()).withColumn("_w", F.product(1.0 + F.col(ret)).over(w))
    return base.withColumn("_dd", div(F.col("_w"), F.max("_w").over(w)) - 1.0)


def performance_annual(df: DataFrame, periods: float, ret: str = "ret", keys=KEYS, order: str = "ts", target: float = 0.0, benchmark: str | None = None) -> DataFrame:
    """Mean, deviation, Sharpe, Sortino over all rows, total return and maximum drawdown.

    With ``benchmark`` (a return column) its total return over the same rows and the
    excess return are added in the same pass.
    """
    r = F.col(ret)
    short = F.greatest(F.lit(target) - r, F.lit(0.0))
    hold = [(F.product(1.0 + F.col(benchmark)) - 1.0).alias("hold_return")] if benchmark else []
    agg = _drawdown(df, ret, keys, order).groupBy(*keys).agg(
        (F.avg(r) * periods).alias("mean"),
        (F.stddev_samp(r) * periods**0.5).alias("std"),
        F.sqrt(F.avg(short * short)).alias("_down"),
        (F.product(1.0 + r) - 1.0).alias("total_return"),
        F.min("_dd").alias("max_drawdown"),
        F.count(r).alias("periods"),
        *hold,
    )
    extra = ["hold_return", (F.col("total_return") - F.col("hold_return")).alias("excess_return")] if benchmark else []
    return agg.select(
        *keys, "periods", "mean", "std",
        div(F.col("mean"), F.col("std")).alias("sharpe"),
        div(F.col("mean"), F.col("_down")).alias("sortino"),
        "total_return", "max_drawdown", *extra,
    )


def performance_trading(df: DataFrame, periods: float, ret: str = "ret", keys=KEYS, order: str = "ts") -> DataFrame:
    """Eleven measures with population deviations; Sortino over negative rows only."""
    r = F.col(ret)
    neg, pos, traded = F.when(r < 0, r), F.when(r > 0, r), F.when(r != 0, r)
    a = _drawdown(df, ret, keys, order).groupBy(*keys).agg(
        F.count(r).alias("_n"),
        (F.product(1.0 + r) - 1.0).alias("total_return"),
        F.avg(r).alias("_mu"),
        F.stddev_pop(r).alias("_sd"),
        F.stddev_pop(neg).alias("_nsd"),
        F.count(neg).alias("_nn"),
        F.min("_dd").alias("max_drawdown"),
        F.count(traded).alias("num_trades"),
        F.count(pos).alias("_np"),
        F.sum(pos).alias("_sp"),
        F.sum(neg).alias("_sn"),
        F.avg(traded).alias("avg_trade_return"),
    )
    growth = F.when(F.col("total_return") > -1.0, F.pow(1.0 + F.col("total_return"), periods / F.col("_n")) - 1.0)
    sharpe = F.coalesce(div(F.col("_mu") * periods, F.col("_sd") * periods**0.5), F.lit(0.0))
    b = a.withColumn("annualized_return", growth).withColumn("sharpe_ratio", sharpe)
    return b.select(
        *keys, "total_return", "annualized_return", "sharpe_ratio", "max_drawdown",
        F.coalesce(div(F.col("_np"), F.col("num_trades")), F.lit(0.0)).alias("win_rate"),
        div(F.col("_sp"), F.abs("_sn")).alias("profit_factor"),
        "num_trades",
        F.coalesce("avg_trade_return", F.lit(0.0)).alias("avg_trade_return"),
        (F.col("_sd") * periods**0.5).alias("volatility"),
        F.coalesce(div(F.col("annualized_return"), F.abs("max_drawdown")), F.lit(0.0)).alias("calmar_ratio"),
        F.when(F.col("_nn") == 0, F.col("sharpe_ratio"))
        .otherwise(div(F.col("_mu") * periods, F.col("_nsd") * periods**0.5))
        .alias("sortino_ratio"),
    )


def performance_plain(df: DataFrame, periods: float, ret: str = "ret", keys=KEYS, order: str = "ts") -> DataFrame:
    """Un-annualised Sharpe, drawdown as a positive share, and growth over annual volatility."""
    r = F.col(ret)
    a = _drawdown(df, ret, keys, order).groupBy(*keys).agg(
        F.count(r).alias("_n"),
        (F.product(1.0 + r) - 1.0).alias("cumulative_return"),
        F.avg(r).alias("_mu"),
        F.stddev_pop(r).alias("_sd"),
        F.stddev_samp(r).alias("_ss"),
        (-F.min("_dd")).alias("max_drawdown"),
    )
    growth = F.when(F.col("cumulative_return") > -1.0, F.pow(1.0 + F.col("cumulative_return"), periods / F.col("_n")) - 1.0)
    return a.select(
        *keys, "cumulative_return",
        F.coalesce(div(F.col("_mu"), F.col("_sd")), F.lit(0.0)).alias("sharpe_plain"),
        div(F.col("_mu") * periods**0.5, F.col("_ss")).alias("sharpe_annual"),
        div(growth, F.col("_ss") * periods**0.5).alias("sharpe_growth"),
        "max_drawdown",
    )


def by_year(df: DataFrame, ret: str = "ret", keys=KEYS) -> DataFrame:
    r = F.col(ret)
    return df.filter(r.isNotNull()).groupBy(*keys, F.year("ts").alias("year")).agg(
        (F.product(1.0 + r) - 1.0).alias("year_return"), F.sum(r).alias("year_sum"), F.percentile(r, F.lit(0.5)).alias("year_median")
    )


def excess_return(df: DataFrame, strategy: str = "strategy", ret: str = "ret", keys=KEYS) -> DataFrame:
    """Total return of the strategy, of holding, and the difference, over common rows."""
    both = F.col(strategy).isNotNull() & F.col(ret).isNotNull()
    return df.filter(both).groupBy(*keys).agg(
        (F.product(1.0 + F.col(strategy)) - 1.0).alias("strategy_return"),
        (F.product(1.0 + F.col(ret)) - 1.0).alias("hold_return"),
        F.count("*").alias("rows"),
    ).withColumn("excess_return", F.col("strategy_return") - F.col("hold_return"))


def success_share(df: DataFrame, keys: Sequence[str] = KEYS, excess: str = "excess_return") -> DataFrame:
    e = F.col(excess)
    return df.groupBy(*keys).agg(
        F.avg((e > 0).cast("double")).alias("success_share"),
        F.max(e).alias("best"), F.avg(e).alias("mean"), F.min(e).alias("worst"), F.count(e).alias("runs"),
    )


def describe(df: DataFrame, col: str, keys=KEYS) -> DataFrame:
    """Count, moments, extremes, quartiles, skewness and excess kurtosis (population)."""
    x = F.col(col)
    return df.groupBy(*keys).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.percentile(x, F.lit(0.25)).alias("q25"), F.percentile(x, F.lit(0.5)).alias("q50"),
        F.percentile(x, F.lit(0.75)).alias("q75"), F.max(x).alias("max"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"),
    )


def choice_quartiles(df: DataFrame, rank: str, choice: str, k: int = 3) -> DataFrame:
    """Distribution of the top-k choices across series, per rank, and the distinct choices."""
    c = F.col(choice).cast("double")
    return df.filter(F.col(rank) <= k).groupBy(rank).agg(
        F.percentile(c, F.lit(0.25)).alias("q25"), F.percentile(c, F.lit(0.5)).alias("q50"),
        F.percentile(c, F.lit(0.75)).alias("q75"), F.array_join(F.array_sort(F.collect_set(F.col(choice).cast("int"))), ",").alias("choices"),
    )


def forecast_accuracy(df: DataFrame, keys: Sequence[str], actual="actual", forecast="forecast", lower=None, upper=None, previous=None) -> DataFrame:
    """Errors, fit, direction and interval measures of forecast rows."""
    a, f = F.col(actual), F.col(forecast)
    rows = df.filter(a.isNotNull() & f.isNotNull())
    e = a - f
    agg = [
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100.0 * F.avg(F.when(a != 0, F.abs(div(e, a))))).alias("mape"),
        (1.0 - div(F.sum(e * e), F.var_pop(a) * F.count("*"))).alias("r2"),
        F.avg((F.signum(a) == F.signum(f)).cast("double")).alias("sign_accuracy"),
    ]
    if previous:
        p = F.col(previous)
        agg.append(F.avg(F.when(p.isNotNull(), (F.signum(a - p) == F.signum(f - p)).cast("double"))).alias("hit_rate"))
    if lower and upper:
        agg += [
            F.avg(a.between(F.col(lower), F.col(upper)).cast("double")).alias("coverage"),
            F.avg(F.col(upper) - F.col(lower)).alias("sharpness"),
        ]
    return rows.groupBy(*keys).agg(*agg)


def relative_accuracy(df: DataFrame, base: str, keys: Sequence[str], model: str = "model", actual="actual", forecast="forecast") -> DataFrame:
    """MSE and MAE over the base model's, and precision 1 / sqrt(1000 R + 1)."""
    a, f = F.col(actual), F.col(forecast)
    e = a - f
    rows = df.filter(a.isNotNull() & f.isNotNull())
    s = rows.groupBy(*keys, model).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        div(F.avg(F.pow(div(e, a), 2)), F.avg(F.pow(div(e, f), 2))).alias("_r"),
    )
    w = Window.partitionBy(*keys)
    base_of = lambda c: F.max(F.when(F.col(model) == base, F.col(c))).over(w)
    return s.select(
        *keys, model, "mse", "mae",
        div(F.col("mse"), base_of("mse")).alias("rel_mse"), div(F.col("mae"), base_of("mae")).alias("rel_mae"),
        (1.0 / F.sqrt(1000.0 * F.col("_r") + 1.0)).alias("precision"),
    )


def rolling_precision(df: DataFrame, n: int, keys: Sequence[str], actual="actual", forecast="forecast") -> DataFrame:
    e = F.col(actual) - F.col(forecast)
    base = df.withColumn("_ea", F.pow(div(e, F.col(actual)), 2)).withColumn("_ef", F.pow(div(e, F.col(forecast)), 2))
    w = trailing(n, keys)
    ratio = div(F.avg("_ea").over(w), F.avg("_ef").over(w))
    ok = F.count(F.col("_ea") + F.col("_ef")).over(w) == n
    return base.withColumn("precision", F.when(ok, 1.0 / F.sqrt(1000.0 * ratio + 1.0))).drop("_ea", "_ef")


def diebold_mariano(df: DataFrame, loss_a: Column, loss_b: Column, keys=KEYS, order: str = "ts") -> DataFrame:
    """Test that two loss series have equal means, with Bartlett-weighted autocovariances.

    The bandwidth is floor(4 (n/100)^(2/9)) of each group; the number of lag columns follows
    from the largest group, which is counted first (one row reaches the driver).
    """
    w = ordered(keys, order)
    base = df.withColumn("_d", loss_a - loss_b).filter(F.col("_d").isNotNull())
    longest = base.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    max_lag = max(1, math.floor(4.0 * (longest / 100.0) ** (2.0 / 9.0)))
    base = base.select("*", *[F.lag("_d", j).over(w).alias(f"_l{j}") for j in range(1, max_lag + 1)])
    s = base.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_d").alias("mean_difference"), F.var_samp("_d").alias("_s0"),
        *[F.covar_samp("_d", f"_l{j}").alias(f"_s{j}") for j in range(1, max_lag + 1)],
    )
    bw = F.floor(4.0 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0)))
    var = F.col("_s0")
    for j in range(1, max_lag + 1):
        var = var + F.when(bw >= j, 2.0 * (1.0 - F.lit(float(j)) / (bw + 1.0)) * F.coalesce(F.col(f"_s{j}"), F.lit(0.0))).otherwise(0.0)
    stat = F.when(var > 0, div(F.col("mean_difference"), F.sqrt(var / F.col("n"))))
    s = s.withColumn("bandwidth", bw.cast("int")).withColumn("statistic", stat)
    return s.select(*keys, "n", "bandwidth", "mean_difference", "statistic", (2.0 * (1.0 - norm_cdf(F.abs("statistic")))).alias("p_value"))


def replication_summary(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Mean, deviation, median and outer quantiles per group of any size."""
    from strandline.operators.quantiles import exact_quantiles

    m = F.col(metric)
    moments = df.groupBy(*keys).agg(F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"))
    return moments.join(exact_quantiles(df, metric, {"median": 0.5, "q05": 0.05, "q95": 0.95}, keys), list(keys))


def ensemble_summary(df: DataFrame, keys: Sequence[str], ret: str, sharpe: str, drawdown: str, bins: int = 20) -> DataFrame:
    """Chance of a gain, averages, and entropy (bits) of the equal-width return histogram."""
    r = F.col(ret)
    stats = df.groupBy(*keys).agg(
        F.avg((r > 0).cast("double")).alias("success_probability"), F.avg(r).alias("expected_return"),
        F.avg(sharpe).alias("mean_sharpe"), F.avg(drawdown).alias("mean_max_drawdown"), F.min(r).alias("_lo"), F.max(r).alias("_hi"), F.count(r).alias("_n"),
    )
    binned = histogram(df, ret, bins, keys)
    w = binned.join(stats.select(*keys, "_n"), list(keys))
    p = F.col("n") / F.col("_n")
    h = w.groupBy(*keys).agg(F.sum(-p * F.log2(p)).alias("return_entropy"))
    return stats.drop("_lo", "_hi", "_n").join(h, list(keys))


def modal(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Most frequent value, the smallest of equals: counts first, then one max per group."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(*keys).orderBy(F.col("votes").desc(), F.col(col))
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def histogram(df: DataFrame, col: str, bins: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts in equal-width bins over each group's own range; empty bins have no row."""
    x = F.col(col)
    from strandline.operators.align import bounded_broadcast

    rng = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = df.filter(x.isNotNull()).join(bounded_broadcast(rng), list(keys))
    b = F.least(F.coalesce(F.floor(div((x - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins // 2)), F.lit(bins - 1))
    return j.groupBy(*keys, b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("_lo").alias("low"), F.max("_hi").alias("high"))


def market_regime(df: DataFrame, names: Sequence[str], n: int, ret: str = "ret") -> DataFrame:
    """crisis / volatile / high_correlation / normal over the last n rows of the named assets.

    Volatility is each asset's recent over its whole deviation, averaged;
    correlation is the mean over asset pairs on their common recent dates.
    """
    from strandline.operators.align import all_pairs, pair_rows

    r = F.col(ret)
    newest = Window.partitionBy("series_id").orderBy(F.col("ts").desc())
    rows = df.filter(F.col("series_id").isin(list(names)) & r.isNotNull()).withColumn("_n", F.row_number().over(newest))
    recent = F.when(F.col("_n") <= n, r)
    vol = rows.groupBy("series_id").agg(div(F.stddev_samp(recent), F.stddev_samp(r)).alias("v"))
    vol = vol.select(F.col("v"), F.lit(None).cast("double").alias("c"))
    pairs = pair_rows(rows.filter(F.col("_n") <= n), all_pairs(names), ret).dropna()
    cor = pairs.groupBy("pair").agg(corr_from(F.col("y"), F.col("x")).alias("c")).select(F.lit(None).cast("double").alias("v"), "c")
    both = vol.unionByName(cor).agg(F.avg("v").alias("volatility_ratio"), F.avg("c").alias("mean_correlation"))
    v, c = F.col("volatility_ratio"), F.col("mean_correlation")
    # fixed values: class limits
    label = F.when((v > 1.5) & (c > 0.7), "crisis").when(v > 1.2, "volatile").when(c > 0.7, "high_correlation").otherwise("normal")
    return both.withColumn("regime", label)


def feedback_regime(df: DataFrame, ret: str, n: int, threshold: float = 0.1, keys=KEYS) -> DataFrame:
    """Class of the last n rows' lag-1 autocorrelation at each row."""
    x = F.col(ret)
    base = df.withColumn("_l", F.lag(x).over(ordered(keys)))
    w, inner = trailing(n, keys), trailing(n - 1, keys)
    rho = F.when(F.count(x).over(w) == n, corr_from(x, F.col("_l"), inner))
    a = F.col("autocorr")
    label = (
        F.when(a.isNull(), "undefined")
        .when(F.abs(a) < threshold, "homeostatic")
        .when(a > 0.3, "trending")
        .when(a < -0.3, "mean-reverting")
        .otherwise("transitional")
    )
    return base.withColumn("autocorr", rho).withColumn("feedback", label).drop("_l")


def normal_fit(df: DataFrame, col: str, keys=KEYS) -> DataFrame:
    """Gaussian log-likelihood at the maximum, AIC and BIC."""
    import math

    x = F.col(col)
    s = df.filter(x.isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"))
    ll = -F.col("n") * (0.5 * math.log(2 * math.pi) + F.log("sigma") + 0.5)
    return s.withColumn("loglik", F.when(F.col("sigma") > 0, ll)).withColumn("aic", 4.0 - 2.0 * F.col("loglik")).withColumn(
        "bic", 2.0 * F.log("n") - 2.0 * F.col("loglik")
    )


def value_at_risk(df: DataFrame, ret: str = "ret", levels: Sequence[int] = (95, 99), keys=KEYS) -> DataFrame:
    """The (100 - level) percent quantile of the returns, a column for each level; exact for any length."""
    return exact_quantiles(df, ret, {f"var_{k}": (100 - k) / 100 for k in levels}, keys)
