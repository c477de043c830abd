"""Portfolio aggregates over asset returns and given weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import ordered
from strandline.functions.scalar import div


def portfolio_returns(df: DataFrame, ret: str = "ret", weight: str = "w", cost: float = 0.0) -> DataFrame:
    """Per date: equal-weight, weighted, turnover against drifted weights, and net return."""
    r, w = F.col(ret), F.col(weight)
    grown = w * (1.0 + r)
    base = df.withColumn("_drift", div(grown, F.sum(grown).over(Window.partitionBy("ts"))))
    base = base.withColumn("_trade", F.abs(w - F.coalesce(F.lag("_drift").over(ordered()), F.lit(0.0))))
    out = base.groupBy("ts").agg(F.avg(r).alias("equal_weight"), F.sum(w * r).alias("gross"), F.sum("_trade").alias("turnover"))
    return out.withColumn("net", F.col("gross") - cost * F.col("turnover"))


def covariances(df: DataFrame, names: list[str], ret: str = "ret") -> DataFrame:
    """Sample covariances (i, j) of named assets on common dates.

    The dates are pivoted to one wide row each and all pairs reduce in a single
    aggregate: rows shuffle once by date and never multiply by pairs.
    """
    wide = df.filter(F.col("series_id").isin(names)).groupBy("ts").pivot("series_id", names).agg(F.first(ret, ignorenulls=True))
    pairs = [(a, b) for a in names for b in names]
    one = wide.agg(*[F.covar_samp(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def portfolio_risk(df: DataFrame, weights: dict[str, float], ret: str = "ret") -> DataFrame:
    """Marginal and component risk per asset, portfolio deviation and diversification ratio."""
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    c = covariances(df, list(weights), ret)
    m = c.groupBy("i").agg(F.sum(F.col("cov") * w[F.col("j")]).alias("_m"), F.max(F.when(F.col("i") == F.col("j"), F.col("cov"))).alias("_v"))
    m = m.withColumn("weight", w[F.col("i")])
    every = Window.partitionBy()  # one row per named asset
    sd = F.sqrt(F.sum(F.col("weight") * F.col("_m")).over(every))
    m = m.withColumn("portfolio_std", sd).withColumn("_avg", F.sum(F.col("weight") * F.sqrt("_v")).over(every))
    s = F.col("portfolio_std")
    return m.select(
        F.col("i").alias("series_id"), "weight", div(F.col("_m"), s).alias("marginal_risk"),
        div(F.col("weight") * F.col("_m"), s).alias("component_risk"), div(F.col("weight") * F.col("_m"), s * s).alias("risk_share"),
        "portfolio_std", div(F.col("_avg"), s).alias("diversification_ratio"),
    )


def attribution(df: DataFrame, ret: str = "ret", weight: str = "w") -> DataFrame:
    """Summed weight times return per asset, and its share of the portfolio's sum."""
    a = df.groupBy("series_id").agg(F.sum(F.col(weight) * F.col(ret)).alias("contribution"))
    whole = a.agg(F.sum("contribution").alias("_all")).withColumn("_one", F.lit(1))  # one row
    shares = a.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one")
    return shares.select("series_id", "contribution", div(F.col("contribution"), F.col("_all")).alias("share"))


def stress(weights: DataFrame, scenarios: dict[str, dict[str, float]], weight: str = "w") -> DataFrame:
    """Sum of weight times shock per scenario; assets a scenario does not name are unshocked."""
    rows = [F.struct(F.lit(s).alias("scenario"), F.lit(a).alias("asset"), F.lit(float(x)).alias("shock")) for s, d in scenarios.items() for a, x in d.items()]
    hit = weights.withColumn("_s", F.explode(F.filter(F.array(*rows), lambda z: z["asset"] == F.col("series_id"))))
    return hit.groupBy(F.col("_s.scenario").alias("scenario")).agg(F.sum(F.col(weight) * F.col("_s.shock")).alias("impact"))
