"""End-to-end plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.operators import evaluate, signals, window
from strandline.sources import panels


def rolling_mean_verdict(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """Did following the sign of the rolling mean beat holding, per series?

    Ticks to daily bars (map-side aggregate), growth rates, rolling mean, sign
    rule, equity, performance table.
    """
    bars = panels.returns(panels.daily_events(spark, path))
    signal = window.rolling(bars, "ret", n, ["mean"])
    trades = signals.follow_sign(signal, "mean").filter(F.col("strategy").isNotNull())
    perf = evaluate.performance_annual(trades, 252, "strategy", benchmark="ret")
    return perf.select(
        "series_id", "periods", "sharpe", F.col("total_return").alias("strategy_return"), "hold_return", "excess_return", "max_drawdown",
        (F.col("excess_return") > 0).alias("beats_holding"),
    )
