"""Nowcast of a slow series from the latest values of faster ones.

``recent_values`` turns fast bars into features of the slow dates, ``expanding_net`` refits an
elastic net before every row from running moments, ``ar_benchmark`` is the forecast to beat.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import expanding, ordered
from strandline.operators.fold import ordered_fold

DAY = "datediff({}, date'1970-01-01')"


def recent_values(bars: DataFrame, dates: DataFrame, series: Sequence[str], col: str, days: int, least: int, count: int) -> DataFrame:
    """(ts, <series>_1 .. <series>_count): the newest values of each named series at every date.

    Looks at the non-null values dated from ``days`` days before a date up to the date itself,
    _1 being the newest; where fewer than ``least`` are there, or a value is missing, the date
    takes what the date before had.  ``dates`` has a column ts; bars are one a series and day.
    Dates join the bars as rows without a value, so one range frame by series finds the values;
    a frame holds ``days`` + 1 bars at most.
    """
    if min(days, least, count) < 1 or not series:
        raise ValueError("days, least and count must be positive and a series named")
    names = list(dict.fromkeys(series))
    marks = dates.select(F.explode(F.array(*map(F.lit, names))).alias("series_id"), "ts").distinct()
    rows = bars.filter(F.col("series_id").isin(names)).select("series_id", "ts", F.col(col).cast("double").alias("x"), F.lit(False).alias("mark"))
    rows = rows.unionByName(marks.select("*", F.lit(None).cast("double").alias("x"), F.lit(True).alias("mark")))
    frame = Window.partitionBy("series_id").orderBy(F.expr(DAY.format("ts"))).rangeBetween(-days, 0)
    seen = rows.select("series_id", "ts", "mark", F.collect_list("x").over(frame).alias("seen")).filter("mark")
    enough = F.when(F.size("seen") >= least, F.reverse("seen"))
    before = expanding()
    filled = seen.select("series_id", "ts", *[F.last(F.get(enough, F.lit(i)), ignorenulls=True).over(before).alias(f"_{i + 1}") for i in range(count)])
    return filled.groupBy("ts").agg(*[F.max(F.when(F.col("series_id") == n, F.col(f"_{i + 1}"))).alias(f"{n}_{i + 1}") for n in names for i in range(count)])


def coordinate_descent(gram: np.ndarray, cross: np.ndarray, l1: float, l2: float, start: np.ndarray, tolerance: float = 1e-11, sweeps: int = 20_000) -> np.ndarray:
    """Weights w with the least w'Gw / 2 - c'w + l1 |w| + l2 w'w / 2, from a start; a variable without variance keeps zero."""
    w = start.copy()
    slack = cross - gram @ w
    scale = gram.diagonal()
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            pull = slack[j] + scale[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (scale[j] + l2)
            step = new - w[j]
            if step != 0.0:
                slack -= gram[:, j] * step
                w[j] = new
                moved = max(moved, abs(step))
        if moved <= tolerance:
            break
    return w


def optimality_gap(gram: np.ndarray, cross: np.ndarray, l1: float, l2: float, w: np.ndarray) -> float:
    """How far weights are from the conditions of the minimum: zero at the solution."""
    slope = cross - gram @ w - l2 * w
    gap = np.where(w != 0, np.abs(slope - l1 * np.sign(w)), np.maximum(np.abs(slope) - l1, 0.0))
    return float(gap[gram.diagonal() > 0].max(initial=0.0))


class NetStep:
    """Running moments of (features, label), one weight vector a penalty, and its past errors."""

    def __init__(self, features: int, first: int, penalties: Sequence[float], mix: float):
        self.first, self.penalties, self.mix = first, list(penalties), mix
        self.n = 0
        self.mean = np.zeros(features + 1)
        self.products = np.zeros((features + 1, features + 1))
        self.weights = [np.zeros(features) for _ in self.penalties]
        self.errors = np.zeros(len(self.penalties))

    def row(self, x: Sequence[float], y: float) -> tuple | None:
        z = np.append(np.asarray(x, dtype=float), y)
        if not np.isfinite(z).all():
            return None
        out = self._forecast(z) if self.n >= self.first else None
        self.n += 1
        off = z - self.mean
        self.mean += off / self.n
        self.products += np.outer(off, z - self.mean)
        return out

    def _forecast(self, z: np.ndarray) -> tuple:
        cov = self.products / self.n
        sd = np.sqrt(cov.diagonal()[:-1].clip(0))
        unit = np.where(sd > 1e-12 * np.abs(self.mean[:-1]), sd, np.inf)  # a constant feature weighs nothing
        gram, cross = cov[:-1, :-1] / np.outer(unit, unit), cov[:-1, -1] / unit
        now = (z[:-1] - self.mean[:-1]) / unit
        best = int(self.errors.argmin())
        made, gap = [], 0.0
        for k, a in enumerate(self.penalties):
            l1, l2 = a * self.mix, a * (1.0 - self.mix)
            w = self.weights[k] = coordinate_descent(gram, cross, l1, l2, self.weights[k])
            made.append(float(self.mean[-1] + now @ w))
            gap = max(gap, optimality_gap(gram, cross, l1, l2, w))
        self.errors += (np.array(made) - z[-1]) ** 2
        return made[best], self.penalties[best], self.n, int((self.weights[best] != 0).sum()), gap


def expanding_net(df: DataFrame, label: str, features: Sequence[str], first: int, penalties: Sequence[float] = (0.0,), mix: float = 0.5, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Elastic net refitted before every row on all complete earlier rows of its key.

    Columns: keys, ts, actual, forecast, penalty, n (training rows), used (features with a
    weight) and gap, the largest violation of the minimum's conditions over all penalties.
    Features are scaled by the training rows.  The penalty of a row is the one whose forecasts of
    earlier rows had the least squared error (the first of the list before there are any, and in
    ties).  Rows with a null are left out; the first ``first`` complete ones only train.  State is
    the matrix of second moments, so a refit costs by the features, never by the rows.
    """
    if first < 2 or not penalties or min(penalties) < 0 or not 0 <= mix <= 1:
        raise ValueError("needs first of 2 or more, penalties of 0 or more and a mix from 0 to 1")
    p, grid = len(features), [float(a) for a in penalties]
    rows = df.dropna(subset=[label, *features]).select(*keys, "ts", F.col(label).cast("double").alias("actual"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    return ordered_fold(rows, lambda key: NetStep(p, first, grid, mix), ["_x", "actual"], "forecast double, penalty double, n bigint, used int, gap double", keys=keys, keep=["actual"])


def ar_benchmark(df: DataFrame, label: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Adds ``benchmark``: the AR(1) forecast of a row, fitted on all earlier pairs of its key."""
    y = F.col(label)
    d = df.withColumn("_before", F.lag(y).over(ordered(keys)))
    past = expanding(keys, delay=1)
    slope, level = F.regr_slope(y, F.col("_before")).over(past), F.regr_intercept(y, F.col("_before")).over(past)
    return d.withColumn("benchmark", level + slope * F.col("_before")).drop("_before")
