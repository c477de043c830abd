"""Information, dependence and distribution-distance measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import KEYS, ordered, stack_rows, trailing
from strandline.functions.scalar import div, norm_cdf


def proximity_components(df: DataFrame, col: str, n: int, eps: float, keys=KEYS) -> DataFrame:
    """Connected groups of nearby values over nodes with a neighbour, per window.

    Values lie on a line, so groups are runs of gaps below eps in sorted order;
    no pair of rows is formed.  A window without any close pair gives 0.5.
    """
    x, w = F.col(col), trailing(n, keys)
    values = F.when(F.count(x).over(w) == n, F.array_sort(F.collect_list(x).over(w)))
    start = F.struct(F.lit(None).cast("double").alias("prev"), F.lit(False).alias("near"), F.lit(0).alias("starts"), F.lit(0).alias("edges"))

    def scan(acc, v):
        near = F.coalesce(v - acc["prev"] < eps, F.lit(False))
        return F.struct(
            v.alias("prev"), near.alias("near"),
            (acc["starts"] + (near & ~acc["near"]).cast("int")).alias("starts"), (acc["edges"] + near.cast("int")).alias("edges"),
        )

    base = df.withColumn("_g", F.aggregate(values, start, scan))
    base = base.withColumn("components", F.col("_g.starts")).withColumn("nodes", F.col("_g.edges") + F.col("_g.starts"))
    return base.withColumn("persistence", F.coalesce(div(F.col("components"), F.col("nodes")), F.when(F.col("nodes") == 0, 0.5))).drop("_g")


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int, keys=KEYS) -> DataFrame:
    """Plug-in mutual information (nats) of each feature with the target, on equal-count bins, ranked.

    Binning replaces a nearest-neighbour estimator: counts add up across tasks,
    neighbour distances do not.
    """
    long = stack_rows(df.filter(F.col(target).isNotNull()), [*keys, "ts", target], [{"feature": f, "x": F.col(f).cast("double")} for f in features])
    group = [*keys, "feature"]
    long = long.filter(F.col("x").isNotNull())
    b = lambda c: F.ntile(bins).over(Window.partitionBy(*group).orderBy(c, "ts"))
    cells = long.select(*group, b("x").alias("_bx"), b(target).alias("_by")).groupBy(*group, "_bx", "_by").agg(F.count("*").alias("_n"))
    tot = lambda *more: F.sum("_n").over(Window.partitionBy(*group, *more))
    n, nx, ny = tot(), tot("_bx"), tot("_by")
    # products of counts as doubles: they overflow longs on large panels
    dbl = lambda c: c.cast("double")
    term = dbl(F.col("_n")) / n * F.log(dbl(F.col("_n")) * dbl(n) / (dbl(nx) * dbl(ny)))
    s = cells.withColumn("_i", term).groupBy(*group).agg(F.sum("_i").alias("mutual_information"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("mutual_information").desc(), "feature")))


def transfer_entropy(df: DataFrame, source: str, target: str, keys=KEYS) -> DataFrame:
    """Bits the past sign of the source adds to the past sign of the target about its next sign."""
    w = ordered(keys)
    up = lambda c: F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("int"))
    s = df.select(*keys, F.lead(up(target)).over(w).alias("_n"), up(target).alias("_y"), up(source).alias("_x")).dropna()
    c = s.groupBy(*keys, "_n", "_y", "_x").agg(F.count("*").alias("_c"))
    tot = lambda *k: F.sum("_c").over(Window.partitionBy(*keys, *k)).cast("double")
    n, nyx, nny, ny = tot(), tot("_y", "_x"), tot("_n", "_y"), tot("_y")
    term = F.col("_c") / n * F.log2(F.col("_c") / nyx / (nny / ny))
    return c.withColumn("_t", term).groupBy(*keys).agg(F.sum("_t").alias("transfer_entropy"), F.sum("_c").alias("n"))


def exponential_distance(df: DataFrame, col: str, keys=KEYS) -> DataFrame:
    """Exponential fit (location = minimum) and its largest distance from the empirical distribution."""
    x = F.col(col)
    w = Window.partitionBy(*keys)
    rows = df.filter(x.isNotNull())
    r = F.row_number().over(w.orderBy(col))
    n = F.count("*").over(w)
    loc, mean = F.min(x).over(w), F.avg(x).over(w)
    rows = rows.select(*keys, x.alias("_x"), r.alias("_r"), n.alias("_n"), loc.alias("_loc"), (mean - loc).alias("_scale"))
    cdf = 1.0 - F.exp(-div(F.col("_x") - F.col("_loc"), F.col("_scale")))
    gap = F.greatest(F.abs(F.col("_r") / F.col("_n") - cdf), F.abs(cdf - (F.col("_r") - 1) / F.col("_n")))
    return rows.groupBy(*keys).agg(F.max(gap).alias("distance"), F.max("_loc").alias("location"), F.max("_scale").alias("scale"), F.count("*").alias("n"))


def cumulative_line(df: DataFrame, col: str, keys=KEYS) -> DataFrame:
    """Line fitted to the running sum of |col| over row numbers from zero."""
    w = ordered(keys)
    base = df.filter(F.col(col).isNotNull()).select(
        *keys, F.sum(F.abs(col)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"), (F.row_number().over(w) - 1).cast("double").alias("_t")
    )
    return base.groupBy(*keys).agg(F.regr_slope("_s", "_t").alias("slope"), F.regr_intercept("_s", "_t").alias("intercept"), F.regr_r2("_s", "_t").alias("r2"))


def normal_chi_square(df: DataFrame, col: str, bins: int, keys=KEYS, minimum: float = 5.0) -> DataFrame:
    """Sum of (observed - expected)^2 / expected of a fitted normal, over bins expecting at least ``minimum``."""
    from strandline.operators.align import bounded_broadcast

    x = F.col(col)
    rows = df.filter(x.isNotNull())
    fit = rows.groupBy(*keys).agg(F.count(x).alias("_n"), F.avg(x).alias("_mu"), F.stddev_pop(x).alias("_sd"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    fit = bounded_broadcast(fit)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor(div(x - F.col("_lo"), width)), F.lit(bins - 1))
    seen = rows.join(fit, list(keys)).groupBy(*keys, b.cast("int").alias("_b")).agg(F.count("*").alias("_o"))
    allbins = fit.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    z = lambda k: div(F.col("_lo") + k * width - F.col("_mu"), F.col("_sd"))
    cells = allbins.join(seen, [*keys, "_b"], "left").withColumn("_e", F.col("_n") * (norm_cdf(z(F.col("_b") + 1)) - norm_cdf(z(F.col("_b")))))
    used = cells.filter(F.col("_e") >= minimum)
    o = F.coalesce(F.col("_o"), F.lit(0))
    return used.groupBy(*keys).agg(F.sum((o - F.col("_e")) ** 2 / F.col("_e")).alias("chi_square"), F.count("*").alias("bins_used"))
