"""Parameter grids, start dates, folds, walk-forward selection, stitched equity, bootstrap.

Strategy returns are computed once per parameter value; folds, starts and
replicates multiply only small block summaries or literal arrays afterwards.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import KEYS, expanding, explode_rows, ordered, stack_rows, trailing
from strandline.functions.scalar import div
from strandline.operators.fold import fold_episodes
from strandline.operators.recursive import BeliefReturns, PositionReturns


def grid(**axes: Sequence) -> list[dict]:
    """Cartesian product of named axes as literal rows for ``frames.explode_rows``."""
    names = list(axes)
    return [dict(zip(names, combo)) for combo in itertools.product(*axes.values())]


def rank_parameters(df: DataFrame, params: Sequence[str], k: int, strategy: str = "strategy", ret: str = "ret", keys=KEYS) -> DataFrame:
    """Excess return of every parameter combination and the k best per series."""
    from strandline.operators.evaluate import excess_return

    e = excess_return(df, strategy, ret, (*keys, *params))
    w = Window.partitionBy(*keys).orderBy(F.round("excess_return", 12).desc(), *params)
    return e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def from_starts(df: DataFrame, starts: Sequence[str], needs: Column) -> DataFrame:
    """Repeat rows per sample start that precedes ``needs``, the first date a row's signal uses.

    A signal computed once on the whole series equals the one computed on the
    sample as long as its window lies in the sample.
    """
    options = F.array(*[F.lit(s).cast("date") for s in starts])
    return df.withColumn("start", F.explode(F.filter(options, lambda s: s <= needs)))


def folds(train: int, test: int, step: int, rn: Column, last: Column) -> Column:
    """Array of (fold, part) that a row belongs to: rolling windows of train + test rows every ``step``.

    Membership is arithmetic on the row number; there is no fold table to join.
    Only folds with a complete test part are used.
    """
    if min(train, test, step) < 1:
        raise ValueError("train, test and step must be positive")
    t = rn - 1
    first = F.greatest(F.lit(0), F.ceil((t - (train + test - 1)) / step)).cast("int")
    final = F.least(F.floor(t / step), F.floor((last - train - test) / step)).cast("int")
    numbers = F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda f: F.struct(f.alias("fold"), F.when(t - f * step < train, "train").otherwise("test").alias("part")))


def assign_folds(df: DataFrame, train: int, test: int, step: int, keys=KEYS) -> DataFrame:
    every = Window.partitionBy(*keys)
    base = df.withColumn("_rn", F.row_number().over(ordered(keys))).withColumn("_last", F.count("*").over(every))
    out = base.withColumn("_f", F.explode(folds(train, test, step, F.col("_rn"), F.col("_last"))))
    return out.select(*df.columns, F.col("_f.fold").alias("fold"), F.col("_f.part").alias("part"))


def split_share(df: DataFrame, share: float, keys=KEYS) -> DataFrame:
    """Label the first ``share`` of each series train, the rest test."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rn = F.row_number().over(ordered(keys))
    return df.withColumn("part", F.when(rn <= F.floor(n * F.lit(share)), "train").otherwise("test"))


def split_date(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn("part", F.when(F.col("ts") <= F.lit(date).cast("date"), "train").otherwise("test"))


def fold_scores(df: DataFrame, train: int, test: int, step: int, params: Sequence[str], strategy: str = "strategy", keys=KEYS) -> DataFrame:
    """Total return and Sharpe of every parameter row in every fold part.

    Fold borders are multiples of g = gcd(train, test, step), so each strategy is
    first reduced to blocks of g rows (count, sum, squares, product); only blocks
    are repeated over folds.  Every parameter row must cover the same dates.
    """
    g = math.gcd(math.gcd(train, test), step)
    s = F.col(strategy)
    w = Window.partitionBy(*keys, *params)
    base = df.filter(s.isNotNull()).withColumn("_rn", F.row_number().over(w.orderBy("ts")))
    blocks = base.groupBy(*keys, *params, F.floor((F.col("_rn") - 1) / g).alias("_b")).agg(
        F.count("*").alias("_n"), F.sum(s).alias("_s"), F.sum(s * s).alias("_q"), F.product(1.0 + s).alias("_p")
    )
    last = F.sum("_n").over(w)
    first_row = F.col("_b") * g + 1
    rows = blocks.withColumn("_last", last).withColumn("_f", F.explode(folds(train, test, step, first_row, F.col("_last"))))
    out = rows.groupBy(*keys, *params, F.col("_f.fold").alias("fold"), F.col("_f.part").alias("part")).agg(
        F.sum("_n").alias("rows"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), (F.product("_p") - 1.0).alias("total_return")
    )
    mean = F.col("_s") / F.col("rows")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("rows") - mean * mean))
    return out.withColumn("sharpe", div(mean, sd)).drop("_s", "_q")


def walk_forward(df: DataFrame, train: int, test: int, step: int, params: Sequence[str], metric: str = "total_return", strategy: str = "strategy", keys=KEYS) -> DataFrame:
    """Per fold the parameters with the best training score, and their test score.

    Ties go to the smallest parameters.
    """
    return best_by_fold(fold_scores(df, train, test, step, params, strategy, keys), params, metric, keys)


def best_by_fold(scores: DataFrame, params: Sequence[str], metric: str = "total_return", keys=KEYS) -> DataFrame:
    """From scores by fold and part, the parameters with the best training score and their test score.

    Folds whose test part is not complete are left out.
    """
    value = lambda part: F.max(F.when(F.col("part") == part, F.col(metric)))
    tested = F.max((F.col("part") == "test").cast("int"))
    both = scores.groupBy(*keys, *params, "fold").agg(value("train").alias("train_score"), value("test").alias("test_score"), tested.alias("_tested"))
    order = F.struct(F.round("train_score", 12).alias("s"), *[(-F.col(p)).alias(p) for p in params], F.col("train_score").alias("tr"), F.col("test_score").alias("te"))
    best = both.filter(F.col("train_score").isNotNull() & (F.col("_tested") == 1)).groupBy(*keys, "fold").agg(F.max(order).alias("b"))
    return best.select(*keys, "fold", *[(-F.col(f"b.{p}")).alias(p) for p in params], F.col("b.tr").alias("train_score"), F.col("b.te").alias("test_score"))


def position_walk_forward(df: DataFrame, train: int, test: int, step: int, axes: dict[str, Sequence[float]], metric: str = "total_return", price: str = "value", ret: str = "ret", signal: str = "signal", keys=KEYS, **fixed) -> DataFrame:
    """Walk-forward choice of stop, take and size of the position machine, started flat in every part.

    ``axes`` names the parameters that are searched, ``fixed`` the others.
    """
    rows = explode_rows(df.select(*keys, "ts", price, ret, signal).filter(F.col(ret).isNotNull()), grid(**axes))
    make = lambda k: PositionReturns(**fixed, **{a: float(k[a]) for a in axes})
    scores = fold_episodes(rows, make, [price, ret, signal], train, test, step, [*keys, *axes])
    return best_by_fold(scores, list(axes), metric, keys)


def belief_walk_forward(df: DataFrame, train: int, test: int, step: int, windows: Sequence[int], gammas: Sequence[float], axes: dict[str, Sequence[float]], limits: tuple[float, float, float] = (0.0, 0.0, 0.0), metric: str = "total_return", ret: str = "ret", keys=KEYS) -> DataFrame:
    """Walk-forward choice for beliefs by market state, learned anew in every part.

    ``windows`` and ``gammas`` shape the states, which need no memory and may look back beyond the
    part's first row; ``axes`` are prior, entropy_limit and trade_limit.  Every combination covers
    the rows that the longest window covers.
    """
    from strandline.operators.signals import state_rows

    whole = F.count(ret).over(trailing(max(windows), keys)) == max(windows)
    base = df.filter(F.col(ret).isNotNull()).withColumn("_ok", whole)
    rows = state_rows(base, windows, gammas, limits, ret, keys).filter("_ok").select(*keys, "ts", ret, "n", "gamma", "state", "evidence")
    rows = explode_rows(rows, grid(**axes))
    make = lambda k: BeliefReturns(**{a: float(k[a]) for a in axes})
    params = ["n", "gamma", *axes]
    scores = fold_episodes(rows, make, [ret, "state", "evidence"], train, test, step, [*keys, *params])
    return best_by_fold(scores, params, metric, keys)


def out_of_sample(df: DataFrame, choice: DataFrame, train: int, test: int, step: int, params: Sequence[str], strategy: str = "strategy", keys=KEYS) -> DataFrame:
    """Strategy rows of each fold's test part under its chosen parameters."""
    rows = df.filter(F.col(strategy).isNotNull())
    tagged = assign_folds(rows, train, test, step, (*keys, *params)).filter("part = 'test'")
    return tagged.join(choice.select(*keys, "fold", *params), [*keys, "fold", *params]).select(*keys, "fold", "ts", strategy)


def stitch(df: DataFrame, rule: str = "multiply", strategy: str = "strategy", keys=KEYS) -> DataFrame:
    """Join the folds' equity curves: rebase on the previous end, add on gains, or plain append.

    Fold totals are one row per fold; their running product or sum is joined back.
    """
    if rule not in ("multiply", "add", "append"):
        raise ValueError(f"unknown stitching rule {rule!r}")
    inside = expanding((*keys, "fold"))
    base = df.withColumn("_e", F.product(1.0 + F.col(strategy)).over(inside))
    if rule == "append":
        return base.withColumn("equity", F.col("_e")).drop("_e")
    totals = df.groupBy(*keys, "fold").agg(F.product(1.0 + F.col(strategy)).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    if rule == "multiply":
        carry, value = F.coalesce(F.product("_t").over(before), F.lit(1.0)), F.col("_c") * F.col("_e")
    else:
        carry, value = F.coalesce(F.sum(F.col("_t") - 1.0).over(before), F.lit(0.0)), 1.0 + F.col("_c") + F.col("_e") - 1.0
    return base.join(totals.select(*keys, "fold", carry.alias("_c")), [*keys, "fold"]).withColumn("equity", value).drop("_e", "_c")


def block_bootstrap(df: DataFrame, windows: Sequence[int], length: int, replicates: int, ret: str = "ret", seed: int = 7, keys=KEYS) -> DataFrame:
    """Share of random blocks in which the rolling-mean rule earns less than its per-block average.

    The wealth of the block that starts at a row is one window product per rule,
    so a replicate is a lookup of its start row.  Starts come from an md5 of
    (series, replicate), so reruns and retried tasks draw the same blocks.
    """
    from strandline.operators.window import stat

    r = F.col(ret)
    base = df.filter(r.isNotNull())
    base = base.select("*", *[(1.0 + r * F.signum(stat("mean", r, trailing(n, keys, delay=1), n))).alias(f"_g{n}") for n in windows])
    w, every = ordered(keys), Window.partitionBy(*keys)
    base = base.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(every))
    cols = []
    for n in windows:
        # inside a block the first n rows have no signal; blocks are cut at the end of the series
        block = F.coalesce(F.product(f"_g{n}").over(w.rowsBetween(n, length - 1)), F.lit(1.0)) if n < length else F.lit(1.0)
        cols += [block.alias(f"_b{n}"), F.product(f"_g{n}").over(every).alias(f"_t{n}")]
    wealth = stack_rows(base.select(*keys, "_rn", *cols), [*keys, "_rn"], [{"n": n, "_block": F.col(f"_b{n}"), "_total": F.col(f"_t{n}")} for n in windows])
    size = base.groupBy(*keys).agg(F.max("_n").alias("_n"))
    draw = size.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("_rep").cast("string"), F.lit(str(seed)))
    hashed = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    starts = draw.withColumn("_rn", (hashed % (F.col("_n") - 1) + 1).cast("int")).select(*keys, "_rep", "_rn")
    limit = F.pow(F.greatest(F.col("_total"), F.lit(0.0)), F.lit(1.0 / length))
    return starts.join(wealth, [*keys, "_rn"]).groupBy(*keys, "n").agg(
        F.avg((F.col("_block") < limit).cast("double")).alias("share_below"), F.count("*").alias("replicates"), F.max("_total").alias("wealth")
    )


def moving_blocks(df: DataFrame, length: int, replicates: int, ret: str = "ret", seed: int = 7, keys=KEYS) -> DataFrame:
    """Mean, deviation and wealth of resamples of whole length, made of random blocks of consecutive rows.

    A replicate of n returns is ceil(n / length) blocks, the last one cut to the rows that are left.
    Its rows are never made: running totals of the returns, their squares and log growth are joined
    at both ends of each block, so a replicate costs two rows a block.  Starts come from an md5 of
    (keys, replicate, block, seed) and repeat after lost tasks.  A series shorter than a block gives
    itself.  A return of -1 ends with nothing; below it growth keeps its sign.
    """
    from strandline.operators.segment import number_rows, running

    r = F.col(ret)
    base = number_rows(df.filter(r.isNotNull()).select(*keys, "ts", r.cast("double").alias("_r")), keys)
    growth = 1.0 + F.col("_r")
    totals = {
        "_sum": F.col("_r"), "_squares": F.col("_r") * F.col("_r"), "_log": F.when(growth != 0, F.log(F.abs(growth))).otherwise(0.0),
        "_zero": F.when(growth == 0, 1.0).otherwise(0.0), "_minus": F.when(growth < 0, 1.0).otherwise(0.0),
    }
    path = running(base, {k: (v, "sum") for k, v in totals.items()}, keys=keys).select(*keys, "rn", *totals)
    size = base.groupBy(*keys).agg(F.count("*").alias("_n"))
    draws = size.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).repartition(*keys, "replicate")
    draws = draws.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / length) - 1)))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("replicate").cast("string"), F.col("_block").cast("string"), F.lit(str(seed)))
    start = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.greatest(F.lit(1).cast("long"), F.col("_n") - length + 1)
    draws = draws.withColumn("_from", start).withColumn("_to", F.col("_from") + F.least(F.lit(length).cast("long"), F.col("_n") - F.col("_block") * length))
    ends = F.array(F.struct(F.col("_from").alias("rn"), F.lit(-1.0).alias("sign")), F.struct(F.col("_to").alias("rn"), F.lit(1.0).alias("sign")))
    marks = draws.select(*keys, "replicate", "_n", F.explode(ends).alias("_e")).select(*keys, "replicate", "_n", F.col("_e.rn").cast("long").alias("rn"), F.col("_e.sign").alias("_sign")).filter("rn > 0")
    s = marks.join(path, [*keys, "rn"]).groupBy(*keys, "replicate").agg(F.max("_n").alias("n"), *[F.sum(F.col("_sign") * F.col(k)).alias(k) for k in totals])
    mean = F.col("_sum") / F.col("n")
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") - F.col("n") * mean * mean) / (F.col("n") - 1)))
    wealth = F.when(F.round("_zero") > 0, 0.0).otherwise(F.exp("_log") * F.when(F.round("_minus") % 2 == 1, -1.0).otherwise(1.0))
    return s.select(*keys, "replicate", "n", mean.alias("mean"), spread.alias("deviation"), wealth.alias("wealth"))


def blend_sweep(df: DataFrame, col: str, h: int, lambdas: Sequence[float], mean_window: int = 30, keys=KEYS) -> DataFrame:
    """MAE and RMSE of the mean-reverting blend for every lambda; the path is computed once."""
    from strandline.frames import explode_rows
    from strandline.operators.forecast import kinematic
    from strandline.operators.window import stat

    base = kinematic(df, col, h, keys=keys)
    x, w = F.col(col), trailing(mean_window, keys)
    base = base.select(*keys, "ts", "forecast", stat("mean", x, w, mean_window).alias("_mu"), F.lead(col, h).over(ordered(keys)).alias("_y")).dropna()
    rows = explode_rows(base, [{"lambda": float(v)} for v in lambdas])
    e = F.col("_y") - ((1.0 - F.col("lambda")) * F.col("forecast") + F.col("lambda") * F.col("_mu"))
    s = rows.groupBy(*keys, "lambda").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))
    best = Window.partitionBy(*keys).orderBy(F.round("mae", 12), "lambda")
    return s.withColumn("rank", F.row_number().over(best))


def posterior_search(df: DataFrame, windows: Sequence[int], alphas: Sequence[float], betas: Sequence[float], refit_every: int = 1, ret: str = "ret", keys=KEYS) -> DataFrame:
    """Trade the posterior-mean rule whose parameters have had the least relative wealth so far.

    Relative wealth is holding over the rule.  All combinations live in arrays of
    one row, so the search adds no rows; a rule must beat holding to be chosen,
    otherwise the row is long.  Parameters found at the first row of an epoch
    serve ``refit_every`` rows, with signals updated.
    """
    r, w, run = F.col(ret), ordered(keys), expanding(keys)
    combos = grid(n=windows, a=alphas, b=betas)
    base = df.filter(r.isNotNull())
    pos = (r >= 0).cast("double")
    sums = {n: F.sum(pos).over(trailing(n, keys)) for n in windows}
    full = {n: F.count(pos).over(trailing(n, keys)) == n for n in windows}
    signal = [F.when(full[c["n"]], F.when((sums[c["n"]] + c["a"]) / (c["a"] + c["b"] + c["n"]) >= 0.5, 1.0).otherwise(-1.0)).alias(f"_f{i}") for i, c in enumerate(combos)]
    base = base.select("*", *signal)
    base = base.select("*", *[F.lag(f"_f{i}").over(w).alias(f"_p{i}") for i in range(len(combos))])
    rel = [
        div(F.product(F.when(F.col(f"_p{i}").isNotNull(), 1.0 + r)).over(run), F.product(1.0 + r * F.col(f"_p{i}")).over(run)).alias(f"_w{i}") for i in range(len(combos))
    ]
    base = base.select("*", *rel, (F.row_number().over(w) - 1).alias("_t"))
    scores = F.array(*[F.round(F.coalesce(F.col(f"_w{i}"), F.lit(1.0)), 12) for i in range(len(combos))])
    base = base.withColumn("_s", scores)
    best = F.when(F.array_min("_s") < 1.0, F.array_position("_s", F.array_min("_s")).cast("int"))
    base = base.withColumn("_best", best).withColumn("_epoch", F.floor(F.col("_t") / refit_every))
    held = F.first("_best").over(Window.partitionBy(*keys, "_epoch").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    base = base.withColumn("_k", held).withColumn("_sig", F.coalesce(F.get(F.array(*[F.col(f"_f{i}") for i in range(len(combos))]), F.col("_k") - 1), F.lit(1.0)))
    ready = F.col("_t") >= max(windows)
    pick = lambda key: F.get(F.array(*[F.lit(float(c[key])) for c in combos]), F.col("_k") - 1)
    return base.select(
        *df.columns, F.when(ready, F.lag(pick("n")).over(w)).alias("n"), F.when(ready, F.lag(pick("a")).over(w)).alias("alpha"),
        F.when(ready, F.lag(pick("b")).over(w)).alias("beta"), F.when(ready, r * F.lag("_sig").over(w)).alias("strategy"),
    )
