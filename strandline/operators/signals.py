"""Signals, positions and strategies that need no recursion.

A strategy row is the period's return times the sign of an earlier signal.
Parameter values are rows (``n``, ``kappa``, ...), produced after all frames
have been evaluated on one sort of the panel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import KEYS, expanding, explode_rows, ordered, stack_rows, trailing, whole
from strandline.functions.scalar import corr_from, div, norm_cdf
from strandline.operators.window import stat


def follow_sign(df: DataFrame, signal: str, ret: str = "ret", delay: int = 1, long_only: bool = False, keys=KEYS, out: str = "strategy") -> DataFrame:
    """r_t times the sign of the signal ``delay`` rows earlier, or r_t where that signal is non-negative."""
    s = F.lag(signal, delay).over(ordered(keys)) if delay else F.col(signal)
    position = F.when(s.isNotNull(), (s >= 0).cast("double")) if long_only else F.signum(s)
    return df.withColumn(out, F.col(ret) * position)


def rotate(wide: DataFrame, a: str, b: str, n: int, short: bool = False, order: str = "ts") -> DataFrame:
    """Hold asset a or b by the sign of the lagged rolling mean of their wealth difference.

    ``wide`` has one row per date with both returns.  The pair is a key, so many
    pairs may share one frame.  With ``short`` the spread is traded both ways.
    """
    keys = ("pair",)
    base = wide if "pair" in wide.columns else wide.withColumn("pair", F.lit(f"{a}~{b}"))
    base = base.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    w = expanding(keys, order)
    base = base.withColumn("_d", F.product(1.0 + F.col(a)).over(w) - F.product(1.0 + F.col(b)).over(w))
    s = F.signum(stat("mean", F.col("_d"), trailing(n, keys, order, delay=1), n))
    base = base.withColumn("signal", s)
    spread = F.col(a) - F.col(b)
    hold = F.when(F.col("signal") > 0, -spread if short else F.col(b)).when(F.col("signal") <= 0, spread if short else F.col(a))
    return base.withColumn("rotation", hold).drop("_d")


def mean_and_probability(df: DataFrame, ret: str, n: int, prob: float = 0.5, keys=KEYS) -> DataFrame:
    """Mean with, or instead of, the share of errors below minus the mean, all known one row earlier."""
    from strandline.operators.window import error_tail_share

    w = ordered(keys)
    base = error_tail_share(df, ret, n, keys)
    base = base.withColumn("_m", F.lag("mean").over(w)).withColumn("_p", F.lag("tail_share").over(w))
    m, p, r = F.col("_m"), F.col("_p"), F.col(ret)
    known = m.isNotNull() & p.isNotNull()
    both = F.when((m > 0) & (p <= prob), r).when((m < 0) & (p > prob), -r).otherwise(0.0)
    either = F.when((m > 0) | (p <= prob), r).when((m < 0) | (p > prob), -r).otherwise(0.0)
    return base.select(
        *df.columns, F.when(known, both).alias("mean_and_prob"), F.when(known, either).alias("mean_or_prob"), F.when(known, r * F.signum(m)).alias("mean_only")
    )


def volume_price_rules(df: DataFrame, n: int, smooth: int = 7, price: str = "value", volume: str = "volume", keys=KEYS, rolling_scale: bool = False) -> DataFrame:
    """Four rules from the agreement of scaled price change and scaled log volume.

    vs1: sign of the mean price change against the last volume score; vs2: the
    reverse of the last price change against the mean score; vs3 and vs4: sign of
    the correlation with the score, and with the score one row earlier.
    """
    from strandline.operators.transform import iso_elastic, log_volume_ratio

    base = log_volume_ratio(iso_elastic(df, price, keys), smooth, volume, keys)
    base = base.withColumn("_rho", F.col("rho_rolling" if rolling_scale else "rho_expanding"))
    base = base.filter(F.col("_rho").isNotNull() & F.col("iso_ret").isNotNull() & F.col("ret").isNotNull())
    w = ordered(keys)
    d, rho, r = F.col("iso_ret"), F.col("_rho"), F.col("ret")
    base = base.withColumn("_rho1", F.lag(rho).over(w))
    past, inner = trailing(n, keys, delay=1), trailing(n - 1, keys, delay=1)
    full = F.count(d).over(past) == n
    agree = F.signum(F.avg(d).over(past)) == F.signum(F.lag(rho).over(w))
    oppose = F.signum(F.lag(d).over(w)) == F.signum(F.avg(rho).over(past))
    return base.select(
        *df.columns,
        F.when(full, F.when(agree, r).otherwise(-r)).alias("vs1"),
        F.when(full, F.when(oppose, -r).otherwise(r)).alias("vs2"),
        F.when(full, r * F.signum(corr_from(rho, d, past))).alias("vs3"),
        F.when(full, r * F.signum(corr_from(F.col("_rho1"), d, inner))).alias("vs4"),
    )


def bubble(df: DataFrame, windows: Sequence[int], thresholds: dict[str, float | str], ret: str = "ret", keys=KEYS) -> DataFrame:
    """Short (-1) where the compounded return less half its variance times n exceeds a threshold, else long.

    Thresholds are numbers, or ``variance`` / ``deviation`` of the window.  One row
    per (row, n, threshold); the signal is already lagged by one row.
    """
    x = F.col(ret)
    wide = df
    for n in windows:
        w = trailing(n, keys, delay=1)
        wide = wide.select("*", stat("compound", x, w, n).alias(f"_c{n}"), stat("var", x, w, n).alias(f"_v{n}"))
    rows = []
    for n in windows:
        c, v = F.col(f"_c{n}"), F.col(f"_v{n}")
        for name, t in thresholds.items():
            limit = v if t == "variance" else F.sqrt(v) if t == "deviation" else F.lit(float(t))
            rows.append({"n": n, "threshold": name, "signal": F.when(v.isNotNull(), F.when(c - 0.5 * v * n > limit, -1.0).otherwise(1.0))})
    return stack_rows(wide, [*keys, "ts", ret], rows)


def average_signal(df: DataFrame, keys: Sequence[str], ret: str = "ret", signal: str = "signal") -> DataFrame:
    """Mean signal over windows at each row (all windows required), and its strategy."""
    g = df.groupBy(*keys, "ts").agg(F.avg(signal).alias("average"), F.max(ret).alias(ret), F.count(signal).alias("_n"), F.count("*").alias("_m"))
    ok = F.col("_n") == F.col("_m")
    return g.withColumn("average", F.when(ok, F.col("average"))).withColumn("strategy", F.col(ret) * F.signum("average")).drop("_n", "_m")


def abc_pattern(df: DataFrame, alpha: int, beta: int, gamma: int, delay: int = 1, col: str = "ret", keys=KEYS) -> DataFrame:
    """Buy after alpha gains, sell after beta gains, buy again after alpha losses with a gain in the last gamma."""
    w, x = ordered(keys), F.col(col)
    past = lambda k: w.rowsBetween(-k, -1)
    known = F.count(x).over(past(max(alpha, beta, gamma))) == max(alpha, beta, gamma)
    s = (
        F.when(~known, 0)
        .when(F.min(x).over(past(alpha)) > 0, 1)
        .when(F.min(x).over(past(beta)) > 0, -1)
        .when((F.max(x).over(past(alpha)) < 0) & (F.max(x).over(past(gamma)) > 0), 1)
        .otherwise(0)
    )
    base = df.filter(x.isNotNull()).withColumn("_s", s)
    return base.withColumn("signal", F.coalesce(F.lag("_s", delay).over(w), F.lit(0))).drop("_s")


def discounted(df: DataFrame, n: int, kappas: Sequence[float], level: str = "value", rate: str = "rate", change: str | None = None, keys=KEYS) -> DataFrame:
    """Sign of beta (y + drift + kappa sd - dr) - y per kappa, with beta = 1 / (1 + max(rate change, 0))."""
    w = ordered(keys)
    base = df.withColumn("_d", F.col(change) if change else F.col(level) - F.lag(level).over(w)).withColumn("_dr", F.col(rate) - F.lag(rate).over(w))
    past = trailing(n, keys, delay=1)
    drift, sd = stat("mean", F.col("_d"), past, n), stat("std", F.col("_d"), past, n)
    base = base.select("*", drift.alias("_mu"), sd.alias("_sd"), F.lag(level).over(w).alias("_y"), F.lag("_dr").over(w).alias("_r"))
    y, r = F.col("_y"), F.col("_r")
    beta = 1.0 / (1.0 + F.greatest(r, F.lit(0.0)))
    value = lambda k: beta * (y + F.col("_mu") + k * F.col("_sd") - r) - y
    rows = [{"kappa": float(k), "signal": F.signum(F.when(F.col("_mu").isNotNull() & r.isNotNull(), value(float(k))))} for k in kappas]
    return stack_rows(base, df.columns, rows)


def probability_ratio_signals(df: DataFrame, delay: int, indicator_n: int, estimate_n: int, ret: str = "ret", keys=KEYS) -> DataFrame:
    """Four strategies s00..s03 from delayed signs and ratios of rolling loss shares."""
    w, x = ordered(keys), F.col(ret)
    base = df.filter(x.isNotNull())
    if indicator_n > 0:
        ind = stat("sum", x, trailing(indicator_n, keys, delay=delay), indicator_n)
    else:
        ind = F.lag(x, delay).over(w)
    base = base.withColumn("_i", ind).withColumn("_r", F.lag(x, delay).over(w))
    loss = (x < 0).cast("double")
    # an unknown indicator counts as no loss, as a comparison with a missing value is false
    iloss = F.coalesce((F.col("_i") < 0).cast("double"), F.lit(0.0))
    top = stat("mean", loss, trailing(estimate_n, keys, delay=1), estimate_n)
    bottom = stat("mean", loss, trailing(estimate_n, keys, delay=1 + delay), estimate_n)
    ibottom = stat("mean", iloss, trailing(estimate_n, keys, delay=delay), estimate_n)
    base = base.select("*", top.alias("_t"), bottom.alias("_b"), ibottom.alias("_ib"), F.lag("_i", delay).over(w).alias("_id"))

    def ratio_sign(num: Column, den: Column, hit: Column) -> Column:
        # x / 0 is infinite: the signal is -1 where it counts and undefined for 0 / 0 or no loss
        known = num.isNotNull() & den.isNotNull()
        finite = F.signum(1.0 - 2.0 * F.try_divide(num, den) * hit.cast("double"))
        return F.when(known, F.when(den != 0, finite).when((num > 0) & hit, -1.0))

    before = F.col("_r") < 0
    return base.select(
        *df.columns,
        (x * F.when(F.col("_r").isNotNull(), F.when(before, -1.0).otherwise(1.0))).alias("s00"),
        (x * F.when(F.col("_i").isNotNull(), F.when(F.col("_i") < 0, -1.0).otherwise(1.0))).alias("s01"),
        (x * ratio_sign(F.col("_t"), F.col("_b"), before)).alias("s02"),
        (x * ratio_sign(F.col("_t"), F.col("_ib"), F.coalesce(F.col("_id") < 0, F.lit(False)))).alias("s03"),
    )


def automatic_window(df: DataFrame, windows: Sequence[int], ret: str = "ret", tie: str = "min", use_signs: bool = True, wealth_n: int | None = None, keys=KEYS) -> DataFrame:
    """At each row use the forecast of the window whose strategy has earned most so far.

    Ties are settled by the min, median, mean or max (rounded down) of the tied
    windows.  Everything per row is an array over windows, so nothing multiplies.
    """
    if tie not in ("min", "median", "mean", "max"):
        raise ValueError(f"unknown tie rule {tie!r}")
    w, r = ordered(keys), F.col(ret)
    base = df.filter(r.isNotNull()).withColumn("_y", F.signum(r) if use_signs else r)
    base = base.select("*", *[F.signum(stat("mean", F.col("_y"), trailing(n, keys), n)).alias(f"_f{n}") for n in windows])
    base = base.select("*", *[(1.0 + r * F.lag(f"_f{n}").over(w)).alias(f"_g{n}") for n in windows])
    if wealth_n:
        grown = [stat("compound", F.col(f"_g{n}") - 1.0, trailing(wealth_n, keys), wealth_n) for n in windows]
    else:
        grown = [F.when(F.col(f"_g{n}").isNotNull(), F.product(f"_g{n}").over(expanding(keys)) - 1.0) for n in windows]
    ns = F.array(*[F.lit(int(n)) for n in windows])
    base = base.withColumn("_w", F.transform(F.array(*grown), lambda v: F.round(v, 12))).withColumn("_top", F.array_max("_w"))
    tied = F.filter(ns, lambda n, i: F.get("_w", i) == F.col("_top"))
    base = base.withColumn("_tied", F.when(F.col("_top").isNotNull(), tied))
    m = F.size("_tied")
    mean = F.floor(F.aggregate("_tied", F.lit(0), lambda a, b: a + b) / m)
    median = F.floor((F.get("_tied", F.floor((m - 1) / 2).cast("int")) + F.get("_tied", F.floor(m / 2).cast("int"))) / 2)
    pick = {"min": F.array_min("_tied"), "max": F.array_max("_tied"), "mean": mean, "median": median}[tie]
    base = base.withColumn("window", F.when(F.col("_top").isNotNull(), pick.cast("int")))
    # a mean or median of tied windows need not be a listed length: use the nearest one below
    at = F.size(F.filter(ns, lambda n: n <= F.col("window"))) - 1
    base = base.withColumn("forecast", F.get(F.array(*[F.col(f"_f{n}") for n in windows]), at))
    return base.withColumn("strategy", r * F.lag("forecast").over(w)).select(*df.columns, "window", "forecast", "strategy")


def wealth_rotation(df: DataFrame, choice: str, ret: str, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """Each period's return of the choice with most wealth one period earlier.

    ``df`` has one row per (keys, ts, choice) and complete dates.  The smallest
    choice wins ties; the first period uses that period's own leader.
    """
    w = expanding((*keys, choice), order)
    base = df.withColumn("_w", F.round(F.product(1.0 + F.col(ret)).over(w), 12))
    lead = F.struct(F.col("_w").alias("w"), (-F.col(choice)).alias("c"))
    leader = base.groupBy(*keys, order).agg(
        (-F.max(lead)["c"]).alias("leader"), F.map_from_entries(F.collect_list(F.struct(F.col(choice).alias("k"), F.col(ret).alias("v")))).alias("_m")
    )
    chosen = F.coalesce(F.lag("leader").over(ordered(keys, order)), F.col("leader"))
    return leader.withColumn("chosen", chosen).withColumn("rotation", F.try_element_at("_m", F.col("chosen"))).drop("_m")


CODE_BITS = ("momentum", "volatility", "skewness", "kurtosis", "utility", "max_drawdown")


def six_attributes(df: DataFrame, n: int = 20, risk_aversion: float = 1.0, delay: int = 1, price: str = "value", ret: str = "ret", keys=KEYS) -> DataFrame:
    """Lagged rolling momentum, deviation, shape, utility and drawdown.

    Utility uses the already lagged deviation and is lagged again, as the rule
    that defines it does.
    """
    from strandline.operators.window import rolling_drawdown, rolling_shape

    x, wl, w0 = F.col(ret), ordered(keys), trailing(n, keys)
    base = rolling_drawdown(rolling_shape(df, ret, n, keys), n, price, keys)
    base = base.select(
        "*", stat("compound", x, trailing(n, keys, delay=delay), n).alias("momentum"), stat("std", x, trailing(n, keys, delay=delay), n).alias("volatility"), stat("mean", x, w0, n).alias("_mu")
    )
    base = base.withColumn("_u", F.col("_mu") - risk_aversion * F.col("volatility") * F.col("volatility"))
    return base.select(
        *df.columns, "momentum", "volatility", F.lag("skew", delay).over(wl).alias("skewness"), F.lag("kurt", delay).over(wl).alias("kurtosis"),
        F.lag("_u", delay).over(wl).alias("utility"), F.lag("max_drawdown", delay).over(wl).alias("max_drawdown"),
    ).dropna(subset=list(CODE_BITS))


def binary_code(df: DataFrame, bits: Sequence[str] = CODE_BITS, below: Sequence[str] = ("max_drawdown",), full_sample: bool = False, keys=KEYS) -> DataFrame:
    """Split each attribute at its median and pack the bits into a one-based code.

    The expanding median is the default and sees no later rows; ``full_sample``
    splits at the whole sample's median.
    """
    from strandline.operators.transform import pack_bits

    from strandline.operators.ranked import expanding_quantiles

    if full_sample:
        base = df.select("*", *[F.percentile(F.col(b), F.lit(0.5)).over(whole(keys)).alias(f"_m_{b}") for b in bits])
    else:
        base = expanding_quantiles(df, {b: f"_m_{b}" for b in bits}, 0.5, keys)
    flags = [(F.col(b) < F.col(f"_m_{b}")) if b in below else (F.col(b) > F.col(f"_m_{b}")) for b in bits]
    return base.withColumn("code", pack_bits(flags)).select(*df.columns, "code")


def code_strategy(df: DataFrame, ret: str = "ret", extra_delay: int = 0, by_sign: bool = True, reverse: bool = False, keys=KEYS) -> DataFrame:
    """Action and confidence of each row's code, and the return times that action (or its sign).

    The attributes behind the code are already lagged; ``extra_delay`` lags the action again.
    """
    from strandline.functions.codes import CODE_DEFAULTS, CODE_TABLE
    from strandline.operators.align import lookup

    base = lookup(df, "code", CODE_TABLE, CODE_DEFAULTS)
    a = F.lag("action", extra_delay).over(ordered(keys)) if extra_delay else F.col("action")
    position = (F.signum(a) if by_sign else a) * (-1.0 if reverse else 1.0)
    return base.withColumn("strategy", F.col(ret) * position)


def state_rows(df: DataFrame, windows: Sequence[int], gammas: Sequence[float], limits: tuple[float, float, float] = (0.0, 0.0, 0.0), ret: str = "ret", keys=KEYS) -> DataFrame:
    """Market state and evidence of every row, for each window and gamma.

    State bits say whether momentum, mean over deviation, and mean less gamma deviations of the
    last n returns exceed their limits; evidence is the share of set bits.  All windows share one
    sort, and rows multiply afterwards.
    """
    x = F.col(ret)
    base = df.filter(x.isNotNull())
    cols = []
    for n in windows:
        w = trailing(n, keys)
        cols += [stat("compound", x, w, n).alias(f"_mo{n}"), stat("mean", x, w, n).alias(f"_mu{n}"), F.stddev_pop(x).over(w).alias(f"_sd{n}")]
    rows = stack_rows(base.select(*df.columns, *cols), df.columns, [{"n": n, "_mo": F.col(f"_mo{n}"), "_mu": F.col(f"_mu{n}"), "_sd": F.col(f"_sd{n}")} for n in windows])
    rows = explode_rows(rows.filter(F.col("_mo").isNotNull()), [{"gamma": float(g)} for g in gammas])
    score = F.coalesce(div(F.col("_mu"), F.col("_sd")), F.lit(0.0))
    bits = [F.col("_mo") > limits[0], score > limits[1], F.col("_mu") - F.col("gamma") * F.col("_sd") > limits[2]]
    rows = rows.select(*df.columns, "n", "gamma", *[b.cast("int").alias(f"_b{i}") for i, b in enumerate(bits)])
    state = F.concat(*[F.col(f"_b{i}").cast("string") for i in range(3)])
    return rows.withColumn("state", state).withColumn("evidence", (F.col("_b0") + F.col("_b1") + F.col("_b2")) / 3.0).drop("_b0", "_b1", "_b2")


def belief_states(df: DataFrame, n: int, gamma: float = 1.0, limits: tuple[float, float, float] = (0.0, 0.0, 0.0), entropy_limit: float = 0.9, trade_limit: float = 0.5, prior: float = 0.5, ret: str = "ret", keys=KEYS) -> DataFrame:
    """Bayesian belief per market state, with a signal gated by its entropy.

    State bits say whether momentum, mean over deviation, and mean less gamma
    deviations of the last n returns exceed their limits.  The evidence of a row is
    its share of set bits, so the belief of a state after m visits has the closed
    form of a running sum of log odds: no recursion over rows.  Certain evidence
    (0 or 1) is absorbing.
    """
    base = state_rows(df, [n], [gamma], limits, ret, keys).drop("n", "gamma")
    e = F.col("evidence")
    odds = F.when((e > 0) & (e < 1), F.log(e / (1.0 - e))).otherwise(0.0)
    ws = expanding((*keys, "state"))
    base = base.withColumn("_o", F.sum(odds).over(ws) + math.log(prior / (1.0 - prior)))
    p = F.when(e == 0, 0.0).when(e == 1, 1.0).otherwise(1.0 / (1.0 + F.exp(-F.col("_o"))))
    base = base.withColumn("belief", p)
    q = 1.0 - F.col("belief")
    h = F.when((F.col("belief") > 0) & (q > 0), -(F.col("belief") * F.log2("belief") + q * F.log2(q))).otherwise(0.0)
    base = base.withColumn("entropy", h)
    signal = F.when(F.col("entropy") < entropy_limit, F.when(F.col("belief") > trade_limit, "BUY").otherwise("SELL")).otherwise("HOLD")
    return base.withColumn("signal", signal).select(*df.columns, "state", "evidence", "belief", "entropy", "signal")


def _propositions(features: dict[str, tuple[Column, float, float]], k: float) -> tuple[Column, dict[str, Column]]:
    """State label over the features in order of their names, and each feature's normal probability."""
    digits, probabilities = [], {}
    for name in sorted(features):
        c, mu, sd = features[name]
        if sd == 0:
            digits.append(F.when(c < mu, "0").otherwise("2"))
            probabilities[name] = F.lit(0.5)
        else:
            digits.append(F.when(c < mu - k * sd, "0").when(c > mu + k * sd, "2").otherwise("1"))
            probabilities[name] = norm_cdf((c - mu) / sd)
    return F.concat_ws("_", *digits), probabilities


def proposition_evidence(features: dict[str, tuple[Column, float, float]], weights: dict[str, float] | None = None, k: float = 1.0) -> tuple[Column, Column]:
    """State label (0/1/2 per feature around mean +- k sd) and weighted normal-probability evidence.

    ``features`` maps a name to (column, mean, sd).
    """
    weights = weights or {f: 1.0 / len(features) for f in features}
    state, probabilities = _propositions(features, k)
    total = sum((weights[name] * p for name, p in probabilities.items()), F.lit(0.0))
    return state, total / sum(weights.values())


def weighted_beliefs(df: DataFrame, features: dict[str, tuple[Column, float, float]], priors: dict[str, float] | None = None, prior: float = 0.5, k: float = 0.5, entropy_limit: float = 0.2, trade_limit: float = 0.7, keys=KEYS) -> DataFrame:
    """Beliefs by market state whose evidence weighs features by their relevance, as an ordered fold.

    Adds state, evidence, belief, entropy, signal and ``weight_<feature>``, the weights after the
    row.  ``priors`` are the beliefs in the features themselves, by default ``prior``; rows without
    a value of every feature give no row and teach nothing.
    """
    from strandline.operators.fold import ordered_fold
    from strandline.operators.recursive import WeightedBeliefs

    names = sorted(features)
    state, probabilities = _propositions(features, k)
    known = F.lit(True)
    for name in names:
        known = known & features[name][0].isNotNull()
    rows = df.filter(known).select(*df.columns, state.alias("state"), *[p.alias(f"_p_{name}") for name, p in probabilities.items()])
    own = [float((priors or {}).get(name, prior)) for name in names]
    outputs = ", ".join(f"{c} double" for c in ["evidence", "belief", "entropy", *[f"weight_{name}" for name in names]])
    made = ordered_fold(rows, lambda key: WeightedBeliefs(own, prior), ["state", *[f"_p_{name}" for name in names]], outputs, keys, keep=["state"])
    signal = F.when(F.col("entropy") < entropy_limit, F.when(F.col("belief") > trade_limit, "BUY").otherwise("SELL")).otherwise("HOLD")
    return made.withColumn("signal", signal)


def anomaly_and_breaker(df: DataFrame, n: int, bins: int = 10, z: float = 3.0, entropy_limit: float = 1.5, drawdown_limit: float = 0.15, kurtosis_limit: float = 3.0, ret: str = "ret", keys=KEYS) -> DataFrame:
    """Flag unusual information, and stop when entropy, drawdown and kurtosis are all high."""
    from strandline.operators.window import equity, histogram_entropy, rolling_shape

    base = equity(rolling_shape(histogram_entropy(df, ret, n, bins, keys), ret, n, keys), ret, keys)
    # equal histograms must give equal information, or a deviation of 1e-17 makes a score of one
    w, i = expanding(keys), F.round("information", 9)
    score = div(i - F.avg(i).over(w), F.stddev_pop(i).over(w))
    stop = (F.col("entropy") > entropy_limit) & (-F.col("drawdown") > drawdown_limit) & (F.col("sample_kurt") > kurtosis_limit)
    return base.select(
        *df.columns, "entropy", "information", score.alias("information_z"), F.coalesce(F.abs(score) > z, F.lit(False)).alias("anomaly"), F.coalesce(stop, F.lit(False)).alias("stop")
    )


def sized_position(forecast: Column, deviation: Column, minimum: float = 0.4, cap: float = 1.0, gain: float = 10.0) -> Column:
    """Sign of the forecast times a capped size that shrinks with its deviation; zero below minimum confidence."""
    confidence = 1.0 / (1.0 + deviation)
    return F.when(confidence < minimum, 0.0).otherwise(F.signum(forecast) * F.least(confidence * F.abs(forecast) * gain, F.lit(cap)))


def block_learning(df: DataFrame, windows: Sequence[int], reset: int = 6, ret: str = "ret", keys=KEYS) -> DataFrame:
    """Average of window signals weighted by sign errors, losses or both, with memories restarted every ``reset`` rows.

    Signals are signs of mean over median, one row old.  A row's weights use the
    errors of its block up to the row before.
    """
    from strandline.operators.window import mean_to_median, reset_blocks

    base = df.filter(F.col(ret).isNotNull())
    for n in windows:
        base = mean_to_median(base, ret, n, keys, delay=1, out=f"_q{n}").withColumn(f"_s{n}", F.signum(f"_q{n}"))
    ready = F.lit(True)
    for n in windows:
        ready = ready & F.col(f"_s{n}").isNotNull()
    base = reset_blocks(base.filter(ready), reset, keys)
    r = F.col(ret)
    base = base.select("*", *[(F.signum(r) - F.col(f"_s{n}")).alias(f"_e{n}") for n in windows])
    inside = expanding((*keys, "block"))
    acc = []
    for n in windows:
        e = F.col(f"_e{n}")
        for tag, hit in (("p", e == 2), ("m", e == -2)):
            acc.append(F.sum(hit.cast("double")).over(inside).alias(f"_n{tag}{n}"))
            acc.append(F.product(1.0 + F.abs(r) * hit.cast("double")).over(inside).alias(f"_l{tag}{n}"))
    base = base.select("*", *acc)
    wl = ordered(keys)
    two = F.lit(2.0)
    schemes = {"both": [], "errors": [], "losses": []}
    for n in windows:
        np_, nm, lp, lm = (F.col(f"_{a}{n}") for a in ("np", "nm", "lp", "lm"))
        schemes["both"].append(F.pow(two, F.pow(two, -np_) / lp + F.pow(two, -nm) / lm))
        schemes["errors"].append(F.pow(two, -np_ - nm))
        schemes["losses"].append(F.pow(two, -lp - lm))
    base = base.select("*", *[w.alias(f"_w_{k}_{n}") for k, ws in schemes.items() for n, w in zip(windows, ws)])
    # the block that has just ended is forgotten: its successor starts from equal weights
    same = F.lag("block").over(wl)
    out = [c for c in df.columns]
    results = []
    for k in schemes:
        total = F.lit(0.0)
        for n in windows:
            fresh = {"both": 4.0, "errors": 1.0, "losses": 0.25}[k]
            prev = F.when(same == F.col("block"), F.lag(f"_w_{k}_{n}").over(wl)).when(same.isNotNull(), fresh)
            total = total + prev * F.col(f"_s{n}")
        results.append((r * F.signum(F.round(total, 12))).alias(f"by_{k}"))
    return base.select(*out, "block", *results)
