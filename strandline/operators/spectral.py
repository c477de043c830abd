"""Periodograms, averaged segments, coherence and frequency-domain filters.

The transform of a series is factored: two aggregates, each over a part of the row
number.  Short segments explode their frequencies next to a partial aggregate, windows
sum them inside one array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandline.frames import KEYS, ordered, trailing, whole
from strandline.functions.scalar import div, literal_array, weighted_sum

TAU = 2.0 * math.pi


def _transform(rows: DataFrame, keys: Sequence[str], sign: int, last: Column) -> DataFrame:
    """Complex sums of (_re, _im) times e^{sign 2 pi i k _t / (_a _b)} for k = 0 .. last, in two aggregates.

    With _t = _b u + v and k = p + _a q, the sum over u knows only p and the sum over v needs only
    its _a results: each row meets _a frequencies, each result of the first aggregate _b more.
    """
    sizes = ["_a", "_b"]
    n = F.col("_a") * F.col("_b")

    def turned(step: Column, period: Column) -> tuple[Column, Column]:
        # steps reduce modulo the period as integers first: angles stay small and exact
        angle = sign * TAU * (step % period) / period
        c, s = F.cos(angle), F.sin(angle)
        return F.sum(F.col("_re") * c - F.col("_im") * s).alias("_re"), F.sum(F.col("_re") * s + F.col("_im") * c).alias("_im")

    u, v = F.floor(F.col("_t") / F.col("_b")), F.col("_t") % F.col("_b")
    first = rows.select(*keys, *sizes, u.alias("_u"), v.alias("_v"), "_re", "_im", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_a") - 1)).alias("_p"))
    inner = first.groupBy(*keys, *sizes, "_v", "_p").agg(*turned(F.col("_p") * F.col("_u"), F.col("_a")))
    tops = F.floor((last - F.col("_p")) / F.col("_a"))
    second = inner.filter(F.col("_p") <= last).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), tops)))
    second = second.withColumn("_k", F.col("_p") + F.col("_a") * F.col("_q"))
    return second.groupBy(*keys, *sizes, "_k").agg(*turned(F.col("_v") * F.col("_k"), n))


def _chirped(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The transform at a length without a good factor: a convolution with a chirp at a square length.

    k t = (k^2 + t^2 - (k - t)^2) / 2 turns the sum into a convolution, and a length of s^2 >= 2 n - 1
    splits into s times s.  The turn of each result is left out: it does not change its power.
    """
    side = F.ceil(F.sqrt(2 * F.col("_n") - 1))

    def turn(t: Column, sign: int) -> tuple[Column, Column]:
        angle = sign * (TAU / 2.0) * ((t * t) % (2 * F.col("_n"))) / F.col("_n")
        return F.cos(angle), F.sin(angle)

    padded = base.withColumn("_a", side).withColumn("_b", side)
    c, s = turn(F.col("_t"), -1)
    end = F.col("_a") * F.col("_b") - 1
    x = _transform(padded.select(*keys, "_n", "_a", "_b", "_t", (F.col("_x") * c).alias("_re"), (F.col("_x") * s).alias("_im")), [*keys, "_n"], -1, end)
    lengths = padded.select("_n", "_a", "_b").distinct().withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), end)))
    back = F.least(F.col("_t"), F.col("_a") * F.col("_b") - F.col("_t"))
    c, s = turn(back, 1)
    inside = back < F.col("_n")
    chirp = lengths.select("_n", "_a", "_b", "_t", F.when(inside, c).otherwise(0.0).alias("_re"), F.when(inside, s).otherwise(0.0).alias("_im"))
    h = _transform(chirp, ["_n"], -1, end).select("_n", "_k", F.col("_re").alias("_hr"), F.col("_im").alias("_hi"))
    both = x.join(h, ["_n", "_k"])
    m = F.col("_a") * F.col("_b")
    product = both.select(
        *keys, "_n", "_a", "_b", F.col("_k").alias("_t"),
        ((F.col("_re") * F.col("_hr") - F.col("_im") * F.col("_hi")) / m).alias("_re"), ((F.col("_re") * F.col("_hi") + F.col("_im") * F.col("_hr")) / m).alias("_im"),
    )
    return _transform(product, [*keys, "_n"], 1, F.floor(F.col("_n") / 2))


def periodogram(df: DataFrame, col: str, keys=KEYS, chirp_from: float = 16.0) -> DataFrame:
    """|sum x e^{-2 pi i k t / n}|^2 / n of the demeaned series for k = 0 .. n/2.

    A length n = a b with a the largest factor up to its root goes through two aggregates, in which a
    row meets about a + b / 2 frequencies.  Where that exceeds ``chirp_from`` roots of n (n prime, or
    nearly so), the transform becomes a convolution at a square length of about 2 n.
    """
    x = F.col(col)
    every = whole(keys)
    base = df.filter(x.isNotNull()).select(
        *keys, (F.row_number().over(ordered(keys)) - 1).cast("long").alias("_t"), F.count("*").over(every).alias("_n"), (x - F.avg(x).over(every)).alias("_x")
    )
    n, root = F.col("_n"), F.sqrt("_n")
    factor = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(root)), lambda d: n % d == 0))
    planned = base.withColumn("_a", factor).withColumn("_b", F.floor(n / F.col("_a")))
    planned = planned.withColumn("_chirp", F.col("_a") + F.col("_b") / 2 > chirp_from * root)
    direct = planned.filter(~F.col("_chirp")).select(*keys, "_n", "_a", "_b", "_t", F.col("_x").alias("_re"), F.lit(0.0).alias("_im"))
    half = F.floor(n / 2)
    sums = [_transform(direct, [*keys, "_n"], -1, half), _chirped(planned.filter("_chirp").select(*keys, "_n", "_t", "_x"), keys)]
    s = sums[0].unionByName(sums[1])
    return s.select(*keys, F.col("_k").alias("k"), (F.col("_k") / n).alias("frequency"), ((F.pow("_re", 2) + F.pow("_im", 2)) / n).alias("power"))


def _segment_spectra(df: DataFrame, cols: Sequence[str], length: int, keys: Sequence[str]) -> DataFrame:
    """Real and imaginary sums per (keys, segment, k) of half-overlapping, demeaned, Hann-weighted segments."""
    step = length // 2
    rn = F.row_number().over(ordered(keys)) - 1
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    base = df.filter(ok).withColumn("_t", rn)
    own = F.floor(F.col("_t") / step)
    # a row lies in every segment that starts at most length - 1 rows before it
    first = F.greatest(F.lit(0), F.ceil((F.col("_t") - (length - 1)) / step))
    base = base.withColumn("seg", F.explode(F.sequence(first, own)))
    g = Window.partitionBy(*keys, "seg")
    base = base.withColumn("_m", F.count("*").over(g)).filter(F.col("_m") == length)
    pos = F.col("_t") - F.col("seg") * step
    hann = 0.5 - 0.5 * F.cos(TAU * pos / length)
    for c in cols:
        base = base.withColumn(f"_w_{c}", hann * (F.col(c) - F.avg(c).over(g)))
    rows = base.withColumn("_p", pos).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length // 2))))
    angle = TAU * ((F.col("k") * F.col("_p")) % length) / length
    agg = []
    for c in cols:
        agg += [F.sum(F.col(f"_w_{c}") * F.cos(angle)).alias(f"re_{c}"), F.sum(-F.col(f"_w_{c}") * F.sin(angle)).alias(f"im_{c}")]
    return rows.groupBy(*keys, "seg", "k").agg(*agg)


def welch(df: DataFrame, col: str, length: int = 36, keys=KEYS) -> DataFrame:
    """Power spectrum averaged over segments, one-sided, normalised by the squared window sum."""
    s = _segment_spectra(df, [col], length, keys)
    total = sum(0.5 - 0.5 * math.cos(TAU * i / length) for i in range(length))
    side = F.when((F.col("k") == 0) | (F.col("k") * 2 == length), 1.0).otherwise(2.0)
    p = side * (F.pow(f"re_{col}", 2) + F.pow(f"im_{col}", 2)) / total**2
    return s.groupBy(*keys, "k").agg(F.avg(p).alias("power"), F.count("*").alias("segments")).withColumn("frequency", F.col("k") / length)


def coherence(df: DataFrame, length: int = 36, y: str = "y", x: str = "x", keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Squared coherence |Pxy|^2 / (Pxx Pyy) per frequency from averaged segments."""
    s = _segment_spectra(df, [y, x], length, keys)
    ry, iy, rx, ix = (F.col(f"{p}_{c}") for c in (y, x) for p in ("re", "im"))
    a = s.groupBy(*keys, "k").agg(
        F.avg(ry * rx + iy * ix).alias("_c"), F.avg(iy * rx - ry * ix).alias("_q"), F.avg(ry * ry + iy * iy).alias("_y"), F.avg(rx * rx + ix * ix).alias("_x")
    )
    return a.select(*keys, "k", (F.col("k") / length).alias("frequency"), div(F.col("_c") ** 2 + F.col("_q") ** 2, F.col("_y") * F.col("_x")).alias("coherence"))


def _dft(name: str, n: int, k: int) -> tuple[Column, Column]:
    """Real and imaginary part of one frequency of the window array in column ``name``."""
    angles = [TAU * ((k * t) % n) / n for t in range(n)]
    return weighted_sum(name, (math.cos(a) for a in angles)), weighted_sum(name, (-math.sin(a) for a in angles))


def fractional_order(df: DataFrame, price: str, n: int, grid: Sequence[float], keys=KEYS, out: str = "order", complete_only: bool = False) -> DataFrame:
    """Order d in the grid with the smallest Whittle objective over each window of n prices.

    The objective only shifts when the path is scaled, so prices stand for wealth.
    """
    x, w = F.col(price), trailing(n, keys)
    m = n // 2
    # fixed values: 4 sin^2(pi f), scaling 2/n of the amplitude
    g = [4.0 * math.sin(math.pi * k / n) ** 2 for k in range(m)]
    base = df.withColumn("_a", F.when(F.count(x).over(w) == n, F.collect_list(x).over(w)))
    if complete_only:  # here, where the test is cheap: a later filter would repeat the search in its predicate
        base = base.filter(F.col("_a").isNotNull())
    parts = [F.struct(re.alias("re"), im.alias("im")) for re, im in (_dft("_a", n, k) for k in range(m))]
    base = base.withColumn("_f", F.array(*parts))
    base = base.withColumn("_p", F.transform("_f", lambda z: (2.0 / n) * F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])))
    slope = sum(math.log(v) for v in g[1:])

    def loss(d: float) -> Column:
        s = weighted_sum("_p", ((v**d) / m for v in g))
        return m * F.log(s) + d * slope + m

    losses = base.withColumn("_l", F.array(*[loss(float(d)) for d in grid]))
    at = F.array_position(F.col("_l"), F.array_min("_l")).cast("int")
    picked = F.get(literal_array(grid), at - 1)
    return losses.withColumn(out, F.when(F.col("_a").isNotNull(), picked)).drop("_a", "_f", "_p", "_l")


def wiener_last(df: DataFrame, col: str, n: int, keys=KEYS, out: str = "filtered", complete_only: bool = False) -> DataFrame:
    """Last value of the trailing window after the filter S / (S + noise).

    S is the window's spectrum over n, noise the residual variance about its own
    line.  Only past rows enter, so the output may drive a signal.
    """
    from strandline.operators.window import trend

    x, w = F.col(col), trailing(n, keys)
    base = trend(df, col, n, keys).withColumn("_a", F.when(F.count(x).over(w) == n, F.collect_list(x).over(w)))
    if complete_only:
        base = base.filter(F.col("_a").isNotNull())
    half = n // 2
    base = base.withColumn("_f", F.array(*[F.struct(re.alias("re"), im.alias("im")) for re, im in (_dft("_a", n, k) for k in range(half + 1))]))
    total = F.lit(0.0)
    for k in range(half + 1):
        re, im = F.col("_f")[k]["re"], F.col("_f")[k]["im"]
        s = F.greatest((re * re + im * im) / n, F.lit(1e-10))
        angle = TAU * ((k * (n - 1)) % n) / n
        part = re * math.cos(angle) - im * math.sin(angle)
        twice = 1.0 if k == 0 or 2 * k == n else 2.0
        total = total + twice * s / (s + F.col("residual_variance")) * part / n
    noise = F.col("residual_variance")
    return base.withColumn(out, F.when(F.col("_a").isNotNull(), F.when(noise > 0, total).otherwise(x))).drop("_a", "_f", "slope")
