"""Column-level functions: null-safe arithmetic, probabilities, small matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def div(a, b) -> Column:
    """a / b with null instead of an error or an infinity when b is zero."""
    return F.try_divide(a.cast("double") if isinstance(a, Column) else F.lit(float(a)), b)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with a signed infinity, or NaN for 0 / 0, when b is zero; null only if one of them is."""
    a = a.cast("double")
    by_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(a * F.lit(math.nan))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def corr_from(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation over pairs with both values; null when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    agg = [F.covar_pop(xs, ys), F.stddev_pop(xs), F.stddev_pop(ys)]
    if over is not None:
        agg = [a.over(over) for a in agg]
    return div(agg[0], agg[1] * agg[2])


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function.

    Spark has no erf; this is the rational approximation 7.1.26 of Abramowitz
    and Stegun (absolute error below 1.5e-7).
    """
    # fixed values: published coefficients of the approximation
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    u = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + p * u)
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    half = 0.5 * (F.lit(1.0) - poly * F.exp(-u * u))
    return F.when(z >= 0, 0.5 + half).otherwise(0.5 - half)


def iterated_log(n: int) -> int:
    """Times the natural logarithm, rounded down each time, applies until at most 1."""
    count = 0
    while n > 1:
        n, count = math.floor(math.log(n)), count + 1
    return count


def iterated_log_of(n: Column) -> Column:
    """``iterated_log`` of a column, for any number: a ladder on where the count steps up.

    The count is 1 up to e^2, as the logarithm rounds down to 1 there, and 2 up to e^8, as it
    rounds down to 7; the next step lies beyond the range of a double.
    """
    return F.when(n <= 1, 0).when(n < math.exp(2), 1).when(n < math.exp(8), 2).when(n.isNotNull(), 3)


def window_weights(windows, scheme: str) -> dict[int, float]:
    """Weights by window length n, summing to one: equal, 2^-n or 2^-log*(n)."""
    exponent = {"equal": lambda n: 0, "complexity": lambda n: n, "prior": iterated_log}
    if scheme not in exponent:
        raise ValueError(f"unknown weighting scheme {scheme!r}; use one of {sorted(exponent)}")
    raw = {int(n): 2.0 ** -exponent[scheme](int(n)) for n in windows}
    total = sum(raw.values())
    return {n: v / total for n, v in raw.items()}


def literal_array(values) -> Column:
    """array<double> literal, parsed once instead of one call per element."""
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")


def weighted_sum(array_col: str, weights) -> Column:
    """Sum of array elements times literal weights, written out so that it compiles to plain arithmetic."""
    return F.expr(" + ".join(f"{array_col}[{i}] * {float(v)!r}D" for i, v in enumerate(weights)))


def eliminate(matrix: Column, p: int) -> Column:
    """Struct (m, logdet): an augmented p x q matrix reduced so that its left block is I.

    The matrices are normal equations of a handful of regressors; the data-sized
    work (sums of products) has been done by Spark aggregates before.  Positive
    definite input needs no pivoting; a singular matrix gives nulls because
    division is null-safe.
    """

    def step(acc: Column, k: Column) -> Column:
        row_k = F.element_at(acc["m"], k)
        pivot = F.element_at(row_k, k)
        scaled = F.transform(row_k, lambda v: F.try_divide(v, pivot))
        reduced = F.transform(
            acc["m"],
            lambda row, i: F.when(i + 1 == k, scaled).otherwise(F.zip_with(row, scaled, lambda a, b: a - b * F.element_at(row, k))),
        )
        return F.struct(reduced.alias("m"), (acc["logdet"] + F.log(F.when(pivot > 0, pivot))).alias("logdet"))

    start = F.struct(matrix.alias("m"), F.lit(0.0).alias("logdet"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(p)), start, step)
