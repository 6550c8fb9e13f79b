"""Statistics as column expressions: they stay in generated code and need no Python worker."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The two normal quantiles in use, and the precision levels in order.
Z_ROUNDED = 1.96
Z_EXACT = 1.959963985
PRECISIONS = ("fp16", "int8_llmint8", "nf4")


def wilson(k: Column, n: Column, z: float = Z_ROUNDED, clamp: bool = True) -> tuple[Column, Column]:
    """Wilson score interval of k of n; with ``clamp`` within [0, 1] and exact at the ends. Null where n is 0."""
    some = F.when(n > 0, n.cast("double"))
    p = k / some
    z2 = z * z
    middle = (p + z2 / (2 * some)) / (1 + z2 / some)
    half = z * F.sqrt(p * (1 - p) / some + z2 / (4 * some * some)) / (1 + z2 / some)
    low, high = middle - half, middle + half
    if clamp:
        low = F.when(k == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), low))
        high = F.when(k == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), high))
    return F.when(n > 0, low), F.when(n > 0, high)


def log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1: Stirling's series eight places further on."""
    x = x.cast("double")
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    product = x
    for step in range(1, 8):
        product = product * (x + step)
    return series - F.log(product)


def mcnemar_exact(n10: Column, n01: Column) -> Column:
    """Two-sided exact binomial p of the discordant counts; 1 where there are none.

    The tail is summed from its largest term down. Beyond 40 standard deviations terms
    are below what a double can add, so the sum's length grows with the root of n only.
    """
    n, k = n10 + n01, F.least(n10, n01)
    start = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * math.log(2)
    last = F.least(k, F.ceil(F.sqrt(n.cast("double")) * 40) + 100).cast("int")
    zero = F.struct(start.alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        F.sequence(F.lit(0), last),
        zero,
        lambda acc, i: F.struct((acc["term"] + F.when(k - i > 0, F.log((k - i).cast("double")) - F.log((n - k + i + 1).cast("double"))).otherwise(0.0)).alias("term"), (acc["sum"] + F.exp(acc["term"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))


def holm_columns(df, p: str, family: list[str], ties: list[str], name: str):
    """``df`` with the adjusted p. A window inside a window is not allowed, so the steps are two."""
    order = Window.partitionBy(*family).orderBy(p, *ties)
    ranked = df.withColumn("_step", (F.count(p).over(Window.partitionBy(*family)) - F.row_number().over(order) + 1) * F.col(p))
    return ranked.withColumn(name, F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def exclusive_quantile(values: Column, q: float) -> Column:
    """Of a sorted array, at place q (n + 1), between neighbours; null below four values."""
    n = F.size(values)
    place = (n + 1) * F.lit(q)
    low = F.greatest(F.lit(1), F.least(n - 1, F.floor(place).cast("int")))
    a, b = F.get(values, low - 1), F.get(values, low)
    return F.when(n > 3, a + (place - low) * (b - a))


def linear_quantile(values: str, q: float) -> Column:
    """Type 7: between neighbours at place q (n - 1)."""
    return F.percentile(F.col(values), F.lit(q))


def floor_quantile(values: Column, q: float) -> Column:
    """Of a sorted array, the element numbered min(n - 1, floor(q n)) from 0."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.least(n - 1, F.floor(n * F.lit(q)).cast("int"))))


def argmax(values: Column) -> Column:
    """From 1; the first of equal ones."""
    return F.array_position(values, F.array_max(values)).cast("int")


def finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def recovery(cost_hits: Column, gain: Column, n: Column) -> Column:
    """Gain over cost where the cost, an integer count of hits lost, is positive; else null."""
    return F.when(cost_hits > 0, gain / (cost_hits / n))
