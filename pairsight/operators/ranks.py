"""Ranks and order statistics of large groups: no group is sorted by one task, none is held in one row.

A group's different values are counted and dealt by range; a value's place is what its
range has before it and what all ranges before have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that a column of numbers is dealt into at most.
RANGES = 512


def placed(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """by..., x, n, before: each different value of a column of numbers, how often it occurs, and how many values are less.

    Ranges have fixed edges (approximate quantiles, RANGES numbers), so a lost task finds the same ones again.
    """
    parts = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = sorted(set(df.approxQuantile(x, [k / parts for k in range(1, parts)], 0.5 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(x))) if edges else F.lit(0)
    counts = df.groupBy(*by, x).agg(F.count("*").alias("n")).withColumn("_part", part)
    within = Window.partitionBy("_part", *by).orderBy(x)
    ranged = counts.withColumn("_run", F.sum("n").over(within) - F.col("n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.groupBy("_part", *by).agg(F.sum("n").alias("_all")).withColumn("_start", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    return ranged.join(starts.drop("_all"), ["_part", *by]).select(*by, x, "n", (F.col("_start") + F.col("_run")).alias("before"))


def average_ranks(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """by..., x, rank (from 1; ties share the average) of each different value."""
    return placed(df, x, by).select(*by, x, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def order_statistics(df: DataFrame, x: str, by: list[str], picks: dict[str, Column]) -> DataFrame:
    """by..., n, and for each pick the value at its place (from 0, an expression over the group's ``total``; null outside). ``by`` names one column at least."""
    values = placed(df, x, by)
    total = df.groupBy(*by).agg(F.count("*").alias("total"))
    met = values.join(total, by)
    inside = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    held = met.select("*", *(at.alias(f"_at_{k}") for k, at in enumerate(picks_of(picks))))
    return held.groupBy(*by).agg(F.max("total").alias("n"), *(F.max(F.when(inside(F.col(f"_at_{k}")), F.col(x))).alias(name) for k, name in enumerate(picks)))


def picks_of(picks: dict[str, Column]) -> list[Column]:
    return [at.cast("long") for at in picks.values()]


def floor_quantiles(df: DataFrame, x: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by..., n, the element numbered min(n - 1, floor(q n)) from 0 for each named q."""
    n = F.col("total")
    return order_statistics(df, x, by, {name: F.least(n - 1, F.floor(n * F.lit(q))) for name, q in shares.items()})


def exclusive_quantiles(df: DataFrame, x: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by..., the value at place q (n + 1) from 1, between its neighbours, for each named q; null for three values and fewer."""
    n = F.col("total")
    picks = {}
    for k, q in enumerate(shares.values()):
        j = F.greatest(F.lit(1), F.least(n - 1, F.floor((n + 1) * F.lit(q))))
        picks |= {f"_lo{k}": j - 1, f"_hi{k}": j}
    found = order_statistics(df, x, by, picks)
    out = []
    for k, (name, q) in enumerate(shares.items()):
        at = (F.col("n") + 1) * F.lit(q)
        j = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(at)))
        out.append(F.when(F.col("n") > 3, F.col(f"_lo{k}") + (at - j) * (F.col(f"_hi{k}") - F.col(f"_lo{k}"))).alias(name))
    return found.select(*by, *out)
