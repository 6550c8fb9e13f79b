"""Paired comparison of cells: alignment by key, contingency, difference in differences, bootstrap.

A cell is one configuration's outcomes over a set of items. Items are matched by key,
never by position. Outcomes of several configurations are brought side by side in one
aggregation by item (``pivot_outcomes``), so a contrast costs one shuffle by item and no
self-join, however many contrasts are read from it.

Nothing is dropped in silence: a cell that lacks items which its partner has ends the job
(``J1 alignment``) from within the aggregation that reads it, at no further cost; cells
that have no partner at all make no row. ``incomplete_cells`` tells which they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsight.functions.stats import holm_columns, mcnemar_exact, wilson
from pairsight.operators.ranks import average_ranks

#: Hashed draws: those of one piece of work at least, the pieces into which more are dealt, and the groups that share them.
UNIT, UNITS, SHARED = 1 << 17, 4096, 64


def accuracy(tidy: DataFrame, by: list[str], z: float = 1.96, clamp: bool = True) -> DataFrame:
    """by..., n, correct, accuracy, ci95_low, ci95_high."""
    cells = tidy.groupBy(*by).agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("correct"))
    low, high = wilson(F.col("correct"), F.col("n"), z, clamp)
    return cells.select(*by, "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"), low.alias("ci95_low"), high.alias("ci95_high"))


def pivot_outcomes(tidy: DataFrame, key: list[str], over: str, values: list[str], outcome: str = "correct") -> DataFrame:
    """key..., one column of outcomes for each value of ``over``; null where a cell lacks the item."""
    return tidy.groupBy(*key).agg(*(F.max(F.when(F.col(over) == v, F.col(outcome))).alias(v) for v in values))


def aligned(n: Column, held: list[Column], expected: int | None = None) -> Column:
    """``n``, the items that all cells of a contrast have; fatal where one of them (``held``: its items) has more, or n is not ``expected``."""
    most = F.greatest(*held) if len(held) > 1 else held[0]
    off = most != n
    if expected is not None:
        off = off | (n != expected)
    message = F.concat(F.lit("J1 alignment: "), n.cast("string"), F.lit(" items in common of "), most.cast("string"), F.lit("" if expected is None else f", {expected} expected"))
    return F.when(off, F.raise_error(message)).otherwise(n)


def incomplete_cells(tidy: DataFrame, within: list[str], cell: list[str], item: str) -> DataFrame:
    """within..., cell..., n_items, n_missing: cells that lack items which another cell within the same group has."""
    keyed = tidy.select(*within, *cell, item).distinct()
    total = keyed.select(*within, item).distinct().groupBy(*within).agg(F.count("*").alias("total"))
    held = keyed.groupBy(*within, *cell).agg(F.count("*").alias("n_items"))
    met = held.join(total, within) if within else held.join(F.broadcast(total))
    return met.select(*within, *cell, "n_items", (F.col("total") - F.col("n_items")).alias("n_missing")).where("n_missing > 0")


def discordant(a: Column, b: Column) -> tuple[Column, Column]:
    """(only a, only b)."""
    return F.count_if((a == 1) & (b == 0)), F.count_if((a == 0) & (b == 1))


def degradation(tidy: DataFrame, by: list[str], item: str, baseline: str, others: list[str], family: list[str], expected: int | None = None) -> DataFrame:
    """by..., precision, n, acc_fp16, acc_quant, delta_acc, n_fp16_only, n_quant_only, mcnemar_p, mcnemar_p_holm.

    Fatal where a cell lacks items of its baseline or the other way round (or has not ``expected`` items); a precision that a group lacks makes no row.
    """
    wide = pivot_outcomes(tidy, [*by, item], "precision", [baseline, *others])
    sums = []
    for k, other in enumerate(others):
        a, b = F.col(baseline), F.col(other)
        ten, one = discordant(a, b)
        sums += [F.count(b).alias(f"h{k}"), F.count_if(a.isNotNull() & b.isNotNull()).alias(f"n{k}"), F.sum(F.when(b.isNotNull(), a)).alias(f"a{k}"), F.sum(F.when(a.isNotNull(), b)).alias(f"b{k}"), ten.alias(f"t{k}"), one.alias(f"o{k}")]
    cells = wide.groupBy(*by).agg(F.count(F.col(baseline)).alias("held"), *sums)
    each = F.explode(F.array(*(F.struct(F.lit(o).alias("precision"), *(F.col(f"{c}{k}").cast("long").alias(c) for c in "hnabto")) for k, o in enumerate(others)))).alias("x")
    rows = cells.select(*by, "held", each).select(*by, "held", "x.*").where("h > 0 and held > 0")
    rows = rows.withColumn("n", aligned(F.col("n"), [F.col("held"), F.col("h")], expected))
    table = rows.select(
        *by,
        "precision",
        "n",
        (F.col("a") / F.col("n")).alias("acc_fp16"),
        (F.col("b") / F.col("n")).alias("acc_quant"),
        ((F.col("a") - F.col("b")) / F.col("n")).alias("delta_acc"),
        F.col("t").alias("n_fp16_only"),
        F.col("o").alias("n_quant_only"),
        mcnemar_exact(F.col("t"), F.col("o")).alias("mcnemar_p"),
    )
    return holm_columns(table, "mcnemar_p", family, [*by, "precision"], "mcnemar_p_holm")


def tally(differences: DataFrame, by: list[str], expected: int | None = None) -> DataFrame:
    """by..., n, total, and how many items have each difference: all that a bootstrap of the mean needs.

    A null difference is an item that one of the cells lacks: fatal, but where no item has a difference, since then a whole cell is not there.
    """
    counts = [F.count_if(F.col("d") == v).alias(f"c{v + 4}") for v in range(-4, 5)]
    summed = differences.groupBy(*by).agg(F.count("d").alias("n"), F.count("*").alias("_held"), F.sum("d").alias("total"), *counts)
    return summed.where("n > 0").withColumn("n", aligned(F.col("n"), [F.col("_held")], expected)).drop("_held")


def bootstrap(differences: DataFrame, by: list[str], n_boot: int = 10_000, seed: int = 0, percentiles: tuple[float, float] = (2.5, 97.5), cap: bool = True, expected: int | None = None) -> DataFrame:
    """by..., n, delta, ci_low, ci_high, p_bootstrap, n_boot.

    Differences take few integer values, and the mean of n draws depends on how often
    each value is drawn alone; those counts are multinomial. So replicates are drawn from
    the tally, in time that does not grow with the number of items. One seed for each
    contrast, from ``seed`` and its key, so results do not move with partitions.
    """
    counted = tally(differences, by, expected)
    names = [f"c{v + 4}" for v in range(-4, 5)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.select(*by).schema), "n long, delta double, ci_low double, ci_high double, p_bootstrap double, n_boot long"])

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pairsight.functions.seeds import seed_of

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                c = np.array([row[x] for x in names], float)
                n = int(row["n"])
                rng = np.random.default_rng(seed_of(seed, *(row[k] for k in by)))
                sums = rng.multinomial(n, c / n, size=n_boot) @ np.arange(-4, 5)
                low, high = np.percentile(sums / n, percentiles)
                p = 2 * min((sums <= 0).mean(), (sums >= 0).mean())
                out.append({**{k: row[k] for k in by}, "n": n, "delta": row["total"] / n, "ci_low": low, "ci_high": high, "p_bootstrap": min(1.0, p) if cap else p, "n_boot": n_boot})
            yield pd.DataFrame(out, columns=[*by, "n", "delta", "ci_low", "ci_high", "p_bootstrap", "n_boot"])

    return counted.mapInPandas(draw, schema)


def bootstrap_hashed(differences: DataFrame, by: list[str], n_boot: int, seed: int, percentiles: tuple[float, float] = (0.025, 0.975), cap: bool = True, expected: int | None = None) -> DataFrame:
    """The same by draws from MD5 of seed, replicate and place: an independent engine can repeat it.

    A draw is a place among the items sorted by their difference, so the tally tells its value and no item is held.
    The digest does not depend on the group: groups of equal n are drawn together (SHARED at most), one digest for
    each place and replicate. The work is dealt by ranges of replicates and, beyond UNIT places, of places.
    """
    counted = tally(differences, by, expected)
    edges = F.array(*(sum((F.col(f"c{k}") for k in range(1, v + 1)), F.col("c0")) for v in range(8)))
    place = F.row_number().over(Window.partitionBy("n").orderBy(*by)) - 1
    groups = counted.select("n", F.struct(*by, "total", edges.alias("_edges")).alias("_g"), F.floor(place / SHARED).alias("_share")).groupBy("n", "_share").agg(F.collect_list("_g").alias("_groups"))
    unit = F.greatest(F.lit(UNIT), F.ceil(F.col("n") * F.lit(n_boot) / UNITS)).cast("long")
    steps = groups.select("n", "_groups", F.greatest(F.lit(1), F.least(F.lit(n_boot), F.floor(unit / F.col("n")))).cast("long").alias("_reps"), F.least("n", unit).alias("_places"))
    ranges = steps.withColumn("_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"), F.col("_reps")))).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("_places"))))
    # a number of partitions that is named is not brought down for the rows being few: they are short, and long work
    spark = differences.sparkSession
    dealt = ranges.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    @F.pandas_udf("array<array<long>>")
    def drawn(n: pd.Series, groups: pd.Series, rep: pd.Series, reps: pd.Series, start: pd.Series, places: pd.Series) -> pd.Series:
        from pairsight.functions.draws import sums

        values = np.arange(-4, 5)
        return pd.Series([sums(seed, m, (r, min(r + dr, n_boot)), (j, min(j + dj, m)), np.stack(list(g)), values).tolist() for m, g, r, dr, j, dj in zip(n.tolist(), groups, rep.tolist(), reps.tolist(), start.tolist(), places.tolist())])

    parts = dealt.select("n", "_groups", "_rep", drawn("n", F.col("_groups._edges"), "_rep", "_reps", "_from", "_places").alias("_s"))
    each = parts.select("n", "_rep", F.explode(F.arrays_zip("_groups", "_s")).alias("_x")).select("n", *(F.col(f"_x._groups.{c}").alias(c) for c in [*by, "total"]), "_rep", F.posexplode("_x._s").alias("_k", "_s"))
    sums = each.groupBy(*by, "n", "total", (F.col("_rep") + F.col("_k")).alias("_rep")).agg(F.sum("_s").alias("_s"))
    share = lambda c: F.count_if(c) / F.lit(float(n_boot))
    both = 2 * F.least(share(F.col("_s") <= 0), share(F.col("_s") >= 0))
    return sums.groupBy(*by, "n", "total").agg(
        F.percentile(F.col("_s") / F.col("n"), F.lit(percentiles[0])).alias("ci_low"), F.percentile(F.col("_s") / F.col("n"), F.lit(percentiles[1])).alias("ci_high"), (F.least(F.lit(1.0), both) if cap else both).alias("p_bootstrap")
    ).select(*by, "n", (F.col("total") / F.col("n")).alias("delta"), "ci_low", "ci_high", "p_bootstrap", F.lit(n_boot).cast("long").alias("n_boot"))


def bootstrap_numpy(differences: np.ndarray, n_boot: int, seed: int, percentiles: tuple[float, float] = (2.5, 97.5), cap: bool = True) -> dict[str, float]:
    """One contrast with NumPy's own index stream, for parity with published intervals; in blocks of replicates, which draw the same stream."""
    d, n = np.asarray(differences, np.int64), len(differences)
    rng, step = np.random.default_rng(seed), max(1, (1 << 22) // max(n, 1))
    sums = np.concatenate([d[rng.integers(0, n, size=(min(step, n_boot - k), n))].sum(axis=1) for k in range(0, n_boot, step)])
    low, high = np.percentile(sums / n, percentiles)
    p = 2 * min((sums <= 0).mean(), (sums >= 0).mean())
    return {"delta": d.mean(), "ci_low": low, "ci_high": high, "p_bootstrap": min(1.0, p) if cap else p}


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by..., n, rho: correlation of average ranks."""
    rows = df.select(*by, x, y)
    for c, name in ((x, "_rx"), (y, "_ry")):
        rows = rows.join(average_ranks(df, c, by).withColumnRenamed("rank", name), [*by, c])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))
