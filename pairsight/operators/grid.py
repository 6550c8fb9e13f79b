"""The grid arm x language x precision: completeness, accuracy and the three contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.errors import ContractError
from pairsight.functions.stats import PRECISIONS, holm_columns, mcnemar_exact, recovery
from pairsight.operators import paired

BASE, TUNED = "base", "ft"


def build(base: DataFrame, tuned: DataFrame, langs: list[str], revision: str | None = None) -> DataFrame:
    """Both arms, restricted to the languages; the base arm must not be empty, and of one revision where one is named."""
    base = base.where(F.col("lang").isin(langs))
    seen = base.agg(F.count("*").alias("n"), F.count_if(F.lit(revision is not None) & (F.col("model_revision") != F.lit(revision))).alias("other")).first()
    if not seen["n"]:
        raise ContractError("V25 base arm", "empty")
    if seen["other"]:
        raise ContractError("V25 base arm", f"{seen['other']} rows of another revision")
    return base.withColumn("arm", F.lit(BASE)).unionByName(tuned.where(F.col("lang").isin(langs)).withColumn("arm", F.lit(TUNED)))


def completeness(grid: DataFrame, expected: int, arms: list[str], langs: list[str], precisions: tuple[str, ...] = PRECISIONS) -> DataFrame:
    """arm, lang, precision, n_items, state (present, short, missing): every expected cell, present or not."""
    spark = grid.sparkSession
    cells = spark.range(1)
    for name, values in (("arm", arms), ("lang", langs), ("precision", list(precisions))):
        cells = cells.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    cells = cells.drop("id")
    held = grid.groupBy("arm", "lang", "precision").agg(F.count_distinct("item_id").alias("held"))
    n = F.coalesce("held", F.lit(0))
    return cells.join(held, ["arm", "lang", "precision"], "left").select("arm", "lang", "precision", n.alias("n_items"), F.when(n == 0, "missing").when(n < expected, "short").otherwise("present").alias("state"))


def accuracy(grid: DataFrame) -> DataFrame:
    return paired.accuracy(grid, ["arm", "lang", "precision"])


def degradation(grid: DataFrame, precisions: tuple[str, ...] = PRECISIONS) -> DataFrame:
    """One family over the table."""
    return paired.degradation(grid.withColumn("_all", F.lit(1)), ["_all", "arm", "lang"], "item_id", precisions[0], list(precisions[1:]), ["_all"]).drop("_all")


def _contrasts(wide: DataFrame, by: list[str], pairs: list[tuple[str, tuple[str, str], tuple[str, str]]], name: str) -> DataFrame:
    """by..., name, d for each named contrast of outcome columns, from one scan of the wide table."""
    each = F.array(*(F.struct(F.lit(label).alias(name), ((F.col(a) - F.col(b)) - (F.col(c) - F.col(d))).cast("int").alias("d")) for label, (a, b), (c, d) in pairs))
    return wide.select(*by, F.explode(each).alias("x")).select(*by, "x.*")


def points(differences: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, total, delta: the contrasts' point estimates; fatal where cells do not hold the same items."""
    return paired.tally(differences, by).select(*by, "n", "total", (F.col("total") / F.col("n")).alias("delta"))


def _tested(differences: DataFrame, by: list[str], n_boot: int, seed: int, hashed: bool) -> DataFrame:
    out = (paired.bootstrap_hashed if hashed else paired.bootstrap)(differences, by, n_boot, seed).withColumn("_all", F.lit(1))
    return holm_columns(out, "p_bootstrap", ["_all"], by, "p_holm").drop("_all").withColumnRenamed("delta", "delta_interaction")


def language_differences(grid: DataFrame, reference: str, precisions: tuple[str, ...] = PRECISIONS) -> DataFrame:
    """arm, lang, precision, d: what an item loses in a language, less what it loses in the reference; null where one of the two lacks the item."""
    base = precisions[0]
    wide = paired.pivot_outcomes(grid, ["arm", "lang", "item_id"], "precision", list(precisions))
    langs = wide.select("arm", "lang").where(F.col("lang") != reference).distinct()  # a handful of rows
    ref = wide.where(F.col("lang") == reference).select("arm", "item_id", *(F.col(p).alias(f"ref_{p}") for p in precisions))
    due = ref.join(F.broadcast(langs), "arm")  # every item of the reference, for each other language of its arm
    met = wide.where(F.col("lang") != reference).join(due, ["arm", "lang", "item_id"], "full_outer")
    return _contrasts(met, ["arm", "lang"], [(p, (base, p), (f"ref_{base}", f"ref_{p}")) for p in precisions[1:]], "precision")


def rq1(grid: DataFrame, reference: str, n_boot: int = 10_000, seed: int = 0, precisions: tuple[str, ...] = PRECISIONS, hashed: bool = False) -> DataFrame:
    """Does a lower precision cost a language more than the reference language? Of arms that have the reference."""
    return _tested(language_differences(grid, reference, precisions), ["arm", "lang", "precision"], n_boot, seed, hashed).withColumn("reference", F.lit(reference))


def arm_differences(grid: DataFrame, precisions: tuple[str, ...] = PRECISIONS) -> DataFrame:
    """lang, precision, d: what an item loses in the tuned arm, less what it loses in the base arm; null where one of the two lacks the item."""
    base = precisions[0]
    named = grid.withColumn("_cell", F.concat_ws("_", "arm", "precision"))
    wide = paired.pivot_outcomes(named, ["lang", "item_id"], "_cell", [f"{a}_{p}" for a in (BASE, TUNED) for p in precisions])
    return _contrasts(wide, ["lang"], [(p, (f"{TUNED}_{base}", f"{TUNED}_{p}"), (f"{BASE}_{base}", f"{BASE}_{p}")) for p in precisions[1:]], "precision")


def rq2(grid: DataFrame, n_boot: int = 10_000, seed: int = 0, precisions: tuple[str, ...] = PRECISIONS, hashed: bool = False) -> DataFrame:
    """Does tuning change what a lower precision costs?"""
    return _tested(arm_differences(grid, precisions), ["lang", "precision"], n_boot, seed, hashed).withColumn("contrast", F.lit("ft - base"))


def rq3(grid: DataFrame, precisions: tuple[str, ...] = PRECISIONS) -> DataFrame:
    """What tuning gains at each precision, and which part of the base arm's cost of precision that recovers (null unless it costs)."""
    base = precisions[0]
    named = grid.withColumn("_cell", F.concat_ws("_", "arm", "precision"))
    wide = paired.pivot_outcomes(named, ["lang", "item_id"], "_cell", [f"{a}_{p}" for a in (BASE, TUNED) for p in precisions])
    each = F.array(*(F.struct(F.lit(p).alias("precision"), F.col(f"{BASE}_{p}").alias("b"), F.col(f"{TUNED}_{p}").alias("t"), F.col(f"{BASE}_{base}").alias("f")) for p in precisions))
    rows = wide.select("lang", F.explode(each).alias("x")).select("lang", "x.*").where("b is not null or t is not null")
    one, other = paired.discordant(F.col("t"), F.col("b"))
    sums = rows.groupBy("lang", "precision").agg(F.count_if(F.col("b").isNotNull() & F.col("t").isNotNull()).alias("n"), F.count("b").alias("nb"), F.count("t").alias("nt"), F.count("f").alias("nf"), *(F.sum(c).cast("long").alias(c) for c in "btf"), one.alias("n_ft_only"), other.alias("n_base_only"))
    sums = sums.where("nb > 0 and nt > 0 and nf > 0").withColumn("n", paired.aligned(F.col("n"), [F.col("nb"), F.col("nt"), F.col("nf")]))
    gain = (F.col("t") - F.col("b")) / F.col("n")
    table = sums.select(
        "lang",
        "precision",
        (F.col("b") / F.col("n")).alias("acc_base"),
        (F.col("t") / F.col("n")).alias("acc_ft"),
        gain.alias("delta_ft_minus_base"),
        (F.col("f") / F.col("n")).alias("acc_base_fp16"),
        ((F.col("f") - F.col("b")) / F.col("n")).alias("base_precision_cost"),
        recovery(F.col("f") - F.col("b"), gain, F.col("n")).alias("recovers_fp16_gap"),
        "n_ft_only",
        "n_base_only",
        mcnemar_exact(F.col("n_ft_only"), F.col("n_base_only")).alias("mcnemar_p"),
    ).withColumn("_all", F.lit(1))
    return holm_columns(table, "mcnemar_p", ["_all"], ["lang", "precision"], "mcnemar_p_holm").drop("_all")


def efficiency(*tables: DataFrame) -> DataFrame:
    """The tables' rows on the columns that all have, in the first one's order."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    out = tables[0].select(common)
    for t in tables[1:]:
        out = out.unionByName(t.select(common))
    return out


def analyse(grid: DataFrame, reference: str, n_boot: int = 10_000, seed: int = 0) -> dict[str, DataFrame]:
    """Every table that the grid's arms and languages support."""
    present = {(r["arm"], r["lang"]) for r in grid.select("arm", "lang").distinct().collect()}
    arms = {a for a, _ in present}
    out = {"accuracy": accuracy(grid), "degradation": degradation(grid)}
    if any((a, reference) in present for a in arms) and len({lang for _, lang in present}) > 1:
        out["rq1"] = rq1(grid, reference, n_boot, seed)
    if {BASE, TUNED} <= arms:
        out |= {"rq2": rq2(grid, n_boot, seed), "rq3": rq3(grid)}
    return out
