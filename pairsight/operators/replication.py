"""Replication on another model: floor gate, degradation with two families, cross-model contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.functions.stats import Z_EXACT, holm_columns, wilson
from pairsight.operators import paired

FLOOR = 0.30


def floor_gate(cells: DataFrame, by: str = "lang", floor: float = FLOOR) -> DataFrame:
    """lang, n, correct, acc, ci_low, ci_high, passes_floor: the lower bound must be above the floor."""
    sums = cells.groupBy(by).agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("correct"))
    low, high = wilson(F.col("correct"), F.col("n"), Z_EXACT, clamp=False)
    return sums.select(by, "n", "correct", (F.col("correct") / F.col("n")).alias("acc"), low.alias("ci_low"), high.alias("ci_high"), (low > floor).alias("passes_floor"))


def touches_chance(cells: DataFrame, chance: float = 0.25) -> DataFrame:
    """The cells (ci_low, ci_high of their accuracy) with ``touches_chance``: whether guessing is within the interval."""
    return cells.withColumn("touches_chance", (F.col("ci_low") <= chance) & (F.col("ci_high") >= chance))


def degradation(tidy: DataFrame, passing: DataFrame, baseline: str = "fp16", others: tuple[str, ...] = ("int8_llmint8", "nf4")) -> DataFrame:
    """lang, precision, delta, lost, gained, mcnemar_p, mcnemar_p_holm over the languages that pass the floor."""
    kept = tidy.join(passing.where("passes_floor").select("lang"), "lang", "left_semi").withColumn("_all", F.lit(1))
    table = paired.degradation(kept, ["_all", "lang"], "item_id", baseline, list(others), ["_all"])
    return table.select("lang", "precision", F.col("delta_acc").alias("delta"), F.col("n_fp16_only").alias("lost"), F.col("n_quant_only").alias("gained"), "mcnemar_p", "mcnemar_p_holm")


def cross_model(first: DataFrame, second: DataFrame, passing: DataFrame, narrow, n_boot: int = 20_000, seed: int = 0, precisions: tuple[str, ...] = ("fp16", "int8_llmint8", "nf4"), expected: int | None = None, hashed: bool = False) -> DataFrame:
    """Degradation of the second model less that of the first, by item; p is not capped, and adjusted over all tests and over the narrow family.

    ``narrow``: a column expression over lang and precision that tells the pre-registered tests. Fatal where
    the models do not hold the same items (or not ``expected`` ones, J3).
    """
    base = precisions[0]
    kept = passing.where("passes_floor").select("lang")
    a, b = (paired.pivot_outcomes(x.join(kept, "lang", "left_semi"), ["lang", "item_id"], "precision", list(precisions)) for x in (first, second))
    met = a.select("lang", "item_id", *(F.col(p).alias(f"a_{p}") for p in precisions)).join(b, ["lang", "item_id"], "full_outer")
    each = F.array(*(F.struct(F.lit(p).alias("precision"), (F.col(f"a_{base}") - F.col(f"a_{p}")).alias("da"), (F.col(base) - F.col(p)).alias("db")) for p in precisions[1:]))
    rows = met.select("lang", F.explode(each).alias("x")).select("lang", "x.*")
    means = rows.groupBy("lang", "precision").agg((F.sum("da") / F.count("da")).alias("first_degradation"), (F.sum("db") / F.count("db")).alias("rep_degradation"))
    d = rows.select("lang", "precision", (F.col("db") - F.col("da")).cast("int").alias("d"))
    tested = (paired.bootstrap_hashed if hashed else paired.bootstrap)(d, ["lang", "precision"], n_boot, seed, cap=False, expected=expected)
    out = means.join(tested, ["lang", "precision"]).select(
        "lang", "precision", "first_degradation", "rep_degradation", F.col("delta").alias("difference"), "ci_low", "ci_high", "p_bootstrap", (~((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))).alias("ci_excludes_zero"), narrow.alias("in_prereg_family"), F.lit(1).alias("_all")
    )
    out = holm_columns(out, "p_bootstrap", ["_all"], ["lang", "precision"], "p_holm_all_tests")
    out = holm_columns(out, "p_bootstrap", ["in_prereg_family"], ["lang", "precision"], "_narrow")
    return out.withColumn("p_holm_prereg", F.when(F.col("in_prereg_family"), F.col("_narrow"))).drop("_narrow", "_all")
