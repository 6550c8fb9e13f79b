"""A pinned multiple-choice benchmark: read, keyed, and held against its frozen manifest before anything uses it.

``report`` counts every fault by language in one aggregation by key and one join; ``load`` raises
on the first and otherwise gives the keyed items. Rows stand for one revision's export:
the caller names the path of the pinned one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsight.errors import ContractError
from pairsight.functions.text import composite_key

#: The columns of an exported item.
PASSAGE, QUESTION, GOLD = "flores_passage", "question", "correct_answer_num"
OPTIONS = ["mc_answer1", "mc_answer2", "mc_answer3", "mc_answer4"]
#: The rules of a load, in the order in which they are told.
RULES = ["wrong_count", "repeated", "unknown", "gold_differs", "missing"]


def keyed(rows: DataFrame, key: list[str], sep: str = "#") -> DataFrame:
    """rows with item_id, joined from the key's columns; null where one of them is."""
    return rows.withColumn("item_id", composite_key(*(F.col(c) for c in key), sep=sep))


def report(rows: DataFrame, manifest: DataFrame, by: str, gold: str, expected: int) -> DataFrame:
    """by, n_items, wrong_count, repeated, unknown, gold_differs, missing: faults of each group of keyed rows against item_id, gold of the manifest."""
    known = manifest.select("item_id", F.col("gold").alias("_gold"))
    total = known.select("item_id").distinct().count()
    held = rows.groupBy(by, "item_id").agg(F.count("*").alias("held"), F.min(gold).alias("lo"), F.max(gold).alias("hi"))
    met = held.join(known.withColumn("_due", F.lit(1)), "item_id", "left")
    there = F.col("_due").isNotNull()
    return met.groupBy(by).agg(
        F.sum("held").cast("long").alias("n_items"),
        F.count_if(F.col("held") > 1).alias("repeated"),
        F.count_if(~there).alias("unknown"),
        F.count_if(there & ((F.col("lo") != F.col("_gold")) | (F.col("hi") != F.col("_gold")))).alias("gold_differs"),
        (F.lit(total) - F.count("_due")).alias("missing"),
    ).select(by, "n_items", (F.col("n_items") != expected).cast("long").alias("wrong_count"), "repeated", "unknown", "gold_differs", "missing")


def load(rows: DataFrame, manifest: DataFrame, lang: str, key: list[str], expected: int, sep: str = "#") -> DataFrame:
    """item_id, gold, passage, question, options of one language, by item_id; fatal on a wrong count, repeated, unknown or missing keys, other golds."""
    mine = keyed(rows, key, sep).withColumn("lang", F.lit(lang))
    found = report(mine, manifest, "lang", GOLD, expected).first()
    if found is None:
        raise ContractError("V13 benchmark", f"{lang}: no items")
    for rule in RULES:
        if found[rule]:
            raise ContractError("V13 benchmark", f"{lang}: {rule.replace('_', ' ')}: {found[rule] if rule != 'wrong_count' else found['n_items']}")
    return mine.select("item_id", F.col(GOLD).cast("int").alias("gold"), F.col(PASSAGE).alias("passage"), F.col(QUESTION).alias("question"), F.array(*OPTIONS).alias("options")).orderBy("item_id")


def moved_rows(rows: DataFrame, by: str, reference: str, key: str, place: str) -> DataFrame:
    """by, n, moved: how many items of each group stand at another place than in the reference group (V16, to be told, not fatal)."""
    ref = rows.where(F.col(by) == reference).select(F.col(key), F.col(place).alias("_place"))
    met = rows.where(F.col(by) != reference).join(ref, key)
    return met.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(place) != F.col("_place")).alias("moved"))


def with_place(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with their place (from 0) within a group in source order."""
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))
