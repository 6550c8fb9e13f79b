"""The data contract of a tidy table: nothing is repaired, padded or dropped.

Row rules are counted in one pass; rules about cells in one aggregation by cell; rules
against the manifest in one join. ``report`` gives all counts as one table, ``check``
raises on the first broken rule in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.errors import ContractError
from pairsight.functions.stats import PRECISIONS

#: The tidy columns, in order.
TIDY = ["model", "model_revision", "precision", "lang", "item_id", "pred", "gold", "correct"]
CELL = ["model", "precision", "lang"]


def row_rules(tidy: DataFrame, precisions: tuple[str, ...] = PRECISIONS) -> dict:
    ok = lambda c: F.coalesce(c, F.lit(False))
    null = F.lit(False)
    for c in TIDY:
        null = null | F.col(c).isNull()
    return {
        "V2 no nulls": null,
        "V3 precision known": ~ok(F.col("precision").isin(*precisions)),
        "V4 answers in 1..4": ~ok(F.col("pred").between(1, 4) & F.col("gold").between(1, 4)),
        "V5 correct is 0 or 1": ~ok(F.col("correct").isin(0, 1)),
        "V6 correct says pred = gold": ~ok(F.col("correct") == (F.col("pred") == F.col("gold")).cast("int")),
    }


def report(tidy: DataFrame, manifest: DataFrame, precisions: tuple[str, ...] = PRECISIONS) -> DataFrame:
    """rule, broken (rows or cells), in order. ``manifest``: item_id, gold."""
    rules = row_rules(tidy, precisions)
    rows = tidy.agg(*(F.count_if(c).alias(name) for name, c in rules.items()))
    known = manifest.select("item_id", F.col("gold").alias("_gold"))
    matched = tidy.join(known, "item_id", "left").agg(
        F.count_if(F.col("_gold").isNull()).alias("V7 item known"), F.count_if(F.col("_gold").isNotNull() & (F.col("gold") != F.col("_gold"))).alias("V8 gold as in manifest")
    )
    cells = (
        tidy.join(known.select("item_id", F.lit(1).alias("_in")), "item_id", "left")
        .groupBy(*CELL, "item_id")
        .agg(F.count("*").alias("held"), F.max("_in").alias("_in"), F.min("model_revision").alias("lo"), F.max("model_revision").alias("hi"))
        .groupBy(*CELL)
        .agg(F.count_if(F.col("held") > 1).alias("twice"), F.count("*").alias("items"), F.count("_in").alias("known"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.xxhash64("item_id").cast("decimal(38,0)")).alias("mark"))
    )
    total = manifest.agg(F.count_distinct("item_id").alias("total"))
    per_cell = cells.join(F.broadcast(total)).agg(  # one row of one number
        F.sum("twice").cast("long").alias("V9 no item twice in a cell"),
        F.count_if((F.col("items") != F.col("total")) | (F.col("known") != F.col("total"))).alias("V10 cell complete"),
        F.count_if(F.col("lo") != F.col("hi")).alias("V11 one revision in a cell"),
    )
    across = cells.groupBy("model", "precision").agg(F.count_distinct("items", "mark").alias("sets")).agg(F.count_if(F.col("sets") > 1).alias("V12 same items in every language"))
    out = None
    for part in (rows, matched, per_cell, across):
        each = part.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias("broken")) for c in part.columns))).alias("x")).select("x.*")
        out = each if out is None else out.union(each)
    return out


def check(tidy: DataFrame, manifest: DataFrame, precisions: tuple[str, ...] = PRECISIONS) -> None:
    """Raises ContractError on the first broken rule."""
    if tidy.columns != TIDY:
        raise ContractError("V1 columns and their order", f"{tidy.columns}")
    found = {r["rule"]: r["broken"] for r in report(tidy, manifest, precisions).collect()}
    for rule in sorted(found, key=lambda r: int(r[1:].split()[0])):
        if found[rule]:
            raise ContractError(rule, f"{found[rule]} broken")


def unique_keys(rows: DataFrame, by: str, candidates: list[list[str]]) -> DataFrame:
    """by, key, n, n_distinct, is_unique: which candidate keys tell a group's rows apart."""
    named = {"#".join(c): F.struct(*c) for c in candidates}
    counted = rows.groupBy(by).agg(F.count("*").alias("n"), *(F.count_distinct(k).alias(name) for name, k in named.items()))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("key"), F.col(f"`{name}`").alias("n_distinct")) for name in named))).alias("x")
    return counted.select(by, "n", each).select(by, F.col("x.key").alias("key"), "n", F.col("x.n_distinct").alias("n_distinct"), (F.col("n") == F.col("x.n_distinct")).alias("is_unique"))


def key_parity(rows: DataFrame, by: str, reference: str, key: str, value: str) -> DataFrame:
    """by, missing, extra, differing: keys and values of each group against the reference group's."""
    ref = rows.where(F.col(by) == reference).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    groups = rows.where(F.col(by) != reference)
    size = ref.agg(F.count_distinct("_k").alias("total"))
    met = groups.join(ref, groups[key] == ref["_k"], "left").groupBy(by).agg(F.count_distinct("_k").alias("found"), F.count_if(F.col("_k").isNull()).alias("extra"), F.count_if(F.col("_k").isNotNull() & (F.col(value) != F.col("_v"))).alias("differing"))
    return met.join(F.broadcast(size)).select(by, (F.col("total") - F.col("found")).alias("missing"), "extra", "differing")


def contexts_under_two_groups(rows: DataFrame, text: str, group: str) -> DataFrame:
    """digest, groups, n: texts that stand under more than one group."""
    marked = rows.select(F.sha2(F.col(text), 256).alias("digest"), group)
    return marked.groupBy("digest").agg(F.count_distinct(group).alias("groups"), F.count("*").alias("n")).where("groups > 1")


def gold_conflicts(grid: DataFrame) -> DataFrame:
    """lang, item_id, golds: items whose gold answer is not the same in every arm."""
    return grid.groupBy("lang", "item_id").agg(F.count_distinct("gold").alias("golds")).where("golds > 1")


def unknown_keys(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def conservation(parts: DataFrame, by: str, dropped: str) -> DataFrame:
    """by, n_source, n_items, n_dropped, holds: whether every source row is an item or a drop, once (V19). parts: one row for each item or drop, with a column ``n_source`` of its group's rows."""
    sums = parts.groupBy(by).agg(F.max("n_source").alias("n_source"), F.count_if(F.col(dropped).isNull()).alias("n_items"), F.count(dropped).alias("n_dropped"))
    return sums.withColumn("holds", F.col("n_items") + F.col("n_dropped") == F.col("n_source"))


def spread_of_rates(rates: DataFrame, rate: str, ceiling: float, by: list[str] | None = None) -> DataFrame:
    """by..., lowest, highest, spread, within: how far rates are apart."""
    sums = rates.groupBy(*(by or [])).agg(F.min(rate).alias("lowest"), F.max(rate).alias("highest"), (F.max(rate) - F.min(rate)).alias("spread"))
    return sums.withColumn("within", F.col("spread") <= ceiling)


def row_fraction(parts: DataFrame, by: str, partition: str, low: float = 0.70, high: float = 0.90) -> DataFrame:
    """by, fraction, within: the share of a group's rows that are in training."""
    share = F.count_if(F.col(partition) == "train") / F.count("*")
    return parts.groupBy(by).agg(share.alias("fraction")).withColumn("within", F.col("fraction").between(low, high))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both."""
    return a.select(key).intersect(b.select(key))
