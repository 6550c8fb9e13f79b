"""Keys, splits and samples by hash: deterministic, and the same on any number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsight.functions.seeds import hash_rank


def ordinals(rows: DataFrame, group: str, order: list[str], ties: list[str]) -> DataFrame:
    """rows with ordinal (from 0 within the group) and item_id = group#ordinal."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order, *ties)) - 1
    return rows.withColumn("ordinal", place).withColumn("item_id", F.concat(F.col(group).cast("string"), F.lit("#"), F.col("ordinal").cast("string")))


def grouped_split(rows: DataFrame, by: str, group: str, fraction: float, seed: object, label: str = "split") -> DataFrame:
    """by, group, partition: whole groups go to train or heldout; the share is rounded half to even, and both sides get one, so one group alone is fatal."""
    groups = rows.select(by, group).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(hash_rank(F.lit(str(seed)), F.col(by), F.lit(label), F.col(group)), group))
    n = F.count("*").over(Window.partitionBy(by))
    cut = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(fraction)).cast("long")))
    side = F.when(rank <= cut, "train").otherwise("heldout")
    alone = F.concat(F.lit("K4 split: one group alone can't be on both sides: "), F.col(by).cast("string"))
    return groups.select(by, group, F.when(n < 2, F.raise_error(alone)).otherwise(side).alias("partition"))


def capped(rows: DataFrame, by: str, key: str, cap: int, seed: object, label: str) -> DataFrame:
    """At most ``cap`` rows of each group, by hash rank."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(hash_rank(F.lit(str(seed)), F.col(by), F.lit(label), F.col(key)), key))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def one_per_group(rows: DataFrame, by: str, group: str, key: str, n: int, seed: object, label: str = "sample") -> DataFrame:
    """The first row (by key) of each of n groups that are chosen by hash."""
    first = rows.withColumn("_first", F.row_number().over(Window.partitionBy(by, group).orderBy(key))).where("_first = 1").drop("_first")
    return capped(first, by, group, n, seed, label)


def equalised_cap(rows: DataFrame, by: str) -> DataFrame:
    """cap: the number of rows of the smallest group."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).agg(F.min("n").alias("cap"))


def first_n(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.orderBy(key).limit(n)


def distinct_by_text(rows: DataFrame, by: list[str], folded: str, key: str) -> DataFrame:
    """Of rows with one folded text the first by key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, folded).orderBy(key))).where("_n = 1").drop("_n")


def id_digest(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """by..., n, digest: SHA-256 of the distinct keys, sorted, one a line."""
    ids = F.sort_array(F.collect_set(F.col(key).cast("string")))
    return rows.groupBy(*by).agg(F.size(ids).cast("long").alias("n"), F.sha2(F.array_join(ids, "\n"), 256).alias("digest"))


def content_digest(rows: DataFrame, by: list[str], key: str, parts: list[str], sep: str = "\x1f") -> DataFrame:
    """by..., n, digest: SHA-256 over rows in key order, parts joined by ``sep``, a line each."""
    line = F.concat_ws(sep, F.col(key).cast("string"), *(F.col(p).cast("string") for p in parts))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line"))))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), 256).alias("digest"))
