"""The driver's tables, and the analogues of the library's own inputs that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.functions.stats import PRECISIONS

LANGS = ["L0", "L1", "L2", "L3"]
REFERENCE = "L0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with the language and source of their documents; the text is not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


#: Orders as outcomes of arm x precision x language: order o is item o // 4 in language o % 4.
GRID_SQL = """
SELECT arm, precision, CONCAT('L', CAST(o_orderkey % 4 AS VARCHAR(20))) AS lang, CAST(FLOOR(o_orderkey / 4.0) AS BIGINT) AS item_id,
       CAST(CASE WHEN hit THEN g ELSE g % 4 + 1 END AS INT) AS pred, CAST(g AS INT) AS gold, CAST(CASE WHEN hit THEN 1 ELSE 0 END AS INT) AS correct
FROM (SELECT o_orderkey, arm, precision, CAST(FLOOR(o_orderkey / 4.0) AS BIGINT) % 4 + 1 AS g,
             (o_custkey * 7919 + o_orderkey * 10473 + p * 1299 + a * 523) % 1000 < 800 - 60 * (o_orderkey % 4) - 35 * p + 20 * a AS hit
      FROM orders CROSS JOIN (VALUES (0, 'fp16'), (1, 'int8_llmint8'), (2, 'nf4')) AS ps(p, precision) CROSS JOIN (VALUES (0, 'base'), (1, 'ft')) AS arms(a, arm)) x
"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, model, model_revision, precision, lang, item_id, pred, gold, correct."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cells = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(name).alias("precision"), F.lit(a).alias("a"), F.lit(arm).alias("arm")) for p, name in enumerate(PRECISIONS) for a, arm in enumerate(("base", "ft"))))
    rows = o.select("o_orderkey", "o_custkey", F.explode(cells).alias("c")).select("o_orderkey", "o_custkey", "c.*")
    item = F.expr("o_orderkey div 4")
    g = item % 4 + 1
    hit = (F.col("o_custkey") * 7919 + F.col("o_orderkey") * 10473 + F.col("p") * 1299 + F.col("a") * 523) % 1000 < 800 - 60 * (F.col("o_orderkey") % 4) - 35 * F.col("p") + 20 * F.col("a")
    return rows.select(
        "arm", F.lit("m").alias("model"), F.lit("r0").alias("model_revision"), "precision", F.concat(F.lit("L"), (F.col("o_orderkey") % 4).cast("string")).alias("lang"),
        item.alias("item_id"), F.when(hit, g).otherwise(g % 4 + 1).cast("int").alias("pred"), g.cast("int").alias("gold"), hit.cast("int").alias("correct"),
    )
