"""From raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps; what it keeps is
written as Parquet and read again as the next stage's input. All stages but the last
return the columns of documents; the last adds each document's copies and its rate.

A doc_id is taken to name one document: rows that repeat a doc_id share each decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.llm.common import cut
from pairsight.llm.decontaminate import contamination
from pairsight.llm.exact_dedup import exact_duplicates
from pairsight.llm.mixing import mix_sources
from pairsight.llm.ngram_join import similar_components
from pairsight.llm.queries import table
from pairsight.llm.toxicity import toxicity

#: Words in a shingle, and the least similarity in per cent, of near duplicates.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``rejected``; a row without doc_id stays."""
    return docs.join(rejected.select(F.col("doc_id").alias("gone")).distinct(), F.col("doc_id") == F.col("gone"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, exact_duplicates(docs).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id stays."""
    return without(docs, similar_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT).where("component_id <> doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with copies (1 or 2) and rate."""
    mixed = mix_sources(docs).where("copies > 0").groupBy(F.col("doc_id").alias("of")).agg(F.max("copies").cast("long").alias("copies"), F.max("rate").alias("rate"))
    return docs.drop("copies", "rate").join(mixed, F.col("doc_id").eqNullSafe(F.col("of"))).drop("of")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: SQL can't express learning the lexicon nor the balanced rates; tests/llm/test_stages.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
