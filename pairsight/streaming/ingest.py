"""Extension: records that arrive as files, read as a stream.

The batch readers scan the raw folder anew each time. This reads each file once and keeps
one row of each run and item, within a watermark on the time of reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.sources import schemas


def stream_records(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    rows = spark.readStream.schema(schemas.RECORD).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    return rows.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["run_id", "item_id"])


def stream_accuracy(records: DataFrame) -> DataFrame:
    """Running accuracy of each cell, for output mode complete or update."""
    return records.groupBy("model", "precision", "lang").agg(F.count("*").alias("n"), F.sum((F.col("pred") == F.col("gold")).cast("int")).alias("correct"))
