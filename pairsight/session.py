"""Session factory and the places where results between jobs are kept."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass the session that is there."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pairsight")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
