"""Sinks. Undefined numbers are written empty: NaN becomes null first."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_nan(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One CSV file with a header. For result tables, which are small."""
    out = without_nan(df)
    (out.orderBy(*order) if order else out).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Nulls are written, not left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tidy(df: DataFrame, path: str) -> None:
    """Parquet by language and precision, so that a cell's readers open its files alone."""
    df.write.mode("overwrite").partitionBy("lang", "precision").parquet(path)


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def write_json(value: object, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(value, out, indent=2, ensure_ascii=False, sort_keys=True)
        out.write("\n")
