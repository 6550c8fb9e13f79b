"""Connected components of an edge table, distributed: least labels spread along edges, with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.llm.common import cut, forget, frugal

ROUNDS = 60


def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a batch, a star for each component takes the place of its edges."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in list(root)]
        pairs = [(x, y) for x, y in pairs if x != y]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node that it reaches): one row for each node of ``edges`` (a, b: long)."""
    few = edges.mapInArrow(frugal(thin), "a long, b long")
    both = cut(few.union(few.select("b", "a")).toDF("u", "v").distinct(), "cc-edges")
    label = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("comp")), "cc-label")
    for _ in range(ROUNDS):
        told = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("comp").alias("near"))
        lower = cut(label.join(told, F.col("node") == F.col("u")).select("node", F.least("comp", "near").alias("comp"), (F.col("near") < F.col("comp")).alias("moved")), "cc-lower")
        if not lower.where("moved").limit(1).count():
            forget(both, lower)
            return label
        up = lower.select(F.col("node").alias("top"), F.col("comp").alias("above"))
        old, label = label, cut(lower.join(up, F.col("comp") == F.col("top")).select("node", F.col("above").alias("comp")), "cc-label")
        forget(old, lower)
    raise RuntimeError(f"components not settled after {ROUNDS} rounds")
