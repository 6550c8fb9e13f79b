"""Hashed draws: the same numbers as hashlib's, dealt over tasks however few the groups are."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsight.functions import draws
from pairsight.operators import paired


def number(seed, rep, place):
    return int(hashlib.md5(f"{seed}|{rep}|{place}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("seed, reps, places", [(7, (0, 3), (0, 120)), (20260826, (8, 12), (95, 1102)), (1, (9998, 10002), (999_990, 1_000_010)), (-3, (0, 1), (0, 1)), (1, (5, 6), (99_990, 130_000))])
def test_numbers_are_those_of_md5(seed, reps, places):
    got = {}
    for first, block in draws.hashed(seed, reps, places):
        for k, row in enumerate(block):
            got.setdefault(first + k, []).extend(row.tolist())
    assert got == {r: [number(seed, r, j) for j in range(*places)] for r in range(*reps)}


@pytest.mark.parametrize("n", [1, 5, 300, 70_003])
def test_sums_of_groups_that_share_their_draws(n):
    groups = [np.sort(np.random.default_rng(k).choice(v, n)) for k, v in enumerate(([-2, -1, 0, 1], [-4, 0, 4], [3]))]
    edges = np.array([[(g <= v).sum() for v in range(-4, 4)] for g in groups])
    got = draws.sums(9, n, (9, 11), (0, n), edges, np.arange(-4, 5))
    for r in (9, 10):
        at = [number(9, r, j) % n for j in range(n)]
        assert [x[r - 9] for x in got] == [g[at].sum() for g in groups]


def test_groups_of_several_sizes_and_pieces_of_work(spark, monkeypatch):
    """More groups of one size than share a row, places in several pieces: as drawn one by one."""
    monkeypatch.setattr(paired, "UNIT", 64)
    monkeypatch.setattr(paired, "SHARED", 2)
    sizes = {"a": 90, "b": 90, "c": 90, "d": 7, "e": 1}
    data = {g: np.sort(np.random.default_rng(k).choice([-1, 0, 2], n)) for k, (g, n) in enumerate(sizes.items())}
    df = spark.createDataFrame([(g, int(x)) for g, v in data.items() for x in v], "g string, d int").repartition(3)
    got = {r.g: r for r in paired.bootstrap_hashed(df, ["g"], 25, 3).collect()}
    assert got.keys() == sizes.keys()
    for g, v in data.items():
        s = np.array([v[[number(3, r, j) % len(v) for j in range(len(v))]].sum() for r in range(25)])
        low, high = np.percentile(s / len(v), (2.5, 97.5))
        p = min(1.0, 2 * min((s <= 0).mean(), (s >= 0).mean()))
        assert (got[g].n, got[g].n_boot) == (len(v), 25) and [got[g].delta, got[g].ci_low, got[g].ci_high, got[g].p_bootstrap] == pytest.approx([v.mean(), low, high, p])


def test_draws_are_dealt_over_tasks(spark):
    """Two groups make a handful of rows, which adaptive plans would put into one task."""
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 3 - 1).cast("int").alias("d"))
    spark.sparkContext.setJobGroup("draws", "")
    paired.bootstrap_hashed(df, ["g"], 200, 1).collect()
    spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("draws") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 16


def test_cross_model_draws_as_many_replicates_as_the_library():
    """Both sides: the query and its SQL; the other queries keep theirs."""
    import inspect

    from pairsight.operators import replication
    from pairsight.plans import catalog

    default = inspect.signature(replication.cross_model).parameters["n_boot"].default
    assert catalog.CROSS_REPLICATES == default == 20_000 and f"range(0, {default}) t(rep)" in catalog.ORACLES["cross_model"]
    assert "CROSS_REPLICATES, 1, hashed=True" in inspect.getsource(catalog.cross_model)
    assert all(f"range(0, {catalog.REPLICATES}) t(rep)" in catalog.ORACLES[q] for q in ("grid_rq1", "grid_rq2"))
