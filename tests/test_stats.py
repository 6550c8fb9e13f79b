import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsight.functions import stats
from pairsight.operators import paired


def test_wilson_known_cells_and_ends(spark):
    rows = [(427, 900), (806, 900), (0, 10), (10, 10), (0, 0)]
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame(rows, "k long, n long").select(low.alias("lo"), high.alias("hi")).collect()
    assert round(got[0].lo, 4) == 0.4420 and round(got[0].hi, 4) == 0.5071
    assert round(got[1].lo, 4) == 0.8739 and round(got[1].hi, 4) == 0.9139
    assert got[2].lo == 0 and got[3].hi == 1 and got[4].lo is None


def test_mcnemar_against_binomial_sums(spark):
    rows = [(69, 62), (110, 77), (65, 35), (131, 76), (0, 0), (5, 0), (400, 300), (20_000, 19_500)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", stats.mcnemar_exact(F.col("a"), F.col("b")).alias("p")).collect()
    for a, b, p in got:
        n, k = a + b, min(a, b)
        want = 1.0 if not n else min(1.0, 2 * float(sum(math.comb(n, i) for i in range(k + 1)) * 10**30 // 2**n) / 10**30) if n < 1000 else None
        if want is not None:
            assert p == pytest.approx(want, abs=1e-11)
    assert round(got[0].p, 4) == 0.6003 and round(got[2].p, 6) == 0.003518
    assert 0.01 < got[7].p < 0.013  # normal approximation: z = 2.51


def test_holm_vector_and_families(spark):
    rows = [("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "a", 0.04)]
    got = stats.holm_columns(spark.createDataFrame(rows, "f string, k string, p double"), "p", ["f"], ["k"], "h").collect()
    found = {(r.f, r.k): round(r.h, 9) for r in got}
    assert found == {("f", "a"): 0.03, ("f", "b"): 0.06, ("f", "c"): 0.06, ("g", "a"): 0.04}


def test_three_quantiles_differ(spark):
    v = [float(x) for x in range(1, 11)]
    arr = F.array(*map(F.lit, v))
    row = spark.range(1).select(stats.exclusive_quantile(arr, 0.25).alias("e"), stats.floor_quantile(arr, 0.25).alias("f"), stats.exclusive_quantile(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 0.25).alias("short")).first()
    assert row.e == 2.75 and row.f == 3.0 and row.short is None


def test_argmax_first_wins_and_finite(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],), ([float("nan"), 1.0, 0.0, 0.0],)], "v array<double>")
    got = df.select(stats.argmax(F.col("v")).alias("a"), stats.finite(F.col("v")).alias("f")).collect()
    assert got[0].a == 2 and got[0].f and not got[1].f


def planted(spark, seed=0, parts=1):
    """900 items; the reference loses 90, the other language 180: the interaction is +0.10."""
    rows = []
    for i in range(900):
        for lang, lost in (("L0", 90), ("L1", 180)):
            rows += [("base", "m", "r", "fp16", lang, i, 1, 1, 1), ("base", "m", "r", "nf4", lang, i, 1 if i >= lost else 2, 1, int(i >= lost))]
    np.random.default_rng(seed).shuffle(rows)
    cols = "arm string, model string, model_revision string, precision string, lang string, item_id string, pred int, gold int, correct int"
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], str(r[5]), int(r[6]), int(r[7]), int(r[8])) for r in rows], cols).repartition(parts)


def test_planted_interaction_does_not_move_with_order_or_partitions(spark):
    from pairsight.operators import grid

    got = [grid.rq1(planted(spark, seed, parts), "L0", 500, 3, ("fp16", "nf4")).collect() for seed, parts in ((0, 1), (5, 7))]
    assert got[0] == got[1]
    row = got[0][0]
    assert row.delta_interaction == pytest.approx(0.10) and row.ci_low > 0.05 and row.p_bootstrap < 0.01


def test_bootstrap_from_tallies_agrees_with_item_draws(spark):
    rng = np.random.default_rng(1)
    d = rng.choice([-1, 0, 1], 400, p=[0.1, 0.7, 0.2])
    df = spark.createDataFrame([("k", int(x)) for x in d], "k string, d int")
    a = paired.bootstrap(df, ["k"], 20_000, 1).first()
    b = paired.bootstrap_numpy(d, 20_000, 1)
    assert a.delta == pytest.approx(b["delta"]) and a.ci_low == pytest.approx(b["ci_low"], abs=0.006) and a.ci_high == pytest.approx(b["ci_high"], abs=0.006)


def test_recovery_null_unless_it_costs(spark):
    df = spark.createDataFrame([(10, 0.05, 100), (0, 0.05, 100), (-3, 0.1, 100)], "c long, g double, n long")
    got = [r.r for r in df.select(stats.recovery(F.col("c"), F.col("g"), F.col("n")).alias("r")).collect()]
    assert got[0] == pytest.approx(0.5) and got[1:] == [None, None]


def without(df, condition):
    return df.where(f"not ({condition})")


@pytest.mark.parametrize("gap", ["lang = 'L1' and precision = 'nf4' and item_id = '7'", "lang = 'L0' and precision = 'fp16' and item_id = '7'", "lang = 'L0' and item_id = '7'", "lang = 'L1' and item_id = '7'"])
def test_a_missing_item_is_fatal(spark, gap):
    """Cells are compared over the same items or not at all."""
    from pairsight.operators import grid

    broken = without(planted(spark), gap)
    with pytest.raises(Exception, match="J1 alignment"):
        grid.rq1(broken, "L0", 50, 3, ("fp16", "nf4")).collect()
    cells = {tuple(r) for r in paired.incomplete_cells(broken, ["arm"], ["lang", "precision"], "item_id").collect()}
    assert cells and all(held == 899 and missing == 1 for *_, held, missing in cells)


def test_degradation_and_recovery_refuse_gaps_and_skip_whole_cells(spark):
    from pairsight.operators import grid, replication

    rows = planted(spark)
    both = rows.unionByName(rows.withColumn("arm", F.lit("ft")))
    assert grid.degradation(both, ("fp16", "nf4")).count() == 4 and grid.rq3(both, ("fp16", "nf4")).count() == 4
    gap = without(both, "arm = 'ft' and lang = 'L1' and precision = 'nf4' and item_id = '7'")
    for table in (grid.degradation(gap, ("fp16", "nf4")), grid.rq3(gap, ("fp16", "nf4")), grid.rq2(gap, 50, 1, ("fp16", "nf4"))):
        with pytest.raises(Exception, match="J1 alignment"):
            table.collect()
    whole = without(both, "arm = 'ft' and lang = 'L1' and precision = 'nf4'")
    assert grid.degradation(whole, ("fp16", "nf4")).count() == 3 and grid.rq2(whole, 50, 1, ("fp16", "nf4")).count() == 1
    gate = replication.floor_gate(rows.where("precision = 'fp16'"))
    models = lambda x, n: replication.cross_model(rows, x, gate, F.col("precision") == "nf4", 50, 1, ("fp16", "nf4"), expected=n)
    assert models(rows, 900).count() == 2
    for x, n in ((without(rows, "item_id = '7'"), None), (rows, 901)):
        with pytest.raises(Exception, match="J1 alignment"):
            models(x, n).collect()


def test_hashed_bootstrap_and_blocks_of_numpy(spark):
    rng = np.random.default_rng(1)
    d = rng.choice([-1, 0, 1], 300, p=[0.1, 0.7, 0.2])
    df = spark.createDataFrame([("k", int(x)) for x in d], "k string, d int")
    a, b = paired.bootstrap_hashed(df, ["k"], 400, 1).first(), paired.bootstrap_numpy(d, 20_000, 1)
    assert a.n == 300 and a.delta == pytest.approx(b["delta"]) and a.ci_low == pytest.approx(b["ci_low"], abs=0.02) and a.ci_high == pytest.approx(b["ci_high"], abs=0.02)
    index = np.random.default_rng(1).integers(0, 300, size=(20_000, 300))
    assert b["ci_low"] == np.percentile(d[index].sum(axis=1) / 300, 2.5)


def test_ranks_and_order_statistics_over_ranges(spark):
    from pairsight.operators import ranks

    rng = np.random.default_rng(2)
    rows = [(g, float(rng.integers(0, 40))) for g in "aab" for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for g in "ab":
        v = np.sort([x for k, x in rows if k == g])
        want = {x: np.flatnonzero(v == x).mean() + 1 for x in set(v)}
        assert {r.x: r["rank"] for r in ranks.average_ranks(df, "x", ["g"]).where(F.col("g") == g).collect()} == pytest.approx(want)
        got = ranks.floor_quantiles(df, "x", ["g"], {"q50": 0.5, "q99": 0.99, "q100": 1.0}).where(F.col("g") == g).first()
        assert (got.n, got.q50, got.q99, got.q100) == (len(v), v[len(v) // 2], v[min(len(v) - 1, int(0.99 * len(v)))], v[-1])
    few = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0)], "g string, x double")
    assert ranks.exclusive_quantiles(few, "x", ["g"], {"q": 0.25}).first().q is None


def test_flags(spark):
    from pairsight.operators import replication

    cells = spark.createDataFrame([(0.2, 0.3), (0.26, 0.4), (0.1, 0.25)], "ci_low double, ci_high double")
    assert [r.touches_chance for r in replication.touches_chance(cells).collect()] == [True, False, True]
