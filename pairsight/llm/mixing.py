"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share the
budget; a target stops at ``cap`` times its source's size and the excess is shared again,
which is water-filling with one level. Rates: within a source, documents get rates
``cap / (1 + exp(-lambda * size / mean))``, the least change in bounded entropy that meets
the source's token constraint; lambda solves the convex dual by Newton steps that are
kept inside a bracket. One step is one aggregation over (source, size) counts, so its
cost does not depend on the number of rows once they are counted; rates that do not settle
end the job. Rounding: copies follow the running sum of rates over sizes, so at every size
the copies are within one half of what the rates say; the words that this leaves over or
short are then made up from the largest sizes that fit down to small ones, ``ROUNDS``
times, so that a source ends within about its smallest documents of its target. Equal
sizes share their copies over hashed blocks, so that a hot (source, size) is dealt over
many tasks. Lambda is rounded, so that reruns agree whatever the order of sums.

Defined results: null text has size 0 and takes 0; a source without words has target 0;
an empty table gives no rows; rows that repeat a doc_id are documents of their own; a
null doc_id is an ordinary value; columns other than doc_id, text, source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsight.llm.common import cut, forget

BLOCKS = 1024
STEPS = 60
ROUNDS = 5
CLOSE = 1e-7
#: A source further off its target than this share after all steps ends the job.
FAR = 1e-3
WIDEST = 1e5


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """source, number, source_size, docs, target: one row for each source (sources are few: one task orders them)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    everything = Window.partitionBy()
    numbered = (
        sources.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("number") - 1, F.lit(len(weights))).cast("int") + 1).cast("double"))
        .withColumn("top", F.col("source_size") * F.lit(float(cap)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("weight_total", F.sum("weight").over(everything))
    )
    before = Window.orderBy(F.col("top") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.col("weight_total") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    stepped = numbered.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("top"))
    place = F.struct((F.col("top") / F.col("weight")).alias("ratio"), "number", "level")
    water = F.min(F.when(~F.col("full"), place)).over(everything)["level"]
    return stepped.withColumn("water", water).select(
        "source", "number", "source_size", "docs", F.when(F.col("water").isNull(), F.col("top")).otherwise(F.least(F.col("top"), F.col("water") * F.col("weight"))).alias("target")
    )


def rate(cap: float, lam: str = "lam"):
    """The tilted rate of a document of this size; a source whose target is its cap has rate cap."""
    tilted = F.lit(float(cap)) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -F.col(lam) * F.col("size") / F.col("mean")))))
    return F.when(F.col("target") >= F.lit(float(cap)) * F.col("source_size"), F.lit(float(cap))).otherwise(tilted)


def solve(counts: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """targets with lam: Newton's steps on the dual, one aggregation each; stops when every source is within CLOSE of its target."""
    state = targets.select(
        "*",
        F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)).alias("mean"),
        F.lit(0.0).alias("lam"),
        F.lit(-WIDEST).alias("lo"),
        F.lit(WIDEST).alias("hi"),
        F.lit(1.0).alias("off"),
    )
    fixed = [*targets.columns, "mean"]
    for _ in range(STEPS):
        r, z = rate(cap), F.col("size") / F.col("mean")
        sums = (
            counts.join(state.select("number", "source_size", "target", "mean", "lam"), "number")
            .select("number", (F.col("n") * F.col("size") * r).alias("f"), (F.col("n") * F.col("size") * z * r * (F.lit(1.0) - r / F.lit(float(cap)))).alias("g"))
            .groupBy("number")
            .agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
        )
        off = F.col("f") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.try_divide(off, F.col("g"))
        kept = F.when(step.isNotNull() & (step > F.col("lo2")) & (step < F.col("hi2")), step).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        error = F.abs(off) / F.greatest(F.col("target"), F.lit(1.0))
        state = (
            state.join(sums, "number")
            .withColumns({"lo2": lo, "hi2": hi, "error": error})
            .withColumn("next", F.when(F.col("error") < CLOSE, F.col("lam")).otherwise(kept))
            .select(*fixed, F.col("next").alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("error").alias("off"))
        )
        old, state = state, cut(state, "mix-state")
        forget(old)
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < CLOSE:
            break
    if worst is not None and worst >= FAR:
        raise RuntimeError(f"rates not settled after {STEPS} steps: a source is {worst:.3g} of its target off")
    return state.withColumn("lam", F.round("lam", 9))


def made_up(sums: DataFrame, cap: float) -> DataFrame:
    """(number, size) rows whose copies, ``all``, are raised or lowered until the source's words meet its target as nearly as sizes allow."""
    source = Window.partitionBy("number")
    larger = source.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(ROUNDS):
        short = F.floor(F.col("target") - F.sum(F.col("all") * F.col("size")).over(source) + F.lit(0.5)).cast("long")
        sums = sums.withColumn("short", short)
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("short"))
        room = F.when(fits, F.when(F.col("short") > 0, F.col("n") * F.lit(int(cap)) - F.col("all")).otherwise(F.col("all"))).otherwise(0)
        sums = sums.withColumn("room", room)
        left = F.abs("short") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(larger), F.lit(0))
        more = F.when(F.col("room") > 0, F.least(F.greatest(F.floor(left / F.col("size")), F.lit(0)), F.col("room"))).otherwise(0).cast("long")
        sums = sums.withColumn("all", F.col("all") + F.signum("short").cast("long") * more)
    return sums.drop("short", "room")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken: one row for each row of ``docs``."""
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size")), "mix-sizes")
    targets = cut(source_targets(sized, weights, budget, cap), "mix-targets")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)).cast("int")
    told = targets.select(F.col("source").alias("of"), "number")
    rows = sized.join(told, sized["source"].eqNullSafe(told["of"])).select("doc_id", "source", "size", "number", block.alias("block"))
    blocks = cut(rows.groupBy("number", "size", "block").agg(F.count("*").alias("held")), "mix-blocks")
    counts = blocks.groupBy("number", "size").agg(F.sum("held").alias("n"))
    state = solve(cut(counts, "mix-counts"), targets, cap)
    by_size = Window.partitionBy("number").orderBy("size")
    sums = (
        counts.join(state.drop("source"), "number")
        .withColumn("rate", rate(cap))
        .withColumn("run", F.floor(F.sum(F.col("n") * F.col("rate")).over(by_size.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(0.5)))
        .withColumn("all", F.col("run") - F.coalesce(F.lag("run").over(by_size), F.lit(0)))
        .select("number", "size", "n", "source_size", "target", "rate", F.col("all").cast("long").alias("all"))
    )
    sums = made_up(sums, cap)
    by_block = Window.partitionBy("number", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("held").over(by_block)
    each, extra = F.expr("`all` div n"), F.expr("`all` % n")
    shared = (
        blocks.join(sums, ["number", "size"])
        .withColumns({"each": each, "extra": extra, "end": end})
        .withColumn("more", F.expr("(extra * end) div n - (extra * (end - held)) div n"))
        .select("number", "size", "block", "source_size", "target", "rate", "each", "more")
    )
    place = F.row_number().over(Window.partitionBy("number", "size", "block").orderBy(F.xxhash64("doc_id"), "doc_id"))
    out = rows.join(cut(shared, "mix-shares"), ["number", "size", "block"]).withColumn("copies", F.col("each") + F.when(place <= F.col("more"), 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
