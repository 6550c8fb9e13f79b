"""From raw question-answer rows to a frozen, verified training corpus, by language.

``build_language`` makes every table of one language and raises on the first broken rule;
``build_manifest`` freezes what several languages gave; ``load_partition`` builds again,
compares with the frozen manifest, and only then hands items out. What crosses to the
driver is counts and digests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.errors import ContractError
from pairsight.operators import contract, mcq, splits
from pairsight.operators.freeze import manifest_drift, self_digest

PARTITIONS = ("train", "heldout")
SOURCE_CEILING, CONSTRUCTION_CEILING = 0.02, 0.08
SPREAD_CEILING = 0.10
ROW_FRACTION = (0.70, 0.90)
#: What a rebuilt language must have in common with the frozen manifest.
FROZEN = ["n_source_rows", "n_items", "n_dropped", "train_groups_sha256", "heldout_groups_sha256", "content_sha256", "choices_sha256"]


@dataclass(frozen=True)
class Plan:
    """What a build is made with."""

    fraction: float = 0.8
    seed: object = 0
    heldout_cap: int = 900
    budget: int = 512
    tokens: Callable = mcq.whitespace_tokens


@dataclass(frozen=True)
class Language:
    """One language's tables. ``items`` holds both partitions, and the questions that made none with their reason."""

    lang: str
    rows: DataFrame
    groups: DataFrame
    items: DataFrame
    counts: dict
    plan: Plan

    def kept(self, partition: str) -> DataFrame:
        return self.items.where((F.col("partition") == partition) & F.col("reason").isNull())

    def heldout_eval(self) -> DataFrame:
        """The held-out items that are evaluated: all, or ``heldout_cap`` of them by hash."""
        return splits.capped(self.kept("heldout"), "lang", "item_id", self.plan.heldout_cap, self.plan.seed, "heldout_eval")

    def diagnostics(self) -> DataFrame:
        return mcq.diagnostics(self.items, ["lang", "partition"], F.lit(self.counts["n_source_rows"]))


def source(raw: DataFrame, lang: str, ceiling: float = SOURCE_CEILING) -> DataFrame:
    """Usable rows with item_id = article#ordinal; fatal where more than ``ceiling`` of the raw rows are unusable."""
    rows = mcq.source_rows(raw)
    n = rows.agg(F.count("*").alias("n"), F.count("reason").alias("dropped")).first()
    if not n["n"] or n["dropped"] > ceiling * n["n"]:
        raise ContractError("V20 source", f"{lang}: {n['dropped']} of {n['n']} rows unusable")
    kept = rows.where("reason is null").drop("reason").withColumn("lang", F.lit(lang))
    twice = contract.contexts_under_two_groups(kept, "context", "group_id").limit(1).collect()
    if twice:
        raise ContractError("V17 contexts", f"{lang}: a context stands under {twice[0]['groups']} articles")
    return splits.ordinals(kept, "group_id", ["question", "answer"], ["source_id", "answer_start"])


def counted(rows: DataFrame, items: DataFrame) -> dict:
    """n_source_rows, and the items kept and dropped by partition."""
    out = {"n_source_rows": rows.count(), "n_items": {}, "n_dropped": {}}
    for r in items.groupBy("partition").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("dropped")).collect():
        out["n_items"][r["partition"]], out["n_dropped"][r["partition"]] = r["kept"], r["dropped"]
    return out


def build_language(raw: DataFrame, lang: str, plan: Plan = Plan()) -> Language:
    """Split by article, items of both partitions, every rule checked (C8: V17 to V21)."""
    rows = source(raw, lang)
    groups = splits.grouped_split(rows, "lang", "group_id", plan.fraction, plan.seed)
    sides = rows.join(groups.select("group_id", "partition"), "group_id")
    items = None
    for part in PARTITIONS:
        made = mcq.build_items(sides.where(F.col("partition") == part), lang, part, plan.seed, plan.budget, plan.tokens)
        items = made if items is None else items.unionByName(made)
    counts = counted(rows, items)
    n, kept, dropped = counts["n_source_rows"], sum(counts["n_items"].values()), sum(counts["n_dropped"].values())
    if kept + dropped != n:
        raise ContractError("V19 conservation", f"{lang}: {kept} items and {dropped} dropped of {n} rows")
    if dropped > CONSTRUCTION_CEILING * n:
        raise ContractError("V20 construction", f"{lang}: {dropped} of {n} rows make no item")
    bad = mcq.malformed(items).limit(1).collect()
    if bad:
        raise ContractError("V21 items", f"{lang}: {bad[0]['item_id']}: {bad[0]['rule']}")
    return Language(lang, rows, groups, items, counts, plan)


def frozen(built: Language) -> dict:
    """What is frozen of a language: counts and digests."""
    out = dict(built.counts)
    for r in splits.id_digest(built.groups, ["partition"], "group_id").collect():
        out[f"{r['partition']}_groups_sha256"] = r["digest"]
    flat = built.items.where("reason is null").withColumn("choices", F.array_join("options", "\x1e"))
    for name, parts in (("content_sha256", ["passage", "question", "choices", "gold"]), ("choices_sha256", ["choices", "gold"])):
        out[name] = {r["partition"]: r["digest"] for r in splits.content_digest(flat, ["partition"], "item_id", parts).collect()}
    ids = built.heldout_eval().select("item_id", "gold").collect()  # heldout_cap rows at most
    out["heldout_eval_item_ids"] = sorted(r["item_id"] for r in ids)
    out["heldout_eval_gold"] = {r["item_id"]: r["gold"] for r in ids}
    return out


def equalise_cap(manifest: dict) -> int:
    """The training items of the smallest language."""
    return min(x["n_items"]["train"] for x in manifest["languages"].values())


def comparable(rates: dict[str, float], ceiling: float = SPREAD_CEILING) -> None:
    """Fatal where the languages' drop rates are further apart than ``ceiling``."""
    if len(rates) > 1 and max(rates.values()) - min(rates.values()) > ceiling:
        raise ContractError("V23 drop rates", f"{rates}")


def build_manifest(raws: dict[str, DataFrame], plan: Plan = Plan()) -> dict:
    """The manifest of all languages, with its own digest; fatal on any rule, the honesty gates (V22) and rules across languages (V23) among them."""
    languages, rates = {}, {}
    for lang, raw in raws.items():
        built = build_language(raw, lang, plan)
        mcq.require(mcq.gates(built.diagnostics(), ["lang", "partition"]))
        counts = built.counts
        share = (counts["n_items"]["train"] + counts["n_dropped"]["train"]) / counts["n_source_rows"]
        if not ROW_FRACTION[0] <= share <= ROW_FRACTION[1]:
            raise ContractError("V23 row fraction", f"{lang}: {share:.3f} of the rows are in training")
        rates[lang] = counts["n_dropped"]["train"] / counts["n_source_rows"]
        languages[lang] = frozen(built)
    comparable(rates)
    manifest = {"languages": languages, "fraction": plan.fraction, "seed": str(plan.seed), "heldout_cap": plan.heldout_cap, "budget": plan.budget}
    manifest["train_equalise_cap"] = equalise_cap(manifest)
    return manifest | {"sha256": self_digest(manifest)}


def verify(built: Language, manifest: dict) -> None:
    """Fatal where a rebuilt language differs from the frozen one, or the manifest from its own digest."""
    if manifest.get("sha256") != self_digest(manifest):
        raise ContractError("V28 manifest", "its digest is another")
    if built.lang not in manifest["languages"]:
        raise ContractError("V26 corpus", f"{built.lang} is not in the manifest")
    off = manifest_drift(frozen(built), manifest["languages"][built.lang], FROZEN)
    if off:
        raise ContractError("V26 corpus", f"{built.lang}: {', '.join(off)}")


def load_partition(raw: DataFrame, lang: str, partition: str, manifest: dict, plan: Plan = Plan()) -> DataFrame:
    """Verified items of train (cut to the common size), train_full, heldout or heldout_eval."""
    if partition not in ("train", "train_full", "heldout", "heldout_eval"):
        raise ContractError("C9 partition", partition)
    built = build_language(raw, lang, plan)
    verify(built, manifest)
    if partition == "heldout_eval":
        return built.heldout_eval()
    items = built.kept(partition.removesuffix("_full"))
    return splits.capped(items, "lang", "item_id", equalise_cap(manifest), plan.seed, "train_equalise") if partition == "train" else items
