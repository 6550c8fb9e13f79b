"""Language build, manifest, verified partitions."""

import json

import pytest

from pairsight.errors import ContractError
from pairsight.operators import corpus

PLAN = corpus.Plan(fraction=0.8, seed=4, heldout_cap=6, budget=512)
RAW = "title string, id string, context string, question string, answers struct<text:array<string>, answer_start:array<int>>"


def raw(spark, lang="x", articles=10, change=None):
    rows = []
    for a in range(articles):
        words = [f"{lang}{a}x{k}" for k in range(80)]
        answers = {10: f"Alpha{a}", 25: f"Beta{a}", 40: f"Gamma{a}", 55: f"Delta{a}", 70: f"Omega{a}"}
        for at, answer in answers.items():
            words[at] = answer
        context = " ".join(words)
        rows += [[f"{lang} art {a}", f"{a}-{k}", context, f"question {k}?", ([answer], [context.find(answer)])] for k, answer in enumerate(answers.values())]
    if change:
        change(rows)
    return spark.createDataFrame([tuple(r) for r in rows], RAW)


def fair(monkeypatch):
    """The synthetic articles have one order of answers, so gold letters and ranks of a few items are uneven."""
    monkeypatch.setattr(corpus.mcq, "require", lambda gated: None)


def test_language_is_conserved_and_split_by_article(spark):
    built = corpus.build_language(raw(spark), "x", PLAN)
    assert built.counts == {"n_source_rows": 50, "n_items": {"train": 40, "heldout": 10}, "n_dropped": {"train": 0, "heldout": 0}}
    sides = {p: {r.group_id for r in built.kept(p).select("group_id").distinct().collect()} for p in corpus.PARTITIONS}
    assert not sides["train"] & sides["heldout"] and len(sides["train"]) == 8
    assert built.heldout_eval().count() == 6
    assert {r.n_items for r in built.diagnostics().collect()} == {40, 10}


def unusable(rows):
    for r in rows[:2]:
        r[4] = (["nowhere"], [0])


def under_two(rows):
    for r in rows[5:10]:
        r[2], r[4] = rows[0][2], rows[0][4]


def few_answers(rows):
    del rows[2:5]
    for a in (1, 2, 3):
        start = next(k for k, r in enumerate(rows) if r[0].endswith(f"art {a}"))
        del rows[start + 2 : start + 5]


@pytest.mark.parametrize("change, rule", [(unusable, "V20 source"), (under_two, "V17"), (few_answers, "V20 construction"), (lambda rows: rows.__delitem__(slice(5, None)), "K4 split")])
def test_a_broken_source_is_refused(spark, change, rule):
    with pytest.raises(Exception, match=rule):
        corpus.build_language(raw(spark, change=change), "x", PLAN)


def test_manifest_and_partitions(spark, monkeypatch):
    fair(monkeypatch)
    raws = {"x": raw(spark), "y": raw(spark, "y", 15)}
    manifest = json.loads(json.dumps(corpus.build_manifest(raws, PLAN)))
    assert manifest["train_equalise_cap"] == 40
    load = lambda lang, part: corpus.load_partition(raws[lang].repartition(3), lang, part, manifest, PLAN)
    assert load("y", "train").count() == 40 and load("y", "train_full").count() == 60
    assert sorted(r.item_id for r in load("x", "heldout_eval").collect()) == manifest["languages"]["x"]["heldout_eval_item_ids"]
    with pytest.raises(ContractError, match="C9"):
        load("x", "test")
    with pytest.raises(ContractError, match="V26"):
        corpus.load_partition(raw(spark, change=lambda rows: rows[0].__setitem__(3, "another?")), "x", "train", manifest, PLAN)
    with pytest.raises(ContractError, match="V28"):
        corpus.load_partition(raws["x"], "x", "train", manifest | {"budget": 1}, PLAN)


def test_rules_across_languages():
    corpus.comparable({"a": 0.01, "b": 0.1})
    with pytest.raises(ContractError, match="V23"):
        corpus.comparable({"a": 0.01, "b": 0.2})


def test_gates_stop_a_manifest(spark):
    with pytest.raises(ContractError, match="V2[23]"):
        corpus.build_manifest({"x": raw(spark, articles=2)}, PLAN)
