"""Items from contexts that stand once: as by looking at every pair of questions."""

import random

from pyspark.sql import functions as F

from pairsight.operators import mcq
from pairsight.plans.catalog import QUERIES


def brute(text, asked, q, alike):
    """The distractors that all candidates, sorted whole, give; None where there are too few."""
    gold, own = (q["answer_start"], q["answer_start"] + len(q["answer"])), mcq.folded_answer(q["answer"])
    best = {}
    for o in sorted((o["item_id"], o["answer"], (o["digits"], o["words"])) for o in asked if o["item_id"] != q["item_id"] and mcq.folded_answer(o["answer"]) != own):
        best.setdefault(mcq.folded_answer(o[1]), o)
    sides = []
    for side in ("left", "right"):
        found = []
        for item, answer, kind in best.values():
            there = [s for s in mcq.places(text, answer) if (s[1] <= gold[0] if side == "left" else s[0] >= gold[1])]
            if there and not (alike and kind != (q["digits"], q["words"])):
                span = max(there) if side == "left" else min(there)
                found.append((gold[0] - span[0] if side == "left" else span[1] - gold[1], int(kind != (q["digits"], q["words"])), answer, item, span))
        sides.append([{"gap": g, "text": t, "id": i, "span": s} for g, _, t, i, s in sorted(found)])
    return mcq.choose(*sides, gold)


def test_nearest_candidates_are_those_of_a_whole_sort():
    rng = random.Random(4)
    for _ in range(150):
        words = [rng.choice(["aa", "Aa", "a", "aab", "b1", "B1", "c", "dd d", "12", "e"]) for _ in range(rng.randint(4, 40))]
        text = "".join(w + rng.choice([" ", "", "  "]) for w in words)
        asked = []
        for k in range(rng.randint(3, 14)):
            answer = rng.choice(words)
            start = rng.choice([s for s, _ in mcq.places(text, answer, 99)])
            asked.append({"item_id": f"i{k}", "question": "q", "answer": answer, "answer_start": start, "digits": "mixed" if any(c.isdigit() for c in answer) else "text", "words": int(" " in answer)})
        held = mcq.Candidates(text, asked)
        for q in asked:
            gold, own, kind = (q["answer_start"], q["answer_start"] + len(q["answer"])), mcq.folded_answer(q["answer"]), (q["digits"], q["words"])
            for alike in (True, False):
                left, right = (held.nearest(gold, own, kind, side, 3, alike) for side in ("left", "right"))
                assert mcq.choose(left, right, gold) == brute(text, asked, q, alike)


def test_inside_finds_the_tokens_that_a_stretch_touches():
    spans = mcq.whitespace_tokens("ab  c def g  hi")
    for order in (spans, [(0, 0), *spans, (0, 0)]):
        held = mcq.Tokens(order)
        for lo in range(15):
            for hi in range(lo + 1, 16):
                want = [k for k, (a, b) in enumerate(order) if b > lo and a < hi]
                assert held.inside(lo, hi)[2] == len(want) and (not want or held.inside(lo, hi)[:2] == (want[0], want[-1] + 1))


def test_contexts_meet_from_several_partitions_and_keep_odd_rows(spark):
    text = "one two three four five six"
    rows = [(f"g{g}", text, "?", w, text.find(w), f"g{g}#{w}") for g in range(2) for w in text.split()]
    rows += [(None, text, "?", "one", 0, "n#1"), ("g0", None, "?", "one", 0, "n#2"), ("g0", text, "?", "two", None, "n#3")]
    df = spark.createDataFrame(rows, "group_id string, context string, question string, answer string, answer_start int, item_id string").repartition(5)
    assert sorted(len(r.asked) for r in mcq.contexts(df).collect()) == [1, 1, 6, 7]
    got = {r.item_id: r.reason for r in mcq.build_items(df, "eng", "train", 1).collect()}
    assert len(got) == 15 and {k for k, v in got.items() if v} == {"n#1", "n#2", "n#3"}


def test_a_context_is_shuffled_once_at_most(spark, tmp_path):
    """No join of questions with questions or with their contexts, which would send a text once for each line."""
    rng = random.Random(1)
    text = "\n".join("".join(rng.choices("abcdefghij", k=40)) for _ in range(300))
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["mcq_diagnostics"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.n_items, r.n_dropped) for r in df.collect()] == [(300, 0)]
    rows = spark.createDataFrame([("g", text, "?", w, text.find(w), w) for w in text.split()], "group_id string, context string, question string, answer string, answer_start int, item_id string")
    assert mcq.contexts(rows).agg(F.sum(F.length("context"))).first()[0] == len(text)
