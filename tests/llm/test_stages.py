"""Decontamination and the stages of the pipeline against plain versions, on rows of every awkward kind."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from pairsight.llm import decontaminate, toxicity
from tests.llm.brute import contaminated
from tests.llm.fixtures import as_dict, corpus, frame
from tests.llm.test_dedup import brute_components

NAMES, PLACES = ["Anna", "Bruno", "Clara", "Dieter"], ["Rome", "Oslo", "Lima"]
VOCABULARY = "the cat of house runs under red sky with slow river and many green boats over old stone walls".split()


def question(rng):
    words = [rng.choice(VOCABULARY) for _ in range(rng.randrange(6, 22))]
    for _ in range(rng.randrange(0, 5)):
        words.insert(rng.randrange(1, len(words)), rng.choice([rng.choice(NAMES), rng.choice(PLACES), str(rng.randrange(2, 99)), f"{rng.randrange(2, 99)} kg"]))
    return " ".join(words) + rng.choice(["?", ".", ""])


def asked_again(rng, text):
    swap = dict(zip(NAMES + PLACES, rng.sample(["Egon", "Fiona", "Greta", "Hugo", "Kyoto", "Paris", "Quito"], 7)))
    number = defaultdict(lambda: str(rng.randrange(100, 9999)))
    return " ".join(swap.get(w.strip("?."), number[w.strip("?.")] if w.strip("?.").isdigit() else w) for w in text.split(" "))


def planted(seed):
    rng = random.Random(seed)
    items = [(k, question(rng)) for k in range(8)] + [(8, None), (9, ""), (10, "12 + 30 * 4 - 7 / 2 + 18 * 3"), (11, "Short one"), (3, question(rng)), (None, "the cat of house runs under red sky")]
    docs = []
    for k in range(60):
        text = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 40)))
        item = rng.choice([t for _, t in items if t])
        change = k % 6
        part = (item, asked_again(rng, item), item.upper(), item.replace(" ", " \n "), " ".join(item.split()[: len(item.split()) // 2]), "")[change]
        docs.append((k, f"{text} {part} {text[:30]}"))
    return docs + [(60, None), (61, ""), (62, " \n "), (63, "<n> <p> <u> \x01n " + items[0][1]), (64, (items[1][1] + " ") * 3), (65, "word " * 5000 + items[2][1])], items


@pytest.mark.parametrize("seed, broadcast", [(1, 200_000), (2, 0)])
def test_decontamination_against_brute_force(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    docs, items = planted(seed)
    benchmark = spark.createDataFrame([(k, t, 1, "x") for k, t in items], "item_id long, text string, doc_id int, hash string")
    got = as_dict(decontaminate.contamination(frame(spark, docs), benchmark), "n_items", "n_hits", "best_item", "contaminated")
    want = {d: contaminated(t, items) for d, t in docs}
    assert {d: got[d] for d in want} == want
    assert 20 < sum(x[3] for x in want.values()) < 60


def folder(spark, path, labels, items):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_grade(word, lexicon):
    """0 none, 1 exact, 2 misspelt: every term by itself."""
    near = 0
    for term in lexicon:
        letters, stem = term.rstrip("*"), term.endswith("*")
        cuts = [word[:n] for n in range(len(word) + 1)] if stem else [word]
        if letters in cuts:
            return 1
        if len(letters) >= toxicity.FUZZY_FROM and any(edits(c, letters) <= 1 for c in cuts):
            near = 2
    return near


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its predecessor's rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(7)
    copies, items = planted(3)
    rows = corpus(50, seed=9, null_id=True) + [(1000 + d, t) for d, t in copies]
    rows += [(2000 + k, " ".join(rng.choice(VOCABULARY) for _ in range(12)) + (" you vilefool grumpkin" if k % 6 == 0 else "")) for k in range(160)]
    labels = [(d, 1, int("vilefool" in (t or ""))) for d, t in rows if d is not None and d >= 2000]
    sf = folder(spark, tmp_path, labels, items)
    docs = frame(spark, rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "toxicity":
            lexicon, _ = toxicity.learn(frame(spark, rows), spark.read.parquet(f"{sf}/labels.parquet"))
            assert lexicon
            for (d, t), n in Counter(before).items():
                hits = [brute_grade(toxicity.plain(w), lexicon) for w in (t or "").lower().split()]
                assert kept[name][d, t] == (0 if any(hits) and d is not None else n), (d, t)
        elif name == "exact_dedup":
            best = {}
            for d, t in before:
                key = (t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))
                best[key] = min(best.get(key, (1, 0)), (-len(t or ""), float("inf") if d is None else d))
            ids = {d for _, d in best.values()}
            assert kept[name] == Counter((d, t) for d, t in before if d is None or d in ids)
        elif name == "near_dedup":
            at = brute_components(before, 5, 80)
            assert kept[name] == Counter((d, t) for d, t in before if at[d][1] in (None, d))
        elif name == "decontamination":
            assert kept[name] == Counter((d, t) for d, t in before if d is None or not contaminated(t, items)[3])
        else:
            assert set(kept[name]) <= set(before) and {r.copies for r in docs.collect()} <= {1, 2}
            sizes = {(d, t): len((t or "").split()) for d, t in before}
            taken = sum(r.copies * sizes[r.doc_id, r.text] for r in docs.collect())
            assert abs(taken - 1.5 * sum(sizes.values())) <= 12
    assert all(kept[a].total() > kept[b].total() for a, b in zip(["toxicity", "exact_dedup"], ["near_dedup", "decontamination"]))


def test_stages_of_an_empty_table(spark, tmp_path):
    sf = folder(spark, tmp_path, [], [])
    docs = frame(spark, []).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_rows_that_repeat_a_document(spark, tmp_path):
    """Rows of one doc_id share each decision."""
    items = [(0, "the cat of house runs under red sky with slow river and many green boats")]
    sf = folder(spark, tmp_path, [], items)
    rows = [(1, "x " + items[0][1]), (1, "x " + items[0][1]), (2, "a b c d e f g h"), (2, "a b c d e f g h")]
    docs = frame(spark, rows)
    assert dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, sf).count() == 2
    assert dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, sf).count() == 4
    assert dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf).count() == 4
