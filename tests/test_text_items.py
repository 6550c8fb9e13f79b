import pytest
from pyspark.sql import functions as F

from pairsight.functions import seeds, text
from pairsight.operators import contamination, mcq, splits


def test_folding(spark):
    df = spark.createDataFrame([("  Straße \u001c A\tB ",), (None,)], "s string")
    got = [r.f for r in df.select(text.fold_exact("s").alias("f")).collect()]
    assert got == ["strasse a b", None]


def test_digit_class_and_bucket(spark):
    df = spark.createDataFrame([("1923",), ("in 1923 he",), ("words",), ("১৮ 5",), ("a b c d",)], "s string")
    got = df.select(text.digit_class(F.col("s")).alias("d"), text.length_bucket(F.col("s")).alias("n")).collect()
    assert [r.d for r in got] == ["numeric", "mixed", "text", "numeric", "text"] and [r.n for r in got] == [0, 1, 0, 1, 2]


def test_occurrences_overlap_and_guards(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("a", "aa"), ("abc", "")], "h string, n string")
    assert [r.o for r in df.select(text.occurrences(F.col("h"), F.col("n")).alias("o")).collect()] == [[1, 2, 3], [], []]


def test_alias_round_trip(spark):
    df = spark.createDataFrame([("m", "x_Y", 1), ("m", "x_Y", 3)], "m string, l string, e int")
    a = text.alias_of(F.col("m"), F.col("l"), F.col("e"))
    got = df.select(a.alias("a"), text.alias_parts(a).alias("p")).collect()
    assert [r.a for r in got] == ["m-ft-x_Y", "m-ft3ep-x_Y"] and [tuple(r.p) for r in got] == [("m", "ft", 1, "x_Y"), ("m", "ft", 3, "x_Y")]
    assert tuple(spark.range(1).select(text.alias_parts(F.lit("plain")).alias("p")).first().p) == ("plain", "base", None, None)


def test_key_with_null_is_null(spark):
    assert spark.range(1).select(text.composite_key(F.lit("a"), F.lit(None).cast("string")).alias("k")).first().k is None


def test_seed_matches_python(spark):
    assert int(spark.range(1).select(seeds.seed_column(F.lit("a"), F.lit(3)).alias("s")).first().s) == seeds.seed_of("a", 3)


def test_split_is_a_partition_and_does_not_move(spark):
    rows = spark.createDataFrame([(lang, f"g{k}") for lang in "ab" for k in range(10) for _ in range(5)], "lang string, g string")
    a = splits.grouped_split(rows, "lang", "g", 0.85, 1).orderBy("lang", "g").collect()
    b = splits.grouped_split(rows.repartition(7), "lang", "g", 0.85, 1).orderBy("lang", "g").collect()
    assert a == b and sum(r.partition == "train" for r in a if r.lang == "a") == 8  # 8.5 to even


def test_containment_is_exact(spark):
    passages = spark.createDataFrame([(1, "say that the quick brown fox jumps over it"), (2, "the quick brown dog"), (3, "xthe quick brown foxy")], "pid long, p string")
    parts = spark.createDataFrame([("s1", "the quick brown fox"), ("s2", "fox"), ("s3", "quick brown")], "sid string, s string")
    got = {tuple(r) for r in contamination.contained(passages, parts, "pid", "p", "sid", "s").collect()}
    want = {(p.pid, s.sid) for p in passages.collect() for s in parts.collect() if s.s in p.p}
    assert got == want


def corpus(spark, articles=12):
    rows = []
    for a in range(articles):
        words = [f"w{a}x{k}" for k in range(80)]
        answers = {10: f"Alpha{a}", 25: f"Beta{a}", 40: f"Gamma{a}", 55: f"Delta{a}", 70: f"{1900 + a}"}
        for at, answer in answers.items():
            words[at] = answer
        context = " ".join(words)
        for k, answer in enumerate(answers.values()):
            rows.append((f"art{a}", context, f"question {k}?", answer, context.find(answer), f"art{a}#{k}"))
    return spark.createDataFrame(rows, "group_id string, context string, question string, answer string, answer_start int, item_id string")


@pytest.mark.parametrize("budget", [64, 512])
def test_items_are_well_formed_and_fit(spark, budget):
    items = mcq.build_items(corpus(spark), "eng", "train", 7, budget).cache()
    kept = items.where("reason is null").collect()
    assert len(kept) == 60 and mcq.malformed(items).count() == 0
    for r in kept:
        assert r.options[r.gold - 1] == r.gold_text and all(o in r.passage for o in r.options)
        assert r.overflowed_budget or r.prompt_tokens <= budget
    again = mcq.build_items(corpus(spark).repartition(5), "eng", "train", 7, budget)
    assert sorted(map(str, again.where("reason is null").collect())) == sorted(map(str, kept))


def test_diagnostics_and_gates(spark):
    items = mcq.build_items(corpus(spark), "eng", "train", 7, 512)
    d = mcq.diagnostics(items, ["lang"]).first()
    assert d.n_items == 60 and d.n_dropped == 0 and d.same_article_share == 1 and d.presence_gap == 0 and d.shortcut_accuracy == pytest.approx(0.25)
    assert sum(d[f"gold_rank_{k}"] for k in range(1, 5)) == pytest.approx(1)
    gates = {r.gate: r.passes for r in mcq.gates(mcq.diagnostics(items, ["lang"]), ["lang"]).collect()}
    assert gates["shortcut"] and gates["same article"] and gates["options"] and gates["presence gap"]


def test_source_rows_shift_and_reasons(spark):
    rows = [("T", "1", "  The cat sat", "q", (["cat"], [6])), ("T", "2", "The cat sat", "q", (["dog"], [0])), ("", "3", "x", "q", (["x"], [0])), ("T", "4", "a cat", "q", (["cat"], [0]))]
    raw = spark.createDataFrame(rows, "title string, id string, context string, question string, answers struct<text:array<string>, answer_start:array<int>>")
    got = {r.source_id: (r.answer_start, r.reason) for r in mcq.source_rows(raw).collect()}
    assert got == {"1": (4, None), "2": (None, "answer not in context"), "3": (0, "missing field"), "4": (2, None)}


def test_one_group_alone_is_refused(spark):
    rows = spark.createDataFrame([("a", "g1"), ("a", "g2"), ("b", "g1")], "lang string, g string")
    with pytest.raises(Exception, match="K4 split"):
        splits.grouped_split(rows, "lang", "g", 0.8, 1).collect()


def test_alias_with_the_separator_is_refused(spark):
    with pytest.raises(Exception, match="P12 alias"):
        spark.range(1).select(text.alias_of(F.lit("m__x"), F.lit("l"), F.lit(1))).collect()


def test_prompt_strips_every_white_space(spark):
    df = spark.createDataFrame([("\u2003 a\u00a0", "\x1cb\n")], "a string, b string")
    assert df.select(text.prompt({"a": F.col("a"), "b": F.col("b")}, ["Q: |{a}", "{b}", "Answer:"]).alias("p")).first().p == "Q: a\nb\nAnswer:"


def test_surface_key_agrees_with_its_parts(spark):
    row = spark.createDataFrame([("in 1923 he",)], "s string").select(text.surface_key(F.col("s")).alias("k")).first()
    assert tuple(row.k) == ("mixed", 1)


def test_training_examples_keep_the_end(spark):
    items = spark.createDataFrame([("i", 2, [1, 2, 3, 4, 5]), ("j", 1, [9])], "item_id string, gold int, ids array<int>")
    got = {r.item_id: (r.input_ids, r.labels) for r in mcq.training_examples(items, F.col("ids"), [71, 72], 4).collect()}
    assert got == {"i": ([3, 4, 5, 72], [-100, -100, -100, 72]), "j": ([9, 71], [-100, 71])}
    with pytest.raises(Exception, match="F17 gold"):
        mcq.training_examples(items, F.col("ids"), [71], 4).collect()
