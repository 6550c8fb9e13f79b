import pytest
from pyspark.sql import functions as F

from pairsight.errors import ContractError
from pairsight.operators import contract

COLS = "model string, model_revision string, precision string, lang string, item_id string, pred int, gold int, correct int"


def tidy(spark, change=None):
    rows = [["m", "r", p, lang, f"i{k}", k % 4 + 1, k % 4 + 1, 1] for p in ("fp16", "nf4") for lang in ("a", "b") for k in range(6)]
    if change:
        change(rows)
    return spark.createDataFrame([tuple(r) for r in rows], COLS)


def manifest(spark):
    return spark.createDataFrame([(f"i{k}", k % 4 + 1) for k in range(6)], "item_id string, gold int")


def setter(column, value):
    def change(rows):
        rows[0][column] = value

    return change


def wrong_gold(rows):
    for r in rows:
        if r[4] == "i0":
            r[5] = r[6] = 3


def other_item(rows):
    rows[0][4] = rows[1][4]


@pytest.mark.parametrize(
    "rule, change",
    [("V2", setter(0, None)), ("V3", setter(2, "int3")), ("V4", setter(5, 5)), ("V5", setter(7, 2)), ("V6", setter(7, 0)), ("V7", setter(4, "other")), ("V8", wrong_gold), ("V10", lambda rows: rows.pop(0)), ("V11", setter(1, "r2"))],
)
def test_each_rule_is_named(spark, rule, change):
    with pytest.raises(ContractError) as e:
        contract.check(tidy(spark, change), manifest(spark))
    assert e.value.rule.split()[0] == rule


def test_whole_table_passes(spark):
    contract.check(tidy(spark), manifest(spark))


def test_duplicate_in_cell(spark):
    def twice(rows):
        rows.append(list(rows[0]))

    with pytest.raises(ContractError) as e:
        contract.check(tidy(spark, twice), manifest(spark))
    assert e.value.rule.startswith("V9")


def test_columns_and_order(spark):
    with pytest.raises(ContractError) as e:
        contract.check(tidy(spark).select("lang", *[c for c in contract.TIDY if c != "lang"]), manifest(spark))
    assert e.value.rule.startswith("V1 ")


def test_conflicting_gold_and_contexts(spark):
    rows = spark.createDataFrame([("a", "i", 1), ("a", "i", 2), ("b", "i", 1)], "lang string, item_id string, gold int")
    assert [r.lang for r in contract.gold_conflicts(rows).collect()] == ["a"]
    texts = spark.createDataFrame([("x", "g1"), ("x", "g2"), ("y", "g1")], "t string, g string")
    assert contract.contexts_under_two_groups(texts, "t", "g").select(F.col("groups")).first().groups == 2
