import json

import pytest
from pyspark.sql import functions as F

from pairsight.errors import ContractError
from pairsight.functions import config
from pairsight.operators import freeze
from pairsight.sources import benchmark, readers, writers
from pairsight.streaming import ingest


def record(k, pred=1, lang="eng", precision="fp16", alias="m-ft-eng"):
    return {"run_id": f"main__{alias}__{lang}__{precision}", "model": "hub/m", "model_alias": alias, "model_revision": "r", "weights_from": "/x", "arm": "finetuned", "precision": precision, "lang": lang, "item_id": f"i#{k}", "pred": pred, "gold": 1, "correct": int(pred == 1), "letter_logits": [1.0, 0.0, 0.0, 0.0], "latency_ms": float(k), "input_tokens": 10 + k, "truncated": False, "prompt_sha256": "0" * 64}


def meta(**change):
    base = {"run_id": "main__m-ft-eng__eng__fp16", "model": "hub/m", "model_alias": "m-ft-eng", "model_revision": "r", "weights_from": "/x", "arm": "finetuned", "precision": "fp16", "lang": "eng", "n_items": 4, "n_correct": 3, "n_truncated": 0, "env": {"gpu_name": "T4"}, "limit": None}
    return base | change


def written(folder, metas):
    folder.mkdir(exist_ok=True)
    for m in metas:
        stem = f"main__{m['model_alias']}__{m['lang']}__{m['precision']}"
        (folder / f"{stem}.meta.json").write_text(json.dumps(m, indent=1))
        (folder / f"{stem}.jsonl").write_text("\n".join(json.dumps(record(k, 2 if k == 0 else 1, alias=m["model_alias"])) for k in range(4)) + "\n\n")
    return str(folder)


def test_records_summary_and_latency(spark, tmp_path):
    path = written(tmp_path / "raw", [meta()])
    records = readers.read_records(spark, path)
    row = readers.run_summary(records, ["run_id"]).first()
    assert (row.n_items, row.n_correct, row.median_latency_ms, row.p25_latency_ms) == (4, 3, 1.5, 0.25)
    assert readers.tidy(records).columns == ["model", "model_revision", "precision", "lang", "item_id", "pred", "gold", "correct"]
    assert readers.latency(readers.read_meta(spark, path)).first().gpu_name == "T4"
    assert readers.inventory(records, 4).first().complete and readers.repeated_records(records).count() == 0
    assert readers.cells_by_name(records.drop("arm").selectExpr("*", "'base' as arm"), "m-ft-eng", 4).count() == 4
    with pytest.raises(ContractError):
        readers.cells_by_name(records, "m-ft-eng", 4)


def test_bad_line_and_empty_folder_are_fatal(spark, tmp_path):
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.jsonl").write_text('{"run_id": "a"')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|corrupt"):
        readers.read_records(spark, str(bad)).collect()
    (tmp_path / "empty").mkdir()
    with pytest.raises(ContractError):
        readers.read_records(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("change, problem", [({}, None), ({"precision": "int3"}, "unknown precision"), ({"model_revision": "z"}, "revision differs"), ({"arm": "base"}, "arm not finetuned"), ({"limit": 5}, "limited run"), ({"n_correct": 4}, "records differ from manifest"), ({"n_truncated": 1}, "truncated prompts"), ({"weights_from": "hub"}, "weights are the hub's"), ({"model_alias": "m"}, "not a tuned alias")])
def test_cells_are_verified(spark, tmp_path, change, problem):
    path = written(tmp_path / "raw", [meta(**change)])
    got = readers.verify_runs(readers.read_meta(spark, path), readers.read_records(spark, path), "m", "r", ["eng"], 4, ("fp16", "nf4")).first()
    assert got.accepted == (problem is None) and (problem is None or problem in got.problems)


def test_csv_has_no_nan(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([("a", float("nan")), ("b", 1.5)], "k string, v double"), str(tmp_path / "c"), ["k"])
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    assert text.split() == ["k,v", "a,", "b,1.5"] or text.split() == ["k,v", 'a,""', "b,1.5"]


def test_digests_and_drift(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    (d / "a.txt").write_bytes(b"x\r\ny\n")
    (d / "b.txt").write_bytes(b"x\ny\n")
    same = freeze.file_digests(spark, str(d), text=True)
    assert same.select("digest").distinct().count() == 1 and freeze.file_digests(spark, str(d)).select("digest").distinct().count() == 2
    was = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, digest string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4")], "path string, digest string")
    assert {tuple(r) for r in freeze.drift(was, now).collect()} == {("b", "changed"), ("d", "unregistered")}
    m = {"b": 1, "a": [2], "sha256": "old"}
    assert freeze.self_digest(m) == freeze.self_digest({"a": [2], "b": 1}) and freeze.manifest_drift({"a": 1}, {"a": 2, "b": 3}, ["a", "b"]) == ["a", "b"]


def plain_config():
    return {
        "precisions": ["fp16", "nf4"],
        "models": [{"alias": "m", "hf_id": "hub/m", "role": "primary"}],
        "benchmark": {"languages": ["a", "b"], "reference_language": "a", "revision": None},
        "scoring": {"method": "letter_logit", "option_letters": ["A", "B", "C", "D"], "max_input_tokens": 4096},
    }


def tuned_config():
    tuned = {
        "lang_configs": {"a": "da", "b": "db"}, "train_fraction": 0.8, "group_key": "title", "n_options": 4, "heldout_eval_cap": 900, "train_precision": "fp16",
        "seeds": {"main": 1, "sensitivity": 2, "sensitivity_languages": ["a"]}, "split_seed": 3, "final_scope_languages": ["a"],
        "distractors": {"source": "same_article"}, "context_window": {"policy": "span_covering_tokens"}, "training": {"max_seq_tokens": 1024},
    }
    return plain_config() | {"finetune": tuned}


def changed(tree, dotted, value):
    tree = json.loads(json.dumps(tree))
    at = tree
    *path, last = dotted.split(".")
    for part in path:
        at = at[part]
    at[last] = value
    return tree


def test_config_null_is_fatal(tmp_path):
    config.validate(plain_config())
    config.validate(tuned_config())
    with pytest.raises(ContractError, match="not known yet"):
        config.require(plain_config(), "benchmark.revision")
    with pytest.raises(ContractError, match="missing"):
        config.require(plain_config(), "benchmark.nothing")
    (tmp_path / "c.json").write_text(json.dumps(tuned_config()))
    assert config.load(str(tmp_path / "c.json")) == tuned_config()
    with pytest.raises(ContractError):
        config.load(str(tmp_path / "other.json"))


@pytest.mark.parametrize(
    "dotted, value",
    [
        ("precisions", ["int4"]), ("scoring.method", "guess"), ("benchmark.reference_language", "z"), ("benchmark.languages", ["a", "a"]), ("models", [{"alias": "m__x", "hf_id": "h"}]), ("models", [{"alias": "m"}]),
        ("finetune.lang_configs", {"a": "da"}), ("finetune.lang_configs", {"a": "d", "b": "d"}), ("finetune.train_fraction", 1.0), ("finetune.train_fraction", None), ("finetune.group_key", ""), ("finetune.n_options", 3),
        ("finetune.heldout_eval_cap", 0), ("finetune.heldout_eval_cap", True), ("finetune.train_precision", "nf4"), ("finetune.seeds.main", 2), ("finetune.seeds.main", "x"), ("finetune.seeds.sensitivity_languages", ["z"]),
        ("finetune.split_seed", None), ("finetune.final_scope_languages", []), ("finetune.final_scope_languages", ["z"]), ("finetune.distractors.source", "web"), ("finetune.distractors.source", "other_article"),
        ("finetune.distractors.exclude_same_article", True), ("finetune.context_window.policy", "all"), ("finetune.training.max_seq_tokens", 0), ("finetune.training.max_seq_tokens", 5000),
    ],
)
def test_each_config_rule_is_fatal(dotted, value):
    with pytest.raises(ContractError):
        config.validate(changed(tuned_config(), dotted, value))


def test_registry_and_its_check(spark, tmp_path):
    d = tmp_path / "frozen"
    d.mkdir()
    (d / "a.txt").write_bytes(b"x\r\n")
    (d / "b.txt").write_bytes(b"y")
    tree = {"kept": {"v": 1}, "free": 2}
    registry = freeze.register(spark, str(d), ["a.txt", "b.txt", "later.txt"], tree, ["kept"])
    assert freeze.still_missing(registry) == ["later.txt"]
    assert freeze.check(spark, str(d), registry, tree) == ["later.txt: registered as not there, nothing to compare with"]
    registry["files"].pop("later.txt")
    (d / "a.txt").write_bytes(b"x\n")  # another line end is no change
    assert freeze.check(spark, str(d), registry, tree | {"free": 3, "new": 1}) == []
    (d / "b.txt").write_bytes(b"z")
    (d / "a.txt").unlink()
    assert freeze.check(spark, str(d), registry, {"kept": {"v": 2}}) == ["a.txt: missing", "b.txt: changed", "config: changed"]
    with pytest.raises(ContractError):
        freeze.subtree_digest(tree, ["gone"])


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"run_id": "a"}\n\n{"run_id": \n')
    (row,) = readers.bad_lines(spark, str(tmp_path)).collect()
    assert row.line == 3 and row.file_path.endswith("x.jsonl")


def test_tuned_runs_beside_their_base(spark, tmp_path):
    path = written(tmp_path / "raw", [meta()])
    records = readers.read_records(spark, path)
    assert readers.check_tuned_run(records, records) == ["scores are those of the base"]
    moved = records.withColumn("letter_logits", F.transform("letter_logits", lambda x: x + 1))
    assert readers.check_tuned_run(records, moved) == []
    odd = moved.withColumns({"letter_logits": F.array(F.lit(float("nan"))), "pred": F.lit(1)}).where("item_id <> 'i#0'")
    assert readers.check_tuned_run(records, odd)[:1] == ["3 items without finite scores"]
    metas = readers.read_meta(spark, path)
    verdicts = readers.verify_runs(metas, records, "m", "r", ["eng"], 4, ("fp16", "nf4"))
    assert readers.accepted_records(metas, records, verdicts).count() == 4
    assert readers.accepted_records(metas, records, verdicts.withColumn("accepted", F.lit(False))).count() == 0


def test_benchmark_is_held_against_its_manifest(spark):
    def rows(change=None):
        out = [{"link": f"l{k // 2}", "question_number": k % 2, "flores_passage": "p", "question": "q", "correct_answer_num": k % 4 + 1, **{f"mc_answer{i}": f"o{i}" for i in range(1, 5)}} for k in range(6)]
        if change:
            change(out)
        return spark.createDataFrame(out, "link string, question_number int, flores_passage string, question string, correct_answer_num int, mc_answer1 string, mc_answer2 string, mc_answer3 string, mc_answer4 string")

    manifest = spark.createDataFrame([(f"l{k // 2}#{k % 2}", k % 4 + 1) for k in range(6)], "item_id string, gold int")
    load = lambda change=None: benchmark.load(rows(change), manifest, "eng", ["link", "question_number"], 6)
    got = load().collect()
    assert [r.item_id for r in got] == sorted(f"l{k // 2}#{k % 2}" for k in range(6)) and got[0].options == ["o1", "o2", "o3", "o4"]
    for change, rule in ((lambda r: r.pop(), "wrong count"), (lambda r: r[0].update(question_number=1), "repeated"), (lambda r: r[0].update(link="z"), "unknown"), (lambda r: r[0].update(correct_answer_num=4), "gold differs")):
        with pytest.raises(ContractError, match=rule):
            load(change)
    with pytest.raises(ContractError, match="no items"):
        benchmark.load(rows().limit(0), manifest, "eng", ["link", "question_number"], 6)


def test_stream_reads_each_record_once(spark, tmp_path):
    raw = tmp_path / "raw"
    written(raw, [meta()])
    (raw / "copy.jsonl").write_text((raw / "main__m-ft-eng__eng__fp16.jsonl").read_text())
    q = ingest.stream_records(spark, str(raw)).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 4
