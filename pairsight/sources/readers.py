"""Readers of raw runs, manifests, tables and files. All go through Spark's readers, so any file system will do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.errors import ContractError
from pairsight.functions.text import alias_parts, commit_sha
from pairsight.sources import schemas


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per-item records of every ``*.jsonl`` below ``path``, with the file's name; a bad line or an empty folder is fatal.

    A bad line ends the job when it is read, with the file's name; ``bad_lines`` says which they are.
    Whether a tree holds records twice is for ``repeated_records``.
    """
    rows = (
        spark.read.schema(schemas.RECORD).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"))
    )
    if not rows.limit(1).count():
        raise ContractError("S1 records", f"none below {path}")
    return rows


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_path, line (from 1 within its file), text: lines of ``*.jsonl`` files that hold no JSON object."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    parsed = F.try_parse_json("text")
    return files.where((F.trim("text") != "") & (parsed.isNull() | ~F.startswith(F.ltrim("text"), F.lit("{")))).select("file_path", (F.col("line") + 1).alias("line"), "text")


def repeated_records(records: DataFrame) -> DataFrame:
    """run_id, item_id, n: what the tree holds more than once."""
    return records.groupBy("run_id", "item_id").agg(F.count("*").alias("n")).where("n > 1")


def tidy(records: DataFrame) -> DataFrame:
    """The eight tidy columns, in order; correct is computed, not trusted."""
    return records.select("model", "model_revision", "precision", "lang", "item_id", F.col("pred").cast("int"), F.col("gold").cast("int"), (F.col("pred") == F.col("gold")).cast("int").alias("correct"))


def inventory(records: DataFrame, expected: int) -> DataFrame:
    """model, precision, lang, n_items, complete: distinct items of each cell."""
    return records.groupBy("model", "precision", "lang").agg(F.count_distinct("item_id").alias("n_items")).withColumn("complete", F.col("n_items") == expected)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests (``*.meta.json``), one row a file; keys that a manifest lacks are null."""
    return spark.read.schema(schemas.META).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").option("multiLine", "true").option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def latency(meta: DataFrame) -> DataFrame:
    """One row for each run: the latency table, apart from accuracy."""
    return meta.select("model", "precision", "lang", "n_items", "median_latency_ms", "mean_latency_ms", "p25_latency_ms", "p75_latency_ms", "median_input_tokens", "peak_memory_reserved_gb", "warmup", "repeats", F.col("env")["gpu_name"].alias("gpu_name"), "timestamp_utc")


def mixed_hardware(latencies: DataFrame) -> DataFrame:
    """n_gpus, mixed: whether latencies come from more than one kind of GPU."""
    return latencies.agg(F.count_distinct("gpu_name").alias("n_gpus")).withColumn("mixed", F.col("n_gpus") > 1)


def verify_runs(meta: DataFrame, records: DataFrame, base_model: str, revision: str, langs: list[str], n_expected: int, precisions: tuple[str, ...]) -> DataFrame:
    """run_id, accepted, problems: every rule that a tuned cell breaks, not the first alone."""
    counted = records.groupBy(F.regexp_replace("file_name", r"\.jsonl$", "").alias("stem")).agg(F.count("*").alias("rows"), F.sum((F.col("pred") == F.col("gold")).cast("int")).alias("hits"), F.count_distinct("item_id").alias("items"))
    parts = alias_parts(F.col("model_alias"))
    met = meta.withColumns({"stem": F.regexp_replace("file_name", r"\.meta\.json$", ""), "_p": parts}).join(counted, "stem", "left")
    rules = {
        "not a tuned alias": F.col("_p.arm") != "ft",
        "other base model": F.col("_p.model") != base_model,
        "tuned on an unknown language": ~F.coalesce(F.col("_p.lang").isin(langs), F.lit(False)),
        "scored on another language": F.col("_p.lang") != F.col("lang"),
        "unknown precision": ~F.coalesce(F.col("precision").isin(*precisions), F.lit(False)),
        "revision differs": ~F.col("model_revision").eqNullSafe(F.lit(revision)),
        "weights are the hub's": F.coalesce(F.col("weights_from"), F.lit("hub")) == "hub",
        "arm not finetuned": ~F.coalesce(F.col("arm") == "finetuned", F.lit(False)),
        "limited run": F.col("limit").isNotNull(),
        "item count": ~F.col("n_items").eqNullSafe(F.lit(n_expected)),
        "truncated prompts": F.coalesce(F.col("n_truncated"), F.lit(0)) > 0,
        "no records": F.col("rows").isNull(),
        "records differ from manifest": F.col("rows").isNotNull() & ((F.col("rows") != F.col("n_items")) | (F.col("hits") != F.col("n_correct")) | (F.col("items") != F.col("rows"))),
    }
    problems = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return met.select("run_id", "model_alias", "lang", "precision", problems.alias("problems")).withColumn("accepted", F.size("problems") == 0)


def cells_by_name(records: DataFrame, alias: str, n_expected: int) -> DataFrame:
    """Records of one alias whose file is named tag__alias__lang__precision; each cell must hold n rows and the base arm."""
    stem = F.split(F.regexp_replace("file_name", r"\.jsonl$", ""), "__")
    named = records.withColumn("_s", stem).where((F.size("_s") == 4) & (F.get("_s", 1) == alias))
    named = named.withColumns({"lang": F.get("_s", 2), "precision": F.get("_s", 3)}).drop("_s")
    if not named.limit(1).count():
        raise ContractError("S4 cell", f"no file of {alias}")
    bad = named.groupBy("lang", "precision").agg(F.count("*").alias("n"), F.count_if(F.coalesce("arm", F.lit("base")) != "base").alias("other")).where((F.col("n") != n_expected) | (F.col("other") > 0)).limit(1).collect()
    if bad:
        raise ContractError("S4 cell", f"{bad[0].asDict()}")
    return named


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def best_cell(accuracies: DataFrame, base_columns: list[str]) -> DataFrame:
    """The row of the highest accuracy; of equal ones the first by key."""
    return accuracies.orderBy(F.desc("accuracy"), *base_columns).limit(1)


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON file as a dict; fatal if it is missing."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def manifest_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """item_id, gold, place of a frozen item manifest."""
    gold = manifest["gold_by_item_id"]
    return spark.createDataFrame([(i, int(gold[i]), k) for k, i in enumerate(manifest["item_ids"])], "item_id string, gold int, place int")


def invalid_revisions(revisions: DataFrame) -> DataFrame:
    return revisions.where(~F.coalesce(commit_sha(F.col("revision")), F.lit(False)))


def run_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, correct, truncated, latency median, mean and exclusive quartiles, median tokens."""
    from pairsight.operators.ranks import exclusive_quantiles

    # exact percentiles keep (value, count) pairs, the quartiles' neighbours come from ranks
    quartiles = exclusive_quantiles(records.where("latency_ms is not null"), "latency_ms", by, {"p25_latency_ms": 0.25, "p75_latency_ms": 0.75})
    sums = records.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        F.sum((F.col("pred") == F.col("gold")).cast("int")).cast("long").alias("n_correct"),
        F.count_if("truncated").alias("n_truncated"),
        F.median("latency_ms").alias("median_latency_ms"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.median("input_tokens").alias("median_input_tokens"),
    )
    return sums.join(quartiles, by, "left").select(*by, "n_items", "n_correct", "n_truncated", "median_latency_ms", "mean_latency_ms", "p25_latency_ms", "p75_latency_ms", "median_input_tokens")


def check_tuned_run(base: DataFrame, tuned: DataFrame) -> list[str]:
    """What is wrong with a tuned run beside its base, from their records (V30): scores that are not finite, that are the base's own, one letter throughout."""
    from pairsight.functions.stats import finite

    shape = tuned.agg(F.count_if(~F.coalesce(finite(F.col("letter_logits")), F.lit(False))).alias("odd"), F.count_distinct("pred").alias("letters"), F.count("*").alias("n")).first()
    moved = logit_shift(base, tuned).first()
    problems = []
    if not shape["n"] or moved["n"] != shape["n"]:
        problems.append(f"{moved['n']} of {shape['n']} items are in the base run")
    if shape["odd"]:
        problems.append(f"{shape['odd']} items without finite scores")
    if moved["n"] and not moved["max_shift"]:
        problems.append("scores are those of the base")
    if shape["letters"] == 1:
        problems.append("one letter is predicted throughout")
    return problems


def accepted_records(meta: DataFrame, records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The records of runs that ``verify_runs`` accepts (S3)."""
    stems = meta.join(verdicts.where("accepted").select("run_id"), "run_id", "left_semi").select(F.regexp_replace("file_name", r"\.meta\.json$", "").alias("_stem"))
    return records.join(stems, F.regexp_replace("file_name", r"\.jsonl$", "") == F.col("_stem"), "left_semi")


def logit_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """max_shift, changed, n: how far two runs' option scores are apart over their items."""
    met = a.select("item_id", F.col("letter_logits").alias("_a"), F.col("pred").alias("_pa")).join(b.select("item_id", F.col("letter_logits").alias("_b"), F.col("pred").alias("_pb")), "item_id")
    return met.agg(F.max(F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))).alias("max_shift"), F.count_if(F.col("_pa") != F.col("_pb")).alias("changed"), F.count("*").alias("n"))
