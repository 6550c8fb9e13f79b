"""Freeze registry: digests of files and of manifests, and what has drifted since."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.errors import ContractError
from pairsight.sources.writers import canonical


def file_digests(spark: SparkSession, path: str, glob: str = "*", text: bool = False) -> DataFrame:
    """path, size, digest of every file below ``path``; with ``text`` line ends are made LF first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    body = F.encode(F.replace(F.decode("content", "utf-8"), F.lit("\r\n"), F.lit("\n")), "utf-8") if text else F.col("content")
    return files.select(F.col("path"), F.length("content").cast("long").alias("size"), F.sha2(body, 256).alias("digest"))


def folder_digest(digests: DataFrame) -> DataFrame:
    """n_files, total_size, digest over names and digests in order."""
    line = F.concat_ws("  ", F.col("digest"), F.regexp_extract("path", "[^/]*$", 0))
    return digests.agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))


def drift(registered: DataFrame, found: DataFrame) -> DataFrame:
    """path, state (changed, missing, unregistered): tables of path, digest; a registered null says that the file is not there yet."""
    a, b = registered.select("path", F.col("digest").alias("was")), found.select("path", F.col("digest").alias("is"))
    met = a.withColumn("_r", F.lit(True)).join(b, "path", "full_outer")
    state = F.when(F.col("_r").isNull(), "unregistered").when(F.col("was").eqNullSafe(F.col("is")), None).when(F.col("is").isNull(), "missing").otherwise("changed")
    return met.select("path", state.alias("state")).where("state is not null")


def subtree_digest(config: dict, keys: list[str]) -> str:
    """SHA-256 of the canonical JSON of these top-level keys; a key that is not there is fatal."""
    missing = [k for k in keys if k not in config]
    if missing:
        raise ContractError("V27 config", f"no {', '.join(missing)}")
    return hashlib.sha256(canonical({k: config[k] for k in keys}).encode()).hexdigest()


def register(spark: SparkSession, root: str, names: list[str], config: dict | None = None, keys: list[str] | None = None) -> dict:
    """The registry (C12): names below ``root`` with their digests, line ends made LF; null for a file that is not there yet."""
    found = {r["name"]: r["digest"] for r in named(file_digests(spark, root, text=True), names).collect()}
    out = {"files": {name: found.get(name) for name in sorted(names)}}
    if config is not None:
        out["config"] = {"keys": list(keys or config), "sha256": subtree_digest(config, list(keys or config))}
    return out


def named(digests: DataFrame, names: list[str]) -> DataFrame:
    """name, digest of the files whose path ends in one of the names."""
    each = digests.select("digest", F.explode(F.filter(F.array(*map(F.lit, names)), lambda n: F.endswith("path", F.concat(F.lit("/"), n)))).alias("name"))
    return each.select("name", "digest")


def check(spark: SparkSession, root: str, registry: dict, config: dict | None = None) -> list[str]:
    """What has drifted from the registry (V27): names with their state, and the configuration; empty if nothing has."""
    names = list(registry["files"])
    problems = [f"{n}: registered as not there, nothing to compare with" for n in names if registry["files"][n] is None]
    held = [(n, d) for n, d in registry["files"].items() if d is not None]
    if held:
        was = spark.createDataFrame(held, "path string, digest string")
        found = named(file_digests(spark, root, text=True), [n for n, _ in held]).withColumnRenamed("name", "path")
        problems += [f"{r['path']}: {r['state']}" for r in drift(was, found).orderBy("path").collect()]
    frozen = registry.get("config")
    if frozen and (config is None or subtree_digest(config, frozen["keys"]) != frozen["sha256"]):
        problems.append("config: changed")
    return problems


def still_missing(registry: dict) -> list[str]:
    return sorted(n for n, d in registry["files"].items() if d is None)


def self_digest(manifest: dict, field: str = "sha256") -> str:
    """SHA-256 of the manifest's canonical JSON without its own digest."""
    return hashlib.sha256(canonical({k: v for k, v in manifest.items() if k != field}).encode()).hexdigest()


def manifest_drift(built: dict, frozen: dict, fields: list[str]) -> list[str]:
    """The fields that differ."""
    return [f for f in fields if built.get(f) != frozen.get(f)]
