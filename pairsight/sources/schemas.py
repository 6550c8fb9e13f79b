"""Explicit schemas of what is read, as DDL (readers take it, and it needs no session): nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = (
    "run_id string, model string, model_alias string, model_revision string, weights_from string, arm string, precision string, lang string, item_id string, "
    "pred int, gold int, correct int, letter_logits array<double>, latency_ms double, input_tokens int, truncated boolean, prompt_sha256 string, prompt string"
)
META = (
    "run_id string, model string, model_alias string, model_revision string, weights_from string, arm string, precision string, lang string, tag string, n_items int, n_correct int, n_truncated int, "
    "warmup int, repeats int, accuracy double, median_latency_ms double, mean_latency_ms double, p25_latency_ms double, p75_latency_ms double, median_input_tokens double, total_wall_seconds double, "
    "load_seconds double, peak_memory_allocated_gb double, peak_memory_reserved_gb double, quantized_layer_counts map<string,int>, option_token_ids array<int>, limit int, timestamp_utc string, env map<string,string>"
)
TIDY = T.StructType([T.StructField(c, T.StringType(), False) for c in ("model", "model_revision", "precision", "lang", "item_id")] + [T.StructField(c, T.IntegerType(), False) for c in ("pred", "gold", "correct")])
QA_ROW = ("title string, id string, context string, question string, answers struct<text:array<string>, answer_start:array<int>>")
ACCURACY = ("model string, lang string, precision string, n long, correct long, accuracy double, ci95_low double, ci95_high double")
