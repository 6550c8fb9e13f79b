"""Configuration trees: null means not known yet, and is fatal where a value is required.

Rules are a table of (what is wrong, whether it is); each looks at the tree alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any

from pairsight.errors import ContractError
from pairsight.functions.stats import PRECISIONS

Tree = dict[str, Any]
#: The closed domains of the tree.
SCORING = ("letter_logit", "option_loglik")
DISTRACTORS = ("same_article", "other_article")
WINDOWS = ("span_covering_tokens", "answer_centred_tokens")


def fail(detail: str) -> None:
    raise ContractError("S10 config", detail)


def load(path: str) -> Tree:
    """The tree of a YAML or JSON file, validated; a missing file is fatal."""
    if not os.path.exists(path):
        fail(f"{path} is not there")
    with open(path, encoding="utf-8") as lines:
        if path.endswith(".json"):
            tree = json.load(lines)
        else:
            try:
                import yaml
            except ImportError:
                raise ContractError("S10 config", "YAML can't be read here; give JSON") from None
            tree = yaml.safe_load(lines)
    validate(tree)
    return tree


def require(config: Tree, dotted: str) -> Any:
    """The value at a dotted path; missing and null are fatal."""
    at: Any = config
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            fail(f"{dotted} is missing")
        at = at[part]
    if at is None:
        fail(f"{dotted} is not known yet")
    return at


def get(config: Tree, dotted: str, default: Any = None) -> Any:
    """The value at a path that may be missing or null; for rules alone."""
    at: Any = config
    for part in dotted.split("."):
        at = at.get(part) if isinstance(at, dict) else None
    return default if at is None else at


def whole(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


STATIC: list[tuple[str, Callable[[Tree], bool]]] = [
    ("an unknown precision", lambda c: not set(get(c, "precisions", [])) <= set(PRECISIONS)),
    ("an unknown scoring method", lambda c: get(c, "scoring.method") not in SCORING),
    ("the reference language is none of the languages", lambda c: get(c, "benchmark.reference_language") not in get(c, "benchmark.languages", [])),
    ("a language twice", lambda c: len(set(get(c, "benchmark.languages", []))) != len(get(c, "benchmark.languages", []))),
    ("a model without alias or hf_id", lambda c: any(not {"alias", "hf_id"} <= set(m) for m in get(c, "models", []))),
    ("an alias that holds __", lambda c: any("__" in str(m.get("alias")) for m in get(c, "models", []))),
]

#: Of the tree's ``finetune``, with the languages of the benchmark beside it.
TUNING: list[tuple[str, Callable[[Tree], bool]]] = [
    ("lang_configs do not cover the languages", lambda c: set(get(c, "finetune.lang_configs", {})) != set(get(c, "benchmark.languages", []))),
    ("two languages of one dataset config", lambda c: len(set(get(c, "finetune.lang_configs", {}).values())) != len(get(c, "finetune.lang_configs", {}))),
    ("train_fraction outside (0, 1)", lambda c: not (isinstance(get(c, "finetune.train_fraction"), (int, float)) and 0 < get(c, "finetune.train_fraction") < 1)),
    ("no group_key", lambda c: not get(c, "finetune.group_key")),
    ("n_options is not the number of option letters", lambda c: get(c, "finetune.n_options") != len(get(c, "scoring.option_letters", []))),
    ("heldout_eval_cap is no positive whole number", lambda c: not (whole(get(c, "finetune.heldout_eval_cap")) and get(c, "finetune.heldout_eval_cap") > 0)),
    ("training at another precision than fp16", lambda c: get(c, "finetune.train_precision") != "fp16"),
    ("a seed that is no whole number", lambda c: not all(whole(get(c, f"finetune.seeds.{k}")) for k in ("main", "sensitivity"))),
    ("one seed for main and sensitivity", lambda c: get(c, "finetune.seeds.main") == get(c, "finetune.seeds.sensitivity")),
    ("an unknown sensitivity language", lambda c: not set(get(c, "finetune.seeds.sensitivity_languages", [])) <= set(get(c, "benchmark.languages", []))),
    ("split_seed is no whole number", lambda c: not whole(get(c, "finetune.split_seed"))),
    ("no final_scope_languages", lambda c: not get(c, "finetune.final_scope_languages")),
    ("an unknown final_scope language", lambda c: not set(get(c, "finetune.final_scope_languages", [])) <= set(get(c, "benchmark.languages", []))),
    ("an unknown source of distractors", lambda c: get(c, "finetune.distractors.source") not in DISTRACTORS),
    ("distractors of the same article that exclude it", lambda c: get(c, "finetune.distractors.source") == "same_article" and bool(get(c, "finetune.distractors.exclude_same_article"))),
    ("an unknown window policy", lambda c: get(c, "finetune.context_window.policy") not in WINDOWS),
    ("distractors and window that do not go together", lambda c: (get(c, "finetune.distractors.source") == "same_article") != (get(c, "finetune.context_window.policy") == "span_covering_tokens")),
    ("max_seq_tokens is no positive whole number", lambda c: not (whole(get(c, "finetune.training.max_seq_tokens")) and get(c, "finetune.training.max_seq_tokens") > 0)),
    ("training on longer inputs than are scored", lambda c: get(c, "scoring.max_input_tokens") is not None and get(c, "finetune.training.max_seq_tokens") > get(c, "scoring.max_input_tokens")),
]


def broken(config: Tree) -> list[str]:
    """Every static rule that the tree breaks up to the first that later ones build on."""
    for wrong, is_wrong in [*STATIC, *(TUNING if get(config, "finetune") is not None else [])]:
        if is_wrong(config):
            return [wrong]
    return []


def validate(config: Tree) -> None:
    """Fatal on the first static rule that the tree breaks."""
    for wrong in broken(config):
        fail(wrong)
