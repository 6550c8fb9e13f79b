"""Text functions: built-ins where they can say it, pandas functions where exactness needs Python's rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the word-count buckets, and the most occurrences looked at.
LENGTH_BOUNDS = (1, 3, 7)
MAX_OCCURRENCES = 8


def fold(text: Column) -> Column:
    """White space runs to one blank, trimmed, lower case; close to ``fold_exact`` and in generated code."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


@F.pandas_udf(T.StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """White space as Python splits it, full case folding."""
    return text.map(lambda t: None if t is None else " ".join(t.split()).casefold())


def digit_class(text: Column) -> Column:
    """text, mixed or numeric: no digits, some, or more than half of the characters that are not white space."""
    body = F.regexp_replace(text, r"(?U)\s+", "")
    digits = F.regexp_count(body, F.lit(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]")).cast("long")
    size = F.length(body)
    return F.when(digits == 0, "text").when(digits * 2 > size, "numeric").otherwise("mixed")


def word_count(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(clean) == 0, F.lit(0)).otherwise(F.size(F.split(clean, " ")))


def length_bucket(text: Column, bounds: tuple[int, ...] = LENGTH_BOUNDS) -> Column:
    """How many of the bounds the number of words exceeds."""
    words = word_count(text)
    total = F.lit(0)
    for bound in bounds:
        total = total + (words > bound).cast("int")
    return total


def surface_key(text: Column, bounds: tuple[int, ...] = LENGTH_BOUNDS) -> Column:
    return F.struct(digit_class(text).alias("digits"), length_bucket(text, bounds).alias("words"))


def occurrences(hay: Column, needle: Column, limit: int = MAX_OCCURRENCES) -> Column:
    """Starts (from 1) of the first occurrences, overlapping ones too."""
    places = F.filter(F.sequence(F.lit(1), F.length(hay) - F.length(needle) + 1), lambda i: F.substring(hay, i, F.length(needle)) == needle)
    fits = (F.length(needle) > 0) & (F.length(hay) >= F.length(needle))
    return F.when(fits, F.slice(places, 1, limit)).otherwise(F.array().cast("array<int>"))


def sentences(text: Column, least: int = 40) -> Column:
    """Split after ., ! or ? and white space; pieces of ``least`` characters or more."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) >= least)


def without_suffix(item_id: Column) -> Column:
    """What stands before the last ``#``."""
    return F.regexp_replace(item_id, "#[^#]*$", "")


def composite_key(*parts: Column, sep: str = "#") -> Column:
    """Joined parts; null if any part is null (concat_ws would skip it)."""
    key = parts[0].cast("string")
    for part in parts[1:]:
        key = F.concat(key, F.lit(sep), part.cast("string"))
    return key


def stripped(value: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(value, r"^[\s\h\v\x1c-\x1f\x85]+|[\s\h\v\x1c-\x1f\x85]+$", "")


def prompt(parts: dict[str, Column], layout: list[str]) -> Column:
    """Lines of fixed text and of trimmed parts (``{name}``), without a line end at the end."""
    out = []
    for line in layout:
        pieces = [stripped(parts[p[1:-1]]) if p.startswith("{") else F.lit(p) for p in line.split("|")]
        out.append(F.concat(*pieces))
    return F.concat_ws("\n", *out)


def commit_sha(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{40}$")


def alias_of(model: Column, lang: Column, epochs: Column) -> Column:
    """model-ft-lang, or model-ft3ep-lang beyond one epoch; ``__`` parts the fields of file names, so an alias that holds it is fatal."""
    alias = F.concat(model, F.when(epochs > 1, F.concat(F.lit("-ft"), epochs.cast("string"), F.lit("ep-"))).otherwise("-ft-"), lang)
    return F.when(alias.contains("__"), F.raise_error(F.concat(F.lit("P12 alias: holds __: "), alias))).otherwise(alias)


def truncated(n_tokens: Column, most: int) -> Column:
    """Whether a prompt filled the window, and so may have lost its beginning (P10)."""
    return n_tokens >= most


def timestamp(value: Column) -> Column:
    """An ISO timestamp as a point in time; null where it is none."""
    return F.try_to_timestamp(value)


def alias_parts(alias: Column) -> Column:
    """struct(model, arm, epochs, lang) of an alias; arm base without the marker."""
    pattern = r"^(.*)-ft(?:(\d+)ep)?-(.*)$"
    tuned = alias.rlike(pattern)
    epochs = F.regexp_extract(alias, pattern, 2)
    return F.struct(
        F.when(tuned, F.regexp_extract(alias, pattern, 1)).otherwise(alias).alias("model"),
        F.when(tuned, "ft").otherwise("base").alias("arm"),
        F.when(tuned, F.when(epochs == "", 1).otherwise(F.try_to_number(epochs, F.lit("9999")).cast("int"))).alias("epochs"),
        F.when(tuned, F.regexp_extract(alias, pattern, 3)).alias("lang"),
    )
