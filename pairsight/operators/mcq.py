"""Multiple-choice items from extractive question answering: distractors, windows, diagnostics, gates.

A context stands once, with its questions beside it: no shuffle repeats its text for each of
them, and no pairs of questions are made. Where each candidate stands is found once for the
context; a question looks at its nearest ones on either side. That, and the token window around
four options, runs in one pandas function by context; everything before and after is DataFrame
operations.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsight.errors import ContractError
from pairsight.functions.seeds import seed_of
from pairsight.functions.text import MAX_OCCURRENCES, digit_class, length_bucket, without_suffix

OPTIONS = 4
SLACK = 8
TRIES = 8
#: Items that a worker holds before it hands them on.
HELD = 500
ITEM = "item_id string, lang string, partition string, group_id string, passage string, question string, gold_text string, options array<string>, gold int, distractor_item_ids array<string>, prompt_tokens int, context_tokens int, covering_span_tokens int, overflowed_budget boolean, answer_in_passage boolean, n_options_in_passage int, reason string"

Span = tuple[int, int]


def source_rows(raw: DataFrame) -> DataFrame:
    """Normalised rows with a drop reason (null: kept): required fields after trimming, the answer's place in the trimmed context."""
    context, lead = F.ltrim("context"), F.length("context") - F.length(F.ltrim("context"))
    answer = F.get(F.col("answers.text"), 0)
    start = F.get(F.col("answers.answer_start"), 0)
    at = start - lead
    there = (at >= 0) & (F.substring(context, at + 1, F.length(F.trim(answer))) == F.trim(answer))
    found = F.when(there, at).otherwise(F.instr(context, F.trim(answer)) - 1)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(blank(F.col("title")) | blank(F.col("context")) | blank(F.col("question")) | blank(answer), "missing field").when(found < 0, "answer not in context")
    return raw.select(
        F.trim("title").alias("group_id"), F.rtrim(context).alias("context"), F.trim("question").alias("question"), F.trim(answer).alias("answer"), F.col("id").alias("source_id"), F.when(found >= 0, found).cast("int").alias("answer_start"), reason.alias("reason")
    )


def drop_report(rows: DataFrame, ceiling: float = 0.02) -> DataFrame:
    """reason, n, share, within: dropped rows by reason against all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("reason", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") / F.col("total") <= ceiling).alias("within"))


def contexts(rows: DataFrame) -> DataFrame:
    """group_id, context, asked (item_id, question, answer, answer_start): each context of a group once, with all its questions."""
    digest = F.sha2("context", 256)
    asked = rows.select("group_id", digest.alias("digest"), F.struct("item_id", "question", "answer", "answer_start").alias("q")).groupBy("group_id", "digest").agg(F.collect_list("q").alias("asked"))
    # different keys are all that this aggregation holds, so texts are not shuffled once for each question
    texts = rows.select("group_id", "context").distinct().withColumn("digest", digest)
    a, b = texts.alias("a"), asked.alias("b")
    return a.join(b, F.col("a.group_id").eqNullSafe(F.col("b.group_id")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))).select("a.group_id", "context", "asked")


def places(text: str, part: str, limit: int = MAX_OCCURRENCES) -> list[Span]:
    """The first occurrences, overlapping ones too."""
    out, at = [], text.find(part) if part else -1
    while at >= 0 and len(out) < limit:
        out.append((at, at + len(part)))
        at = text.find(part, at + 1)
    return out


class Candidates:
    """A context's answers, distinct when folded (of equal ones that with the least item_id), and where they stand."""

    def __init__(self, text: str, asked: list[dict]):
        self.best: dict[str, tuple] = {}
        for q in asked:
            if q["item_id"] is not None and q["answer"] is not None:
                folded, mine = folded_answer(q["answer"]), (q["item_id"], q["answer"], (q["digits"], q["words"]))
                if folded not in self.best or mine[:2] < self.best[folded][:2]:
                    self.best[folded] = mine
        sides: dict[tuple | None, list] = {None: []}
        for folded, (_, answer, kind) in self.best.items():
            there = [(*span, folded) for span in places(text, answer)]
            sides[None] += there
            sides.setdefault(kind, []).extend(there)
        #: By surface class, and under None all: spans in order of their starts, in order of their ends, and those starts and ends.
        self.spans = {}
        for kind, found in sides.items():
            by_start, by_end = sorted(found), sorted(found, key=lambda s: (s[1], s[0]))
            self.spans[kind] = by_start, by_end, [s[0] for s in by_start], [s[1] for s in by_end]

    def nearest(self, gold: Span, own: str, kind: tuple, side: str, k: int, alike: bool) -> list[dict]:
        """The k nearest candidates other than ``own`` on one side of the answer, by distance, then surface, then text; each with its nearest place there. ``alike``: of the surface class ``kind`` alone."""
        by_start, by_end, starts, ends = self.spans.get(kind if alike else None, ([], [], [], []))
        if side == "left":
            walk = (by_start[x] for x in range(bisect_left(starts, gold[0]) - 1, -1, -1))
        else:
            walk = (by_end[x] for x in range(bisect_right(ends, gold[1]), len(by_end)))
        found, seen = [], {own}
        for low, high, folded in walk:
            if folded in seen or (high > gold[0] if side == "left" else low < gold[1]):
                continue
            gap = gold[0] - low if side == "left" else high - gold[1]
            if len(found) >= k and gap > found[k - 1][0]:
                break  # beyond equal distances nothing comes before those found
            seen.add(folded)
            item_id, answer, its_kind = self.best[folded]
            found.append((gap, int(its_kind != kind), answer, item_id, (low, high)))
        return [{"gap": g, "text": t, "id": i, "span": s} for g, _, t, i, s in sorted(found)[:k]]


def folded_answer(text: str) -> str:
    """What ``fold_exact`` gives."""
    return " ".join(text.split()).casefold()


def choose(left: list[dict], right: list[dict], gold: Span, k: int = OPTIONS - 1) -> tuple[list[dict], Span] | None:
    """k distractors of the nearest on each side (k of each at least) whose span with the answer is narrowest over all splits between left and right; the first of equal ones."""
    best = None
    for n_left in range(k + 1):
        chosen = left[:n_left]
        used = {c["text"] for c in chosen}
        chosen = chosen + [c for c in right if c["text"] not in used][: k - n_left]
        if len(chosen) < k:
            continue
        lo, hi = min([gold[0], *(c["span"][0] for c in chosen)]), max([gold[1], *(c["span"][1] for c in chosen)])
        if best is None or hi - lo < best[1][1] - best[1][0]:
            best = chosen, (lo, hi)
    return best


def whitespace_tokens(text: str) -> list[Span]:
    """The stand-in tokenizer: one token for each run of other than white space."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def trimmed(text: str, lo: int, hi: int, keep: Span) -> Span:
    """Edges moved inward to white space, never into ``keep``, and off blanks."""
    if lo and not text[lo - 1].isspace():
        inner = next((k for k in range(lo, keep[0]) if text[k].isspace()), keep[0])
        lo = inner
    if hi < len(text) and not text[hi].isspace():
        inner = next((k for k in range(hi - 1, keep[1] - 1, -1) if text[k].isspace()), keep[1])
        hi = inner
    while lo < keep[0] and text[lo].isspace():
        lo += 1
    while hi > keep[1] and text[hi - 1].isspace():
        hi -= 1
    return lo, hi


class Tokens:
    """The tokens' spans of a text, and which of them a stretch touches."""

    def __init__(self, spans: list[Span]):
        self.spans = spans
        self.ordered = all(a[0] <= b[0] and a[1] <= b[1] for a, b in pairwise(spans))
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def inside(self, lo: int, hi: int) -> tuple[int, int, int]:
        """(first, end, how many)."""
        if self.ordered:
            first, end = bisect_right(self.ends, lo), bisect_left(self.starts, hi)
            return first, end, max(0, end - first)
        found = [k for k, (a, b) in enumerate(self.spans) if b > lo and a < hi]
        return (found[0], found[-1] + 1, len(found)) if found else (0, 0, 0)


def window(text: str, required: list[Span], budget: int, tokens: Tokens) -> tuple[str, int]:
    """(passage of at most ``budget`` tokens around all required spans, tokens that they need); the whole span where it needs more."""
    spans = tokens.spans
    need = min(a for a, _ in required), max(b for _, b in required)
    first, last, n = tokens.inside(*need)
    if len(spans) <= budget or not n:
        return text.strip(), n
    spare = max(0, budget - (last - first))
    lead = min(first, spare // 2)
    trail = min(len(spans) - last, spare - lead)
    lead = min(first, spare - trail)
    lo, hi = trimmed(text, min(spans[first - lead][0], need[0]), max(spans[last + trail - 1][1], need[1]), need)
    return text[lo:hi], last - first


def fitted(text: str, required: list[Span], budget: int, frame: int, tokens: Callable[[str], list[Span]], whole: Tokens) -> dict:
    """The window that fits with ``frame`` tokens around it: shrunk by what it is over plus SLACK, TRIES times at most. ``whole``: the text's tokens."""
    room = budget - frame
    for _ in range(TRIES):
        passage, need = window(text, required, max(room, 1), whole)
        size = len(tokens(passage))
        if size + frame <= budget or size <= need:
            break
        room -= size + frame - budget + SLACK
    return {"passage": passage, "context_tokens": size, "prompt_tokens": size + frame, "covering_span_tokens": need, "overflowed_budget": size + frame > budget}


def build_items(rows: DataFrame, lang: str, partition: str, seed: object, budget: int = 512, tokens: Callable[[str], list[Span]] = whitespace_tokens) -> DataFrame:
    """ITEM columns; ``reason`` tells why a question gives no item (the other columns are then null). rows: item_id, group_id, context, question, answer, answer_start; item_id is their key.

    Distractors of the gold answer's surface class come first; other classes only where
    those can't make four options within the budget.
    """
    return items_of(contexts(rows), lang, partition, seed, budget, tokens)


def items_of(held: DataFrame, lang: str, partition: str, seed: object, budget: int = 512, tokens: Callable[[str], list[Span]] = whitespace_tokens, carry: list[str] | None = None) -> DataFrame:
    """``build_items`` of contexts that have their questions beside them (the columns of ``contexts``); no shuffle. carry: columns of a context that its items get too."""
    carried = carry or []
    classed = F.transform("asked", lambda q: F.struct(q["item_id"].alias("item_id"), q["question"].alias("question"), q["answer"].alias("answer"), q["answer_start"].alias("answer_start"), digit_class(q["answer"]).alias("digits"), length_bucket(q["answer"]).alias("words")))
    given = held.where(F.size("asked") > 0).select("group_id", "context", classed.alias("asked"), *carried)
    names = [*(x.split()[0] for x in ITEM.split(", ")), *carried]
    schema = ", ".join([ITEM, *(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in carried)])

    def of_context(row: dict) -> Iterator[dict]:
        text, asked = row["context"], list(row["asked"])
        keyed = row["group_id"] is not None and text is not None
        others = Candidates(text, asked) if keyed and len(asked) >= OPTIONS else None
        whole = None
        for q in asked:
            out = {"item_id": q["item_id"], "lang": lang, "partition": partition, "group_id": row["group_id"], **{c: row[c] for c in carried}}
            if others is None or q["item_id"] is None or q["answer"] is None or q["answer_start"] is None:
                yield out | {"reason": "too few distractors"}
                continue
            gold, own, kind = (q["answer_start"], q["answer_start"] + len(q["answer"])), folded_answer(q["answer"]), (q["digits"], q["words"])
            left, right = (others.nearest(gold, own, kind, side, OPTIONS - 1, False) for side in ("left", "right"))
            if len({c["text"] for c in left + right}) < OPTIONS - 1:
                yield out | {"reason": "too few distractors"}
                continue
            frame = sum(len(tokens(x)) for x in (q["question"], q["answer"]))
            made = None
            for alike in (True, False):
                chosen = choose(*((others.nearest(gold, own, kind, side, OPTIONS - 1, True) for side in ("left", "right")) if alike else (left, right)), gold)
                if chosen is None:
                    continue
                taken, _ = chosen
                whole = whole or Tokens(tokens(text))
                made = fitted(text, [gold, *(c["span"] for c in taken)], budget, frame + sum(len(tokens(c["text"])) for c in taken), tokens, whole)
                if not made["overflowed_budget"]:
                    break
            if made is None or chosen is None:
                yield out | {"reason": "no covering span"}
                continue
            slot = seed_of(seed, lang, "gold", q["item_id"]) % OPTIONS
            options = [c["text"] for c in taken]
            options.insert(slot, q["answer"])
            yield out | made | {"question": q["question"], "gold_text": q["answer"], "options": options, "gold": slot + 1, "distractor_item_ids": [c["id"] for c in taken], "answer_in_passage": q["answer"] in made["passage"], "n_options_in_passage": sum(o in made["passage"] for o in options)}

    def framed(items: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(items, columns=names).astype(object).where(lambda d: d.notna(), None)

    def work(frames):
        items = []
        for frame in frames:
            for row in frame.to_dict("records"):
                for item in of_context(row):
                    items.append(item)
                    if len(items) == HELD:
                        yield framed(items)
                        items = []
        yield framed(items)

    return given.mapInPandas(work, schema)


def malformed(items: DataFrame) -> DataFrame:
    """item_id, rule: items that break a rule of form."""
    folded = F.transform("options", lambda o: F.lower(F.trim(F.regexp_replace(o, r"\s+", " "))))
    own = F.forall("distractor_item_ids", lambda d: without_suffix(d) == without_suffix(F.col("item_id")))
    rules = {
        "four options": F.size("options") != OPTIONS,
        "options differ": F.size(F.array_distinct(folded)) != F.size("options"),
        "gold in range": ~F.col("gold").between(1, OPTIONS),
        "gold text matches": ~F.coalesce(F.get("options", F.col("gold") - 1) == F.col("gold_text"), F.lit(False)),
        "one option is right": F.size(F.filter("options", lambda o: o == F.col("gold_text"))) != 1,
        "distractors of the article": ~own,
        "no distractor of itself": F.array_contains("distractor_item_ids", F.col("item_id")),
        "options in passage": ~F.forall("options", lambda o: F.col("passage").contains(o)),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return items.where("reason is null").select("item_id", F.explode(broken).alias("rule"))


def gold_rank(options: Column, passage: Column, gold: Column) -> Column:
    """The place of the gold option among the options by where they first stand in the passage."""
    order = F.array_sort(F.transform(options, lambda o, k: F.struct(F.instr(passage, o).alias("at"), (k + 1).alias("k"))))
    return F.array_position(F.transform(order, lambda x: x["k"]), gold).cast("int")


def present_share(options: Column, passage: Column, gold_text: Column) -> Column:
    """What picking an option that stands in the passage is right on average."""
    there = F.filter(options, lambda o: passage.contains(o))
    return F.when(F.size(there) == 0, F.lit(1.0) / F.size(options)).otherwise(F.when(F.array_contains(there, gold_text), F.lit(1.0) / F.size(there)).otherwise(0.0))


def diagnostics(items: DataFrame, by: list[str], n_source: Column | None = None) -> DataFrame:
    """by..., measures of how items are built: sizes, shortcut, surface, letters, ranks, windows, drop rates."""
    kept = F.col("reason").isNull()
    surface = F.forall("options", lambda o: (digit_class(o) == digit_class(F.col("gold_text"))) & (length_bucket(o) == length_bucket(F.col("gold_text"))))
    own = F.forall("distractor_item_ids", lambda d: without_suffix(d) == without_suffix(F.col("item_id")))
    others = F.filter("options", lambda o: o != F.col("gold_text"))
    other_share = F.size(F.filter(others, lambda o: F.col("passage").contains(o))) / F.greatest(F.size(others), F.lit(1))
    rank = gold_rank(F.col("options"), F.col("passage"), F.col("gold"))
    tokens = F.sort_array(F.collect_list(F.when(kept, F.col("context_tokens"))))
    from pairsight.functions.stats import floor_quantile

    n = F.count_if(kept)
    share = lambda c: F.count_if(kept & c) / F.when(n > 0, n)
    flat = items.withColumns({"_rank": rank, "_surface": surface, "_own": own, "_other": other_share, "_short": present_share(F.col("options"), F.col("passage"), F.col("gold_text"))})
    sums = flat.groupBy(*by).agg(
        n.alias("n_items"),
        F.count_if(~kept).alias("n_dropped"),
        (F.count_if(~kept) / F.count("*")).alias("drop_rate_partition"),
        F.avg(F.when(kept, F.col("_short"))).alias("shortcut_accuracy"),
        share(F.col("_surface")).alias("surface_homogeneity"),
        share(F.col("_own")).alias("same_article_share"),
        (share(F.col("answer_in_passage")) - F.avg(F.when(kept, F.col("_other")))).alias("presence_gap"),
        *(share(F.col("gold") == k).alias(f"gold_letter_{k}") for k in range(1, 5)),
        *(share(F.col("_rank") == k).alias(f"gold_rank_{k}") for k in range(1, 5)),
        F.collect_set(F.when(kept, F.size("options"))).alias("option_counts"),
        share(F.col("overflowed_budget")).alias("overflow_share"),
        floor_quantile(tokens, 0.5).alias("context_tokens_p50"),
        floor_quantile(tokens, 0.9).alias("context_tokens_p90"),
        F.max(F.when(kept, F.col("context_tokens"))).alias("context_tokens_max"),
        F.max(F.when(kept, F.col("covering_span_tokens"))).alias("covering_span_max"),
        F.avg(F.when(kept, F.col("n_options_in_passage"))).alias("mean_options_in_passage"),
    )
    sums = sums.withColumns({"max_letter_share": F.greatest(*(F.col(f"gold_letter_{k}") for k in range(1, 5))), "max_rank_share": F.greatest(*(F.col(f"gold_rank_{k}") for k in range(1, 5)))})
    return sums if n_source is None else sums.withColumn("drop_rate", F.col("n_dropped") / n_source)


def gates(measured: DataFrame, by: list[str]) -> DataFrame:
    """by..., gate, passes: what a build must satisfy (V22, C11's shortcut part)."""
    rules = {
        "shortcut": F.col("shortcut_accuracy") <= 0.30,
        "presence gap": F.abs("presence_gap") <= 0.01,
        "same article": F.col("same_article_share") == 1,
        "letters": F.col("max_letter_share") <= 0.40,
        "ranks": F.col("max_rank_share") <= 0.40,
        "options": F.array_sort("option_counts") == F.array(F.lit(OPTIONS)),
    }
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("gate"), F.coalesce(c, F.lit(False)).alias("passes")) for name, c in rules.items()))).alias("x")
    return measured.select(*by, each).select(*by, "x.*")


def require(gated: DataFrame) -> None:
    broken = [f"{r['gate']}" for r in gated.where("not passes").collect()]
    if broken:
        raise ContractError("V22 construction", ", ".join(sorted(set(broken))))


IGNORED = -100


def training_examples(items: DataFrame, encoded: Column, option_ids: list[int], most: int) -> DataFrame:
    """item_id, input_ids, labels, label_id: the prompt's last ``most`` - 1 tokens, then the gold option's, which alone is learned from (F17). A gold outside the options is fatal."""
    label = F.get(F.array(*map(F.lit, option_ids)), F.col("gold") - 1)
    label = F.when(label.isNull(), F.raise_error(F.concat(F.lit("F17 gold: "), F.col("item_id")))).otherwise(label)
    kept = F.when(F.size(encoded) > most - 1, F.slice(encoded, F.size(encoded) - (most - 2), F.lit(most - 1))).otherwise(encoded)
    return items.select("item_id", kept.alias("_ids"), label.alias("label_id")).select("item_id", F.concat("_ids", F.array("label_id")).alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORED), F.size("_ids")), F.array("label_id")).alias("labels"), "label_id")


def burden(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """by..., median (whole), mean (one digit), max of token counts."""
    return rows.groupBy(*by).agg(F.median(size).cast("int").alias("median_tokens"), F.round(F.avg(size), 1).alias("mean_tokens"), F.max(size).alias("max_tokens"))


def learnability(sampled: DataFrame, ceiling: float) -> DataFrame:
    """n, correct, accuracy, ci_low, fires: whether the lower bound is above what the base model may reach already (C11)."""
    from pairsight.functions.stats import wilson

    sums = sampled.agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("correct"))
    low, _ = wilson(F.col("correct"), F.col("n"))
    return sums.select("n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"), low.alias("ci_low"), (low > ceiling).alias("fires"))
