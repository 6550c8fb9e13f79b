"""Toxicity: a lexicon learned from labelled rows, misspellings by Levenshtein automata, context windows.

Learning. From labelled rows whose crc32(doc_id as text) modulo 5 is not 0, at most
``SAMPLE`` of them by hash order, terms (whole words and leading stems) are taken into the
lexicon when they are in toxic texts far more often than chance allows at the number of
terms tried (a binomial bound). The terms form one trie. The Levenshtein automaton of
distance 1 is intersected with the trie and made deterministic as words are read, so a
word is classed in one pass: none, exact or misspelt.

Scoring. Each hit is looked at in a window of words: inside quotation marks or beside a
word of reporting it counts as quoted. A logistic model, fitted on the same sample, gives
the score from the counts of direct, misspelt and quoted hits. Labels, language, source
and doc_id are no inputs of a score.

Defined results: null text is empty, and empty texts get the score of a text without
hits; several labels of one doc_id count as toxic if any is; without labelled rows of
both classes the lexicon is empty and every score is the share of toxic labels (one half
without any); rows that repeat a doc_id are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.llm.common import chunks, frugal, texts

#: The most labelled rows that are learned from.
SAMPLE = 8000
#: The most terms in the lexicon, the strongest first.
TERMS = 2000
CHUNK = 4 << 20
STEMS = range(4, 8)
FUZZY_FROM = 5
WINDOW = 3
LEAST_TOXIC = 4
EDGE = re.compile(r"^\W+|\W+$")
#: Words beside which a term is quoted, and quotation marks.
REPORTING = frozenset("said says wrote writes called calls quoted quotes quote reported reports word term".split())
OPENING, CLOSING = "\"'“‘«„(", "\"'”’»“)"
NONE, EXACT, MISSPELT = 0, 1, 2


def plain(word: str) -> str:
    return EDGE.sub("", word)


class Lexicon:
    """A trie of terms (a trailing ``*`` marks a stem) intersected with the automaton of distance 1."""

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[int] = [NONE]  # what a word that ends here may be: EXACT, and if long enough MISSPELT
        self.stem: list[int] = [NONE]
        for term in terms:
            node = 0
            letters = term.rstrip("*")
            for letter in letters:
                if letter not in self.child[node]:
                    self.child[node][letter] = len(self.child)
                    self.child.append({})
                    self.word.append(NONE)
                    self.stem.append(NONE)
                node = self.child[node][letter]
            grade = MISSPELT if len(letters) >= FUZZY_FROM else EXACT
            kind = self.stem if term.endswith("*") else self.word
            kind[node] = max(kind[node], grade)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.found: list[tuple[bool, bool, bool, bool]] = []  # ends: word exact, word misspelt, stem exact, stem misspelt
        self.next: list[dict[str, int]] = []
        self.start = self.state(frozenset([(0, 0)]))

    def state(self, places: frozenset) -> int:
        if places not in self.states:
            # a letter of the term left out costs one edit
            closed = set(places)
            for node, edits in places:
                if not edits:
                    closed |= {(to, 1) for to in self.child[node].values()}
            zero = [n for n, e in closed if not e]
            one = [n for n, e in closed if e]
            self.states[places] = len(self.sets)
            self.sets.append(frozenset(places))
            self.found.append((any(self.word[n] for n in zero), any(self.word[n] == MISSPELT for n in one), any(self.stem[n] for n in zero), any(self.stem[n] == MISSPELT for n in one)))
            self.next.append({})
        return self.states[places]

    def after(self, at: int, letter: str) -> int:
        to = self.next[at].get(letter)
        if to is None:
            places: set[tuple[int, int]] = set()
            for node, edits in self.sets[at]:
                children = self.child[node]
                if letter in children:
                    places.add((children[letter], edits))
                if not edits:
                    places.add((node, 1))  # a letter too many
                    for child in children.values():
                        places.add((child, 1))  # another letter
                        if letter in self.child[child]:
                            places.add((self.child[child][letter], 1))  # a letter left out
            exact = {n for n, e in places if not e}
            to = self.next[at][letter] = self.state(frozenset((n, e) for n, e in places if not e or n not in exact)) if places else -1
        return to

    def grade(self, word: str) -> int:
        at, near = self.start, NONE
        for letter in word:
            at = self.after(at, letter)
            if at < 0:
                return near
            _, _, stem, stem_near = self.found[at]
            if stem:
                return EXACT
            if stem_near:
                near = MISSPELT
        exact, misspelt, _, _ = self.found[at]
        return EXACT if exact else MISSPELT if misspelt else near


def quoted(words: list[str], at: int) -> bool:
    """Whether the word is between quotation marks, or beside a word of reporting, within the window."""
    lo, hi = max(0, at - WINDOW), min(len(words), at + WINDOW + 1)
    opens = any(words[k][:1] in OPENING for k in range(lo, at + 1))
    closes = any(words[k].rstrip(".,;:!?")[-1:] in CLOSING for k in range(at, hi) if words[k].rstrip(".,;:!?"))
    return (opens and closes) or any(plain(w) in REPORTING for w in words[lo:at])


class Reader:
    """Counts hits text by text; the grades of words are kept from one text to the next within a chunk."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.grades: dict[str, int] = {}
        self.hits: set[str] = set()

    def counts(self, text: str) -> tuple[int, int, int]:
        """(direct, misspelt, quoted) hits."""
        words = text.lower().split()
        fresh = set(words).difference(self.grades)
        for word in fresh:
            grade = self.grades[word] = self.lexicon.grade(plain(word))
            if grade:
                self.hits.add(word)
        if self.hits.isdisjoint(words):
            return 0, 0, 0
        got = [0, 0, 0]
        for at, word in enumerate(words):
            if word in self.hits:
                got[2 if quoted(words, at) else 0 if self.grades[word] == EXACT else 1] += 1
        return got[0], got[1], got[2]


def features(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(counts), 1)), np.log1p(counts), counts > 0], axis=1)


def fit(counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    x, w = features(counts), np.zeros(7)
    ridge = np.diag([1e-6] + [0.5] * 6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (toxic - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def terms_of(text: str) -> set[str]:
    words = {plain(w) for w in set(text.lower().split())}
    return {w for w in words if 3 <= len(w) <= 24} | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Counter(), Counter()
    for batch in batches:
        for body, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            seen[1 if toxic else 0].update(terms_of(body.decode("utf-8", "replace")))
    names = list(seen[0].keys() | seen[1].keys())
    for k in range(0, len(names), 50_000):
        part = names[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][x] for x in part], pa.int64()), pa.array([seen[0][x] for x in part], pa.int64())], names=["term", "toxic", "clean"])


def divergence(t: int, n: int, base: float) -> float:
    """n times the divergence of the share t/n from the base rate."""
    q = t / n
    return t * math.log(q / base) + ((n - t) * math.log((1 - q) / (1 - base)) if t < n else 0.0)


def choose_terms(found: list[tuple[str, int, int]], tried: int, base: float) -> list[str]:
    """Terms beyond chance; of stems and words that begin with a chosen stem, only the stem."""
    need = math.log(max(tried, 1)) + 1
    good = sorted(((divergence(t, t + c, base), term) for term, t, c in found if t / (t + c) > max(0.6, 2 * base) and divergence(t, t + c, base) >= need), reverse=True)[:TERMS]
    chosen: list[str] = []
    for term in sorted((x for _, x in good), key=lambda x: (len(x.rstrip("*")), not x.endswith("*"), x)):
        if not any(term.startswith(x[:-1]) for x in chosen if x.endswith("*")):
            chosen.append(term)
    return chosen


def prefer_words(found: list[tuple[str, int, int]], chosen: list[str]) -> list[str]:
    """A stem that one whole word accounts for gives way to the word."""
    count = {term: t for term, t, _ in found}
    out = set()
    for term in chosen:
        best = max((w for w in count if not w.endswith("*") and w.startswith(term[:-1])), key=lambda w: (count[w], w), default=None) if term.endswith("*") else None
        out.add(best if best and count[best] >= 0.9 * count[term] else term)
    return sorted(out)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(lexicon, weights). Bounded by ``sample`` rows, by TERMS terms and by three counts for each row."""
    name = F.col("doc_id").cast("string")
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    taken = known.where(F.crc32(name.cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(taken), "doc_id").select("doc_id", "text", "toxic").cache()
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    base = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.5
    flat = np.zeros(7)
    if not n_toxic or not n_clean:
        flat[0] = math.log(max(base, 1e-3) / max(1 - base, 1e-3))
        rows.unpersist()
        return [], flat
    terms = rows.mapInArrow(frugal(count_terms), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).cache()
    tried = terms.where(F.col("toxic") + F.col("clean") >= LEAST_TOXIC).count()  # the others can't be taken whatever their labels
    strong = terms.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") > F.col("clean"))).orderBy(F.desc("toxic"), "term").limit(20 * TERMS)
    found = [(r["term"], r["toxic"], r["clean"]) for r in strong.collect()]
    terms.unpersist()
    lexicon = prefer_words(found, choose_terms(found, tried, base))
    got = [(r["direct"], r["misspelt"], r["quoted"], r["toxic"]) for r in rows.mapInArrow(frugal(count_hits(lexicon, ["toxic"])), "doc_id long, toxic int, direct int, misspelt int, quoted int").collect()]
    rows.unpersist()
    data = np.array(got, float)
    return lexicon, fit(data[:, :3], data[:, 3])


def count_hits(lexicon: list[str], more: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Lexicon(lexicon))
        held = 0
        for batch in batches:
            counts = []
            for body in batch.column("text").to_pylist():
                held += len(body)
                if held > CHUNK:
                    reader.clear()
                    held = 0
                counts.append(reader.counts(body.decode("utf-8", "replace")))
            n = list(zip(*counts)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ["doc_id", *more]] + [pa.array(x, pa.int32()) for x in n], names=["doc_id", *more, "direct", "misspelt", "quoted"])

    return work


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, direct, misspelt, quoted: one row for each row of ``docs``."""
    lexicon, w = learn(docs, labels, sample)
    hits = texts(docs).mapInArrow(frugal(count_hits(lexicon, [])), "doc_id long, direct int, misspelt int, quoted int")
    x = [F.log1p(F.col(c).cast("double")) for c in ("direct", "misspelt", "quoted")] + [(F.col(c) > 0).cast("double") for c in ("direct", "misspelt", "quoted")]
    total = F.lit(float(w[0]))
    for value, weight in zip(x, w[1:]):
        total = total + value * F.lit(float(weight))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return hits.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "direct", "misspelt", "quoted")
