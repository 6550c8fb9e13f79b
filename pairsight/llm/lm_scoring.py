"""Code lengths by prediction by partial matching over a byte-context trie that no one task holds whole.

A text is lower-cased (A-Z) and read as its words, each followed by one blank, and an end
symbol. Contexts are the bytes before a byte, across words, back to the text's beginning:
``ORDERS`` of them, then two, one, none, and last the even distribution over bytes. A
symbol that the longest context does not know costs that context's escape, and the
symbols that it knows are excluded below it. Escapes of the long contexts are estimated
from the training texts by leaving one out: each occurrence, taken out of its context,
either finds its symbol among the others or would have escaped; the shares are kept by the
context's order, total and number of symbols (``cell``), and a symbol with count n of total
T then has the share (1 - escape) n / T. Contexts of two bytes and fewer with total T and D
symbols give n / (T + D) and the escape D / (T + D). The model is pretrained: a training
text is scored by counts that hold it.

The trie is dealt by the last ``ORDERS[-1]`` bytes of contexts, so that a shard holds all
longer contexts below them. A chunk of texts sends each different string of
``ORDERS[0]`` + 1 bytes once, with its training count; the shard adds counts and answers
with one log for each string and chunk. Two jobs read what was sent (``dealt_once``): the
first learns escapes and the counts of two-byte contexts (2**24 at most, whatever the
corpus), the second scores. What is gathered grows with the different strings of the corpus. A shard
holds its strings' counts merged, and its chunks' parts compressed; contexts that end in
the same ``ORDERS[-1]`` bytes can't be split further.

Counts of words, for the base, go the same way by 64-bit hashes of words.

Defined results: null and empty texts are the end symbol alone; a row without doc_id is
learned from; rows that repeat a doc_id are texts of their own; words and texts may be of
any length; without training rows every count is 0 and bytes are evenly distributed; an
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.llm.common import buckets_for, dealt_once, distinct, expand, frugal, mix, shuffle_parts, spread, squeeze, starts_of, texts
from pairsight.llm.ngram_join import joined, planes
from pairsight.llm.substring_dedup import word_hashes

END, BLANK = 10, 32
#: Lengths of the contexts that shards hold, longest first; at most seven bytes.
ORDERS = (6, 4, 3)
#: The context's bytes of a key: its highest, the last byte before the symbol first; the symbol is the lowest byte.
CONTEXT = np.uint64((1 << 64) - (1 << 8 * (8 - ORDERS[0])))
CELLS = 1024
CHUNK = 5 << 20
GRAMS, WORDS, DOCS, LOGS, FOUND = 0, 1, 2, 3, 4
ROW = "shard int, chunk long, kind int, part binary"
COLUMNS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
LEARNED = "what int, key long, a long, b long"
ESCAPE, SHORT, VOCABULARY = 0, 1, 2


def train_chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bool], list[list[bytes]]]]:
    """(doc ids, whether held out, words)."""
    ids, held, split, size = [], [], [], 0
    for batch in batches:
        for doc, out, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
            if size and size + len(body) > limit:
                yield ids, held, split
                ids, held, split, size = [], [], [], 0
            ids.append(doc)
            held.append(out)
            split.append(body.lower().split())
            size += len(body)
    if ids:
        yield ids, held, split


def gram_keys(text: bytes, size: np.ndarray) -> np.ndarray:
    """For each byte of texts of these sizes: its context and itself as one number; END stands before a text's beginning."""
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size + 8) - size
    padded = np.full(int((size + 8).sum()), END, np.uint8)
    at = spread(first, size)
    padded[at] = np.frombuffer(text, np.uint8)
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    return (eights[at - 8] & CONTEXT) | padded[at]


def counted(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and how often each is among the trained ones."""
    every, mine = distinct(keys), np.sort(keys[trained])
    first = starts_of(mine)
    counts = np.zeros(len(every), np.uint32)
    counts[np.searchsorted(every, mine[first])] = np.diff(np.append(first, len(mine)))
    return every, counts


def spread_back(keys: np.ndarray, told) -> np.ndarray:
    """For each key what ``told`` says of the different keys, which it gets sorted."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = starts_of(ordered)
    values = told(ordered[first])
    out = np.empty(len(keys), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(first, len(keys))))
    return out


def dealt_order(kind: int, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk's sorted keys travel, and their shards in it; the same whenever it is asked."""
    own = keys >> np.uint64(64 - 8 * ORDERS[-1]) if kind == GRAMS else keys
    shard = (mix(own + np.uint64(kind)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def as_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["shard", "chunk", "kind", "part"])


def parts_of(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, int, int, bytes]]:
    order, shard = dealt_order(kind, keys, shards)
    keys, counts = keys[order], counts[order]
    first = starts_of(shard)
    return [
        (int(shard[lo]), chunk, kind, squeeze(np.int64(hi - lo).tobytes() + planes(np.diff(keys[lo:hi], prepend=np.uint64(0))) + planes(counts[lo:hi])))
        for lo, hi in zip(first, [*first[1:], len(keys)])
    ]


def send(shards: int):
    """A chunk's strings and words with their training counts (0 where held-out texts alone have them), and the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (ids, held, split) in enumerate(train_chunks(batches, CHUNK)):
            chunk = TaskContext.get().partitionId() << 32 | k
            bodies = [b" ".join(words) + b" \n" if words else b"\n" for words in split]
            size, n = np.fromiter(map(len, bodies), np.int64, len(split)), np.fromiter(map(len, split), np.int64, len(split))
            trained, text = ~np.array(held, bool), b"".join(bodies)
            rows = parts_of(chunk, GRAMS, *counted(gram_keys(text, size), np.repeat(trained, size)), shards)
            rows += parts_of(chunk, WORDS, *counted(word_hashes(list(itertools.chain.from_iterable(split))), np.repeat(trained, n)), shards)
            none = np.array([d is None for d in ids], bool)
            known = np.array([0 if d is None else d for d in ids], np.int64)
            head = np.int64(len(ids)).tobytes() + known.tobytes() + size.tobytes() + n.tobytes() + none.tobytes() + (~trained).tobytes()
            rows.append((chunk % shards, chunk, DOCS, squeeze(head + text, 3)))
            del bodies, text
            for x in range(0, len(rows), 300):
                yield as_batch(rows[x : x + 300])

    return work


def unpacked(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = expand(part)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.cumsum(joined(raw[8:], "<u8", n)), joined(raw[8 + 8 * n :], "<u4", n).astype(np.int64)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with their counts added."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = starts_of(keys)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def by_shard(use):
    """``use`` gets the merged keys and counts of one (shard, kind) after another, and its chunks' parts; other rows pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        held: list[tuple[int, bytes]] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = 0

        def done() -> Iterator[pa.RecordBatch]:
            yield from use(*at, *added(parts), held)

        for batch in batches:
            for shard, chunk, kind, part in zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "kind", "part"))):
                if kind == DOCS:
                    yield as_batch([(shard, chunk, kind, part)])
                    continue
                if held and (shard, kind) != at:
                    yield from done()
                    held, parts, fresh = [], [], 0
                at = shard, kind
                held.append((chunk, part))
                parts.append(unpacked(part))
                fresh += len(parts[-1][0])
                if fresh > 1 << 20 and fresh > len(parts[0][0]):
                    parts, fresh = [added(parts)], 0
        if held:
            yield from done()

    return work


def cell(total: np.ndarray, kinds: np.ndarray, level) -> np.ndarray:
    """The cell of the escape table for contexts with this total (from 1) and number of symbols."""
    total, kinds = np.maximum(total, 1), np.maximum(kinds, 1)
    t = np.where(total < 5, total, 3 + np.log2(total).astype(np.int64))
    d = np.where(kinds < 4, kinds, 2 + np.log2(kinds).astype(np.int64))
    return level * CELLS + np.minimum(t, 63) * 16 + np.minimum(d, 15)


class Escapes:
    """Escapes and hits when one occurrence is left out, by cell."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros((2, CELLS * len(ORDERS))) if counts is None else counts

    def see(self, n: np.ndarray, total: np.ndarray, kinds: np.ndarray, level: int) -> None:
        """Symbols (n > 0) of contexts."""
        once, more = (n == 1) & (total > 1), n > 1
        size = self.counts.shape[1]
        self.counts[0] += np.bincount(cell(total[once] - 1, kinds[once] - 1, level), minlength=size)
        self.counts[1] += np.bincount(cell(total[more] - 1, kinds[more], level), weights=n[more], minlength=size)

    def share(self, total: np.ndarray, kinds: np.ndarray, level: int) -> np.ndarray:
        """1 for a context without symbols."""
        at = cell(total, kinds, level)
        prior = kinds / np.maximum(total + kinds, 1)  # weighs as much as four occurrences
        return np.where(total > 0, (self.counts[0][at] + 4 * prior) / (self.counts.sum(axis=0)[at] + 4), 1.0)


class Short:
    """Contexts of two bytes and fewer, with what is left of each level under exclusion."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n2 = keys[order].astype(np.uint32), counts[order].astype(np.int64)
        pair, last = (self.keys >> np.uint32(8)).astype(np.int64), (self.keys & np.uint32(0xFFFF)).astype(np.int64)
        self.t2 = np.bincount(pair, weights=self.n2, minlength=1 << 16).astype(np.int64)
        self.d2 = np.bincount(pair, minlength=1 << 16)
        self.n1 = np.bincount(last, weights=self.n2, minlength=1 << 16).astype(np.int64)
        table = self.n1.reshape(256, 256)
        self.n0 = table.sum(axis=0)
        self.t1 = table.sum(axis=1)[np.arange(1 << 16) & 255] - np.bincount(pair, weights=self.n1[last], minlength=1 << 16).astype(np.int64)
        self.d1 = (table > 0).sum(axis=1)[np.arange(1 << 16) & 255] - self.d2
        self.t0 = self.n0.sum() - ((table > 0) * self.n0).sum(axis=1)
        self.d0 = (self.n0 > 0).sum() - (table > 0).sum(axis=1)
        self.rest = 256 - int((self.n0 > 0).sum())
        self.tokens = int(self.n0[BLANK] + self.n0[END])

    def count2(self, pair: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(pair), np.int64)
        key = (pair.astype(np.int64) << 8 | symbol).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.n2[at], 0)

    def log(self, pair: np.ndarray, symbol: np.ndarray, t2: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """log10 of the share of ``symbol`` after two bytes, where t2 and d2 are what exclusion leaves of their context."""
        levels = (
            (self.count2(pair, symbol), t2, d2),
            (self.n1[(pair & 255) << 8 | symbol], self.t1[pair], self.d1[pair]),
            (self.n0[symbol], self.t0[pair & 255], self.d0[pair & 255]),
        )
        out, open_ = np.zeros(len(pair)), np.ones(len(pair), bool)
        for n, t, d in levels:
            found = open_ & (n > 0)
            out[found] += np.log10(n[found] / (t[found] + d[found]))
            open_ &= n == 0
            escaped = open_ & (t > 0)
            out[escaped] += np.log10(np.maximum(d[escaped], 1e-300) / (t[escaped] + d[escaped]))
        out[open_] -= math.log10(max(self.rest, 1))
        return out


class Level:
    """Contexts of one order over a shard's strings, which are sorted."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        own = keys if order == ORDERS[0] else (keys >> np.uint64(64 - 8 * order) << np.uint64(8)) | (keys & np.uint64(255))
        rank = np.argsort(own, kind="stable")
        first = starts_of(own[rank])
        #: The entry (context and symbol) of each string, and a string of each entry.
        self.entry = np.empty(len(keys), np.int64)
        self.entry[rank] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        self.one = rank[first]
        self.n = np.add.reduceat(counts[rank], first) if len(first) else np.zeros(0, np.int64)
        context = own[self.one] >> np.uint64(8 if order != ORDERS[0] else 64 - 8 * order)
        lead = starts_of(context)
        #: The context of each entry, its total and its number of symbols.
        self.context = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(context))))
        self.total = np.bincount(self.context, weights=self.n).astype(np.int64)
        self.kinds = np.bincount(self.context, weights=self.n > 0).astype(np.int64)

    def per_string(self, of_context: np.ndarray) -> np.ndarray:
        return of_context[self.context[self.entry]]


def two_bytes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last two bytes of contexts, the further one first, and the symbols."""
    return (((keys >> np.uint64(48)) & np.uint64(255)) << np.uint64(8) | keys >> np.uint64(56)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)


def string_logs(keys: np.ndarray, counts: np.ndarray, short: Short, escapes: Escapes) -> np.ndarray:
    """log10 of the last byte's share after the others, for a shard's different strings."""
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    above = None
    for k, order in enumerate(ORDERS):
        level = Level(keys, counts, order)
        n, total, kinds = level.n[level.entry], level.per_string(level.total), level.per_string(level.kinds)
        if above is not None:  # without the symbols that the longer context knows
            known = np.where(above.n > 0, n[above.one], 0)
            total = total - above.per_string(np.bincount(above.context, weights=known).astype(np.int64))
            kinds = kinds - above.per_string(above.kinds)
        escape = escapes.share(total, kinds, k)
        hit = open_ & (n > 0)
        out[hit] += np.log10((1 - escape[hit]) * n[hit] / total[hit])
        open_ &= n == 0
        out[open_] += np.log10(escape[open_])
        above = level
    pair, symbol = two_bytes(keys)
    known = np.where(above.n > 0, short.count2(pair[above.one], symbol[above.one]), 0)
    gone = above.per_string(np.bincount(above.context, weights=known).astype(np.int64))
    left = np.flatnonzero(open_)
    pair, symbol = pair[left], symbol[left]
    out[left] += short.log(pair, symbol, short.t2[pair] - gone[left], short.d2[pair] - above.per_string(above.kinds)[left])
    return out


def learn(shard: int, kind: int, keys: np.ndarray, counts: np.ndarray, held: list) -> Iterator[pa.RecordBatch]:
    """A shard's escapes and hits by cell, its counts of two-byte contexts, and its number of training words, from what training texts hold alone."""
    trained = counts > 0
    keys, counts = keys[trained], counts[trained]
    if kind == WORDS:
        columns = [[VOCABULARY], [0], [len(keys)], [0]]
    else:
        escapes = Escapes()
        for k, order in enumerate(ORDERS):
            level = Level(keys, counts, order)
            escapes.see(level.n, level.total[level.context], level.kinds[level.context], k)
        cells = np.flatnonzero(escapes.counts.sum(axis=0))
        pair, symbol = two_bytes(keys)
        place, at = np.unique(pair << 8 | symbol, return_inverse=True)
        n = np.bincount(at, weights=counts).astype(np.int64)
        columns = [np.repeat([ESCAPE, SHORT], [len(cells), len(place)]), np.append(cells, place), np.append(escapes.counts[0][cells].astype(np.int64), n), np.append(escapes.counts[1][cells].astype(np.int64), np.zeros_like(n))]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["what", "key", "a", "b"])


def answer(shared):
    """Tells each chunk the logs of its strings and the counts of its words, in the order in which it sent them."""

    def use(shard: int, kind: int, keys: np.ndarray, counts: np.ndarray, held: list) -> Iterator[pa.RecordBatch]:
        if kind == GRAMS:
            short_keys, n, escape_counts = shared.value
            told = string_logs(keys, counts, Short(short_keys, n), Escapes(escape_counts)).astype(np.float32)
        else:
            told = np.minimum(counts, (1 << 32) - 1).astype(np.uint32)  # beyond it a count's log is the same to nine digits
        for k in range(0, len(held), 50):
            yield as_batch([(shard, chunk, LOGS if kind == GRAMS else FOUND, squeeze(planes(told[np.searchsorted(keys, unpacked(part)[0])]))) for chunk, part in held[k : k + 50]])

    return by_shard(use)


def told_of(parts: list[bytes], dtype: str, keys: np.ndarray, kind: int, shards: int) -> np.ndarray:
    """What the shards, in their order, say of a chunk's different keys."""
    size = np.dtype(dtype).itemsize
    got = [joined(raw, dtype, len(raw) // size) for raw in map(expand, parts)]
    out = np.empty(len(keys), dtype)
    out[dealt_order(kind, keys, shards)[0]] = np.concatenate([*got, np.zeros(0, dtype)])
    return out


def score_texts(shards: int, tokens: int, vocabulary: int, end_count: int):
    """One chunk after another; its rows come by kind, then in the order of shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs = None, b""
        logs: list[bytes] = []
        counts: list[bytes] = []

        def done() -> pa.RecordBatch:
            raw = expand(docs)
            n_docs = int(np.frombuffer(raw, np.int64, 1)[0])
            known, size, n = np.frombuffer(raw, np.int64, 3 * n_docs, 8).reshape(3, n_docs)
            none, held = np.frombuffer(raw, bool, 2 * n_docs, 8 + 24 * n_docs).reshape(2, n_docs)
            text = raw[8 + 26 * n_docs :]
            each = spread_back(gram_keys(text, size), lambda every: told_of(logs, "<f4", every, GRAMS, shards))
            score = np.add.reduceat(each.astype(float), np.cumsum(size) - size)
            c = spread_back(word_hashes(text.split()), lambda every: told_of(counts, "<u4", every, WORDS, shards)).astype(np.int64)
            doc = np.repeat(np.arange(n_docs), n)
            base = np.bincount(doc, weights=np.log10(c + 1.0), minlength=n_docs) + math.log10(end_count + 1) - (n + 1) * math.log10(tokens + vocabulary + 1)
            n_known = np.bincount(doc, weights=c > 0, minlength=n_docs).astype(np.int64) + (end_count > 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(known, pa.int64(), mask=none), pa.array(held), pa.array(n + 1), pa.array(n_known), pa.array(np.full(n_docs, tokens, np.int64)), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for batch in batches:
            for chunk, kind, part in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "part"))):
                if at is not None and chunk != at:
                    yield done()
                    logs, counts = [], []
                at = chunk
                if kind == DOCS:
                    docs = part
                else:
                    (logs if kind == LOGS else counts).append(part)
        if at is not None:
            yield done()

    return work


def code_lengths(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.

    Rows whose crc32(doc_id as text) modulo ``modulus`` is ``held_out`` are not learned from.
    """
    spark = docs.sparkSession
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out, F.lit(False)).alias("held_out")
    body, parts, shards = texts(docs, out), shuffle_parts(spark), buckets_for(docs, 8 << 20)

    sent = dealt_once(body.mapInArrow(frugal(send(shards)), ROW).repartition(parts, "shard").sortWithinPartitions("shard", "kind"))
    # cells, contexts of two bytes and one number: 2**24 + 3 * CELLS + 1 rows at most
    found = sent.where(F.col("kind") != DOCS).mapInArrow(frugal(by_shard(learn)), LEARNED).groupBy("what", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    escapes = Escapes()
    cells = found[found["what"] == ESCAPE]
    escapes.counts[:, cells["key"].to_numpy(np.int64)] = cells[["a", "b"]].to_numpy(float).T
    pairs = found[found["what"] == SHORT]
    keys, counts = pairs["key"].to_numpy(np.int64), pairs["a"].to_numpy(np.int64)
    vocabulary = int(found[found["what"] == VOCABULARY]["a"].sum())
    short = Short(keys, counts)
    end = int(short.n0[END])
    shared = spark.sparkContext.broadcast((keys, counts, escapes.counts))
    answers = sent.mapInArrow(frugal(answer(shared)), ROW)
    by_chunk = answers.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "shard")
    return by_chunk.select("chunk", "kind", "part").mapInArrow(frugal(score_texts(shards, short.tokens, vocabulary + (end > 0), end)), COLUMNS)
