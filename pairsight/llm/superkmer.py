"""Repeated windows through super-k-mers: consecutive windows that share a minimiser travel as one string.

A window is a fixed number of consecutive units (words or bytes) of one document. The
minimiser of a window is the least hash of its short grams, so equal windows have equal
minimisers and meet in one bucket. Map side: a chunk's windows are cut into runs with one
minimiser; equal strings of a chunk are settled there, so that a string which many
documents share travels once per chunk. Reduce side: a bucket's windows are sorted by
fingerprint and ties are verified on the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.llm.common import expand, frugal, mix, shuffle_parts, spread, squeeze, starts_of, texts

#: The owner of a string whose spans some chunk has given already, or of a row without doc_id: an occurrence for others, nothing else.
SETTLED = np.iinfo(np.int64).min
FLUSH_BYTES = 24 << 20
HASH_PIECE = 1 << 20
BASE = 0x100000001B3 | 1
PARTS_SCHEMA = "bucket int, settled boolean, part binary"
SPANS_SCHEMA = "doc_id long, spans binary"


class BucketWriter:
    """Collects strings with their owners by bucket, and spans that a chunk settled."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.turn = 0
        self.clear()

    def clear(self) -> None:
        self.strings: dict[int, list] = {}
        self.spans: list[tuple[int, int, int]] = []
        self.held = 0

    def put(self, bucket: int, text: bytes, doc: int, pos: int, anchor: int = 0) -> None:
        """``anchor``: where in the string its minimiser is, for operators that lay strings out by it."""
        self.strings.setdefault(bucket, []).append((text, doc, pos, anchor))
        self.held += len(text) + 130

    def span(self, doc: int, lo: int, hi: int) -> None:
        self.spans.append((doc, lo, hi))
        self.held += 150

    def full(self) -> bool:
        return self.held >= FLUSH_BYTES

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bool, bytes]] = []
        for bucket, held in self.strings.items():
            head = np.array([(len(t), d, p, a) for t, d, p, a in held], np.int64)
            rows.append((bucket, False, squeeze(np.int64(len(held)).tobytes() + head.T.tobytes() + b"".join(t for t, *_ in held), 3)))
        for k in range(0, len(self.spans), 20_000):
            self.turn += 1
            spans = np.array(self.spans[k : k + 20_000], np.int64)
            rows.append((int(mix(np.array([spans[0, 0] * 31 + self.turn], np.uint64))[0] % np.uint64(self.buckets)), True, squeeze(spans.tobytes())))
        for k in range(0, len(rows), 500):
            bucket, settled, part = zip(*rows[k : k + 500])
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(settled, pa.bool_()), pa.array(part, pa.binary())], names=["bucket", "settled", "part"])
        self.clear()


def unpack(part: bytes) -> tuple[np.ndarray, bytes]:
    """(lengths, docs, positions, anchors) and the joined strings."""
    raw = expand(part)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n), raw[8 + 32 * n :]


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, raised to 0..n-1."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def fingerprints(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[lo:hi]; lo and hi ascend. Works in pieces of bounded size."""
    out = np.empty(len(lo), np.uint64)
    at = 0
    while at < len(lo):
        begin = int(lo[at])
        stop = max(int(np.searchsorted(hi, begin + HASH_PIECE, "right")), at + 1)
        piece = data[begin : int(hi[stop - 1])]
        up, down = powers(1 << max(21, int(len(piece)).bit_length()))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        a, b = lo[at:stop] - begin, hi[at:stop] - begin
        out[at:stop] = mix((sums[b] - sums[a]) * down[a])
        at = stop
    return out


def ranges_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size], byte for byte."""
    same = np.ones(len(a), bool)
    step = max(1, (4 << 20) // max(1, int(size.max(initial=1))))
    for k in range(0, len(a), step):
        n = size[k : k + step]
        off = data[spread(a[k : k + step], n)] != data[spread(b[k : k + step], n)]
        same[k : k + step] = np.bincount(np.repeat(np.arange(len(n)), n), weights=off, minlength=len(n)) == 0
    return same


def verified(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray, equal: Callable) -> np.ndarray:
    """For each pair of windows (a[k], b[k]): whether their bytes are equal. Neighbouring pairs are compared as one range."""
    if not len(a):
        return np.zeros(0, bool)
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = ~((x[1:] == x[:-1] + 1) & (y[1:] == y[:-1] + 1) & (lo[x[1:]] < hi[x[:-1]]) & (lo[y[1:]] < hi[y[:-1]]) & (lo[x[1:]] - lo[x[:-1]] == lo[y[1:]] - lo[y[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    la, lb = hi[x[last]] - lo[x[first]], hi[y[last]] - lo[y[first]]
    ok = la == lb
    ok[ok] = equal(lo[x[first]][ok], lo[y[first]][ok], la[ok])
    each = np.repeat(ok, last - first + 1)
    # a range that differs may still hold equal windows: those are compared one by one
    bad = np.flatnonzero(~each)
    if len(bad):
        la, lb = hi[x[bad]] - lo[x[bad]], hi[y[bad]] - lo[y[bad]]
        fit = la == lb
        fit[fit] = equal(lo[x[bad]][fit], lo[y[bad]][fit], la[fit])
        each[bad] = fit
    out = np.empty(len(a), bool)
    out[order] = each
    return out


def spans_batches(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each document: its spans as packed pairs."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    doc, pairs = doc[order], np.stack([lo, hi], 1).astype(np.int64)[order]
    first = starts_of(doc)
    ends = np.append(first[1:], len(doc))
    for k in range(0, len(first), 5000):
        f, e = first[k : k + 5000], ends[k : k + 5000]
        yield pa.RecordBatch.from_arrays([pa.array(doc[f], pa.int64()), pa.array([pairs[x:y].tobytes() for x, y in zip(f, e)], pa.binary())], names=["doc_id", "spans"])


def settle(judge: Callable):
    """Reads parts sorted by bucket; ``judge`` gets one bucket's strings and their head at a time, and gives spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[np.ndarray] = []
        bodies: list[bytes] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            head, data = np.concatenate(heads, axis=1), b"".join(bodies)
            heads.clear()
            bodies.clear()
            for doc, begin, end in judge(data, head):
                yield from spans_batches(doc, begin, end)

        for batch in batches:
            for bucket, settled, part in zip(*(batch.column(c).to_pylist() for c in ("bucket", "settled", "part"))):
                if settled:
                    spans = np.frombuffer(expand(part), np.int64).reshape(-1, 3)
                    yield from spans_batches(spans[:, 0], spans[:, 1], spans[:, 2])
                    continue
                if bucket != at and heads:
                    yield from done()
                at = bucket
                head, body = unpack(part)
                heads.append(head)
                bodies.append(body)
        if heads:
            yield from done()

    return work


def gather(owner: np.ndarray, unit: np.ndarray, head: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the given windows (string number, offset in units): neighbours are joined."""
    order = np.lexsort((unit, owner))
    owner, unit = owner[order], unit[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (unit[1:] != unit[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    at = owner[first]
    keep = head[1][at] != SETTLED
    first, last, at = first[keep], last[keep], at[keep]
    return head[1][at], head[2][at] + unit[first], head[2][at] + unit[last] + width


def spans_of(docs: DataFrame, cutter: Callable, judge: Callable) -> DataFrame:
    """doc_id and the list of its packed spans, for documents that have any."""
    parts = shuffle_parts(docs.sparkSession)
    sent = texts(docs).mapInArrow(frugal(cutter), PARTS_SCHEMA)
    met = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(frugal(settle(judge)), SPANS_SCHEMA).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row's doc_id and text, with the spans where it has some."""
    return texts(docs).join(spans, "doc_id", "left").select("doc_id", "text", "spans")


def union_of(packed: list[bytes] | None, limit: int) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover; spans beyond ``limit`` are cut."""
    if not packed:
        return []
    pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in packed])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pairs)) - 1
    return [(int(a), min(int(b), limit)) for a, b in zip(pairs[first, 0], reach[last]) if a < limit]
