"""Repeated word windows, through super-k-mers (see superkmer.py).

Defined results: null text has no words; a document with fewer words than a window loses
nothing; a window goes when its word sequence also starts in a document with a smaller
doc_id (repeats inside one document alone stay); rows that repeat a doc_id count as one
document whose rows are judged alike; a row without doc_id keeps all its words; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from pairsight.llm.common import buckets_for, chunks, frugal, mix, sliding_min, spread
from pairsight.llm.superkmer import BucketWriter, fingerprints, gather, ranges_equal, spans_of, union_of, verified, with_spans

GRAM = 2
CHUNK = 3 << 20
PIECE_WORDS = 1 << 19


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, computed once for each distinct word."""
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))[at]


def cut_words(buckets: int, width: int):
    def settle_chunk(pieces: list[tuple[int, int, list[bytes]]], out: BucketWriter) -> None:
        words = list(itertools.chain.from_iterable(p[2] for p in pieces))
        count = np.array([len(p[2]) for p in pieces], np.int64)
        if not len(words):
            return
        data = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        h = word_hashes(words)
        grams = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] >> np.uint64(7)) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        least = sliding_min(grams, width - GRAM + 1)
        first = np.cumsum(count) - count
        n = np.maximum(count - width + 1, 0)
        starts = spread(first, n)
        if not len(starts):
            return
        piece = np.repeat(np.arange(len(pieces)), n)
        key = least[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (key[1:] != key[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(starts)) - 1
        lo, hi = begin[starts[a]], begin[starts[b] + width - 1] + size[starts[b] + width - 1]
        bucket = (mix(key[a]) % np.uint64(buckets)).astype(np.int64)
        met: dict[bytes, list] = {}
        own = piece[a]
        pos = starts[a] - first[own]
        for x, y, k, p, at, length in zip(lo.tolist(), hi.tolist(), bucket.tolist(), own.tolist(), pos.tolist(), (b - a + width).tolist()):
            doc, base, _ = pieces[p]
            met.setdefault(data[x:y], []).append((doc, base + at, k, length))
        for text, found in met.items():
            least_doc = min(found)[0] if len(found) > 1 else found[0][0]
            for doc, at, k, length in found:
                if doc == least_doc:
                    out.put(k, text, doc, at)
                else:
                    out.span(doc, at, at + length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = BucketWriter(buckets)
        for ids, bodies in chunks(batches, CHUNK):
            pieces, held = [], 0
            for doc, body in zip(ids, bodies):
                words = body.split() if doc is not None else []
                for base in range(0, max(1, len(words) - width + 1), PIECE_WORDS):
                    pieces.append((doc, base, words[base : base + PIECE_WORDS + width - 1]))
                    held += len(pieces[-1][2])
                    if held >= PIECE_WORDS:
                        settle_chunk(pieces, out)
                        pieces, held = [], 0
            settle_chunk(pieces, out)
            if out.full():
                yield from out.flush()
        yield from out.flush()

    return work


def word_windows(width: int):
    def windows_of(data: np.ndarray, head: np.ndarray):
        size = head[0]
        first = np.cumsum(size) - size
        begins = np.zeros(len(data), bool)
        begins[first] = True
        blank = data == 32
        begins[1:] |= blank[:-1]
        start = np.flatnonzero(begins)
        owner = np.searchsorted(first, start, "right") - 1
        end = np.append(start[1:], len(data))
        inner = np.append(owner[1:] == owner[:-1], False)
        end = end - inner  # without the blank that follows
        count = np.bincount(owner, minlength=len(size))
        at = np.cumsum(count) - count
        n = np.maximum(count - width + 1, 0)
        w = spread(at, n)
        own = np.repeat(np.arange(len(size)), n)
        return start[w], end[w + width - 1], own, w - at[own]

    return windows_of


def later_documents(width: int):
    windows_of = word_windows(width)

    def judge(raw: bytes, head: np.ndarray):
        data = np.frombuffer(raw, np.uint8)
        lo, hi, owner, unit = windows_of(data, head)
        prints = fingerprints(data, lo, hi)
        order = np.lexsort((head[1][owner], prints))
        p = prints[order]
        new = np.ones(len(p), bool)
        new[1:] = p[1:] != p[:-1]
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        doc = head[1][owner]
        later = doc[order] > doc[lead]
        a, b = order[later], lead[later]
        ok = verified(lo, hi, a, b, lambda x, y, n: ranges_equal(data, x, y, n))
        a = a[ok]
        yield gather(owner[a], unit[a], head, width)

    return judge


def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column("doc_id")
        n_words, n_removed, digests = [], [], []
        for body, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = body.split()
            gone, kept, at = 0, [], 0
            for lo, hi in union_of(packed, len(words)):
                kept += words[at:lo]
                gone += hi - lo
                at = hi
            kept += words[at:]
            n_words.append(len(words))
            n_removed.append(gone)
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([docs, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_words(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id and its list of packed (first word, end word) pairs, for documents that lose any."""
    return spans_of(docs, cut_words(buckets_for(docs, 1 << 20), width), later_documents(width))


def without_repeated_words(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of ``docs``."""
    rows = with_spans(docs, repeated_words(docs, width))
    return rows.mapInArrow(frugal(kept_words), "doc_id long, n_words long, n_removed long, kept_sha256 string")
