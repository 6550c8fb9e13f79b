"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie. Where no child fits the next byte, a failure link leads to the
node of what is left after the longest pieces are taken off, and each link carries how
many pieces that pops, so a word is counted in one pass without building pieces.

A word is a run of other than ``[\\x20\\x09-\\x0D]``; it is matched with one blank before
it, as byte vocabularies have it. A word that the vocabulary cannot spell is one unknown
token.

Defined results: null and empty texts have no tokens; words of any length are counted
whole; rows that repeat a doc_id are counted each; an empty table gives no rows; an empty
vocabulary makes every word unknown; other columns are not read.
"""

from __future__ import annotations

import base64
import itertools
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairsight.llm.common import chunks, frugal, texts

CHUNK = 4 << 20
KNOWN = 200_000


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file: base64 and a number on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(x.split()[0]) for x in lines if x.strip()]


class Automaton:
    def __init__(self, pieces: Iterable[bytes]):
        self.step: dict[int, int] = {}
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                node = self.step.setdefault(key, len(final))
                if node == len(final):
                    final.append(False)
            if node:
                final[node] = True
        children: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for key, node in self.step.items():
            children[key >> 8].append((key & 255, node))
        #: -1: what is left can't be spelt.
        self.fail = [-1] * len(final)
        self.pops = [0] * len(final)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent]:
                queue.append(node)
                if final[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                to, popped = self.fail[parent], self.pops[parent]
                while to >= 0 and (to << 8 | byte) not in self.step:
                    popped += self.pops[to]
                    to = self.fail[to]
                if to >= 0:
                    self.fail[node], self.pops[node] = self.step[to << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; -1 if the vocabulary can't spell it."""
        step, fail, pops = self.step.get, self.fail, self.pops
        node = total = 0
        for byte in word:
            to = step(node << 8 | byte)
            while to is None:
                if fail[node] < 0:
                    return -1
                total += pops[node]
                node = fail[node]
                to = step(node << 8 | byte)
            node = to
        while node:
            if fail[node] < 0:
                return -1
            total += pops[node]
            node = fail[node]
        return total


_BUILT: dict[int, Automaton] = {}


def counter(shared, name: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Automaton(shared.value)
        count = _BUILT[name].count
        known: dict[bytes, int] = {}
        for ids, bodies in chunks(batches, CHUNK):
            split = [body.split() for body in bodies]
            n_words = np.fromiter(map(len, split), np.int64, len(split))
            number: dict[bytes, int] = defaultdict(itertools.count().__next__)
            at = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n_words.sum()))
            if len(known) > KNOWN:
                known.clear()
            sizes = np.fromiter((known[w] if w in known else known.setdefault(w, count(b" " + w)) for w in number), np.int64, len(number))[at]
            doc = np.repeat(np.arange(len(ids)), n_words)
            unknown = np.bincount(doc, weights=sizes < 0, minlength=len(ids)).astype(np.int64)
            tokens = np.bincount(doc, weights=np.where(sizes < 0, 1, sizes), minlength=len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words), pa.array(tokens), pa.array(unknown)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return work


def token_counts(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown: one row for each row of ``docs``; no shuffle. The vocabulary's size bounds the broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    return texts(docs).mapInArrow(frugal(counter(shared, hash(tuple(pieces)))), "doc_id long, n_words long, n_tokens long, n_unknown long")
