"""Repeated byte strings by blockwise suffix sorting with a difference cover.

A suffix belongs to the bucket of the minimiser of its first ``width`` bytes, and
neighbouring suffixes with one minimiser travel as one string (see superkmer.py), so a
bucket holds all it needs. In a bucket, first, the suffixes that start at the places of a
difference cover modulo ``PERIOD`` are ranked, once: by their first PERIOD bytes, then by
doubling, since a sample place and the place PERIOD further on are both in the sample.
Then the bucket's suffixes are cut into blocks by their first bytes, and one block at a
time is sorted: by the first PERIOD bytes, eight at a time, and where these tie, by ranks.
For any two places x, y there is an offset k below PERIOD at which x + k and y + k are both
sample places, whose ranks decide. Places of one residue compare at one k and are sorted
at once; residues are then merged by comparing. What is repeated stands side by side:
neighbours with ``width`` bytes in common. Beside a bucket's bytes and ranks, memory is
that of a block.

Strings whose minimiser no other string of the bucket has are left out beforehand: they
share no suffix of ``width`` bytes. Strings are laid out with their minimisers at one residue, so that equal suffixes mostly
have equal residues and little is left to merge.

Defined results: null text is empty; texts shorter than ``width`` bytes lose nothing;
a string that occurs twice in one document counts; every place where a repeated string
occurs is removed, the first too; rows with one doc_id are separate occurrences of their
strings, but spans found in any of them apply to all; a row without doc_id keeps all its
bytes, and what it holds is an occurrence for the others; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairsight.llm.common import buckets_for, chunks, distinct, frugal, mix, sliding_min, spread, starts_of
from pairsight.llm.superkmer import SETTLED, BucketWriter, gather, spans_of, union_of, with_spans

GRAM = 16
CHUNK = 1 << 20
PERIOD = 64
SHIFT, WITHIN = PERIOD.bit_length() - 1, PERIOD - 1
#: A smallest difference cover modulo PERIOD.
COVER = np.array([1, 2, 3, 6, 15, 17, 35, 43, 60])
#: The number of a residue among those of the cover.
NUMBER = np.full(PERIOD, -1)
NUMBER[COVER] = np.arange(len(COVER))
#: Suffixes in a block.
BLOCK = 1 << 18
#: The first k bytes of eight, for k from 0.
FIRST = np.array([(1 << 64) - (1 << 8 * (8 - k)) for k in range(9)], np.uint64)
#: Bits of a minimiser's hash that say where it is in its chunk's text.
PLACE = np.uint64((1 << 22) - 1)


def cover_offsets() -> np.ndarray:
    """[x, y] -> the least k with (x + k) and (y + k) in the cover, modulo PERIOD."""
    inside = NUMBER >= 0
    k = np.arange(PERIOD)
    hit = inside[(k[:, None] + k) % PERIOD]  # [x, k]
    return np.argmax(hit[:, None, :] & hit[None, :, :], axis=2)


OFFSETS = cover_offsets()


def sample_number(place: np.ndarray) -> np.ndarray:
    return (place >> SHIFT) * len(COVER) + NUMBER[place & WITHIN]


def tied(new: np.ndarray) -> np.ndarray:
    """Numbers of the entries that share a group with another; ``new`` marks where groups begin."""
    alone = new & np.append(new[1:], True)
    return np.flatnonzero(~alone)


class Sorted:
    """Entries in the order of what has been looked at, and which of them are still tied."""

    def __init__(self, first: np.ndarray):
        self.order = np.argsort(first)
        first = first[self.order]
        self.new = np.append(True, first[1:] != first[:-1])[: len(first)]
        #: Places in the order of tied entries, and numbers of their groups.
        self.at = tied(self.new)
        self.group = np.cumsum(self.new)[self.at]

    def refine(self, key_of) -> bool:
        """Sorts tied entries by another key of theirs, of 40 bits at most; False if there are none."""
        if not len(self.at):
            return False
        which = self.order[self.at]
        key = key_of(which).astype(np.uint64)
        if self.group[-1] < 1 << 24:
            key |= self.group.astype(np.uint64) << np.uint64(40)
            sub = np.argsort(key)
        else:
            sub = np.lexsort((key, self.group))
        key = key[sub]
        self.order[self.at] = which[sub]
        split = np.append(True, (self.group[1:] != self.group[:-1]) | (key[1:] != key[:-1]))
        self.new[self.at] = split
        left = tied(split)
        self.at, self.group = self.at[left], np.cumsum(split)[left]
        return True


def by_bytes(eights: np.ndarray, place: np.ndarray, room: np.ndarray | None = None, reach: int = PERIOD) -> Sorted:
    """Places in the order of their first ``reach`` bytes, or of the ``room`` bytes that they have where these are fewer."""

    def eight(which, depth: int) -> np.ndarray:
        value = eights[place[which] + depth].astype(np.uint64)
        if room is not None:
            return value & FIRST[np.clip(room[which] - depth, 0, 8)]
        return value if reach - depth >= 8 else value & FIRST[reach - depth]

    out = Sorted(eight(slice(None), 0))
    for depth in range(8, reach, 5):
        if not out.refine(lambda which: eight(which, depth) >> np.uint64(24)):
            return out
    if room is not None:
        out.refine(lambda which: np.minimum(room[which], reach))
    return out


def sample_ranks(eights: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rank of each sample place's suffix, to the end of its string; ``owner``: the string of each PERIOD bytes."""
    place = (np.arange(len(owner))[:, None] * PERIOD + COVER).ravel()
    own = np.repeat(owner, len(COVER))
    room = np.where(place >= start[own], np.maximum(end[own] - place, 0), 0)
    some = np.flatnonzero(room)
    found = by_bytes(eights, place[some], room[some])
    rank = np.full(len(place), -1, np.int32)
    reach, most = PERIOD, int(room.max(initial=0))
    while True:
        rank[some[found.order]] = np.cumsum(found.new)
        if reach >= most:
            return rank
        step = reach // PERIOD * len(COVER)

        def further(which: np.ndarray) -> np.ndarray:
            at = some[which]
            on = room[at] > reach
            return np.where(on, rank[np.where(on, at + step, 0)], 0)  # ranks begin with 1

        if not found.refine(further):
            return rank
        reach *= 2


def before(rank: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the suffix at x comes before that at y; their first PERIOD bytes are equal."""
    k = OFFSETS[x & WITHIN, y & WITHIN]
    return rank[sample_number(x + k)] < rank[sample_number(y + k)]


def merge_residues(x: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places sorted within (group, residue), sorted within groups: runs are merged two by two."""
    run = np.append(True, (group[1:] != group[:-1]) | ((x[1:] ^ x[:-1]) & WITHIN != 0))[: len(x)]
    while True:
        start = np.flatnonzero(run)
        end = np.append(start[1:], len(x))
        of = group[start]
        lead = np.append(True, of[1:] != of[:-1])[: len(of)]
        nth = np.arange(len(start)) - np.flatnonzero(lead)[np.cumsum(lead) - 1]
        if not (nth > 0).any():
            return x
        right = nth % 2 == 1
        other = np.where(right, np.arange(len(start)) - 1, np.arange(len(start)) + 1)
        other[~right] = np.where(np.append(right[1:], False)[~right], other[~right], -1)
        mine = np.cumsum(run) - 1
        at = np.flatnonzero(other[mine] >= 0)
        partner, late = other[mine[at]], right[mine[at]]
        lo, hi = start[partner].copy(), end[partner].copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            y, own = x[mid], x[at[open_]]
            less = np.where(late[open_], ~before(rank, own, y), before(rank, y, own))
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        to = np.arange(len(x))
        to[at] = np.minimum(start[partner], start[mine[at]]) + (at - start[mine[at]]) + (lo - start[partner])
        merged = np.empty_like(x)
        merged[to] = x
        x = merged
        run[start[right]] = False


def sorted_ties(data: np.ndarray, eights: np.ndarray, place: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's places those that share PERIOD bytes (or ``width``, if fewer) with another, in the order of their suffixes, and their groups."""
    found = by_bytes(eights, place, reach=min(PERIOD, width))
    x, group = place[found.order[found.at]], found.group
    if width > PERIOD and len(x):
        residue = x & WITHIN
        x = x[np.lexsort((rank[sample_number(x + OFFSETS[residue, residue])], residue, group))]
        x = merge_residues(x, group, rank)
    return x, group


def blocks_of(first: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of entries, about BLOCK at a time, with equal first bytes together."""
    if len(first) <= BLOCK:
        yield np.arange(len(first))
        return
    some = np.sort(first[:: max(1, len(first) // 4096)])
    edges = np.unique(some[:: max(1, len(some) * BLOCK // len(first))][1:])
    block = np.searchsorted(edges, first, "right")
    for k in range(len(edges) + 1):
        yield np.flatnonzero(block == k)


def repeated_places(texts: list[bytes], anchors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every suffix whose first ``width`` bytes occur twice in these strings."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    lead = -anchors % PERIOD
    blocks = -(-(lead + size) // PERIOD)
    start = (np.cumsum(blocks) - blocks) * PERIOD + lead
    data = np.zeros(int(blocks.sum()) * PERIOD + 2 * PERIOD + width, np.uint8)
    data[spread(start, size)] = np.frombuffer(b"".join(texts), np.uint8)
    eights = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    rank = sample_ranks(eights, np.repeat(np.arange(len(texts)), blocks), start, start + size) if width > PERIOD else None
    places = spread(start, np.maximum(size - width + 1, 0))
    found = [np.zeros(0, np.int64)]
    rest = np.ndarray((len(data) - width + 1,), f"S{width - PERIOD}", data.data, PERIOD, (1,)) if width > PERIOD else None
    for which in blocks_of(eights[places].astype(np.uint64)):
        x, group = sorted_ties(data, eights, places[which], rank, width)
        pair = np.flatnonzero(group[1:] == group[:-1])
        for k in range(0, len(pair), 1 << 15):
            a, b = x[pair[k : k + (1 << 15)]], x[pair[k : k + (1 << 15)] + 1]
            if rest is not None:
                same = rest[a] == rest[b]
                a, b = a[same], b[same]
            found += [a, b]
    at = distinct(np.concatenate(found))
    own = np.searchsorted(start, at, "right") - 1
    return own, at - start[own]


def gram_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of sixteen bytes as two numbers; the low bits are left for a place."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(33)))) & ~PLACE


def cut_bytes(buckets: int, width: int):
    def settle_chunk(pieces: list[tuple[int, int, bytes]], out: BucketWriter) -> None:
        text = b"".join(p[2] for p in pieces)
        size = np.array([len(p[2]) for p in pieces], np.int64)
        n = np.maximum(size - width + 1, 0)
        first = np.cumsum(size) - size
        starts = spread(first, n)
        if not len(starts):
            return
        eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
        grams = gram_hash(eight[: len(text) - GRAM + 1], eight[8:])
        # the leftmost of the least hashes, and its place in the low bits
        placed = sliding_min(grams | np.arange(len(grams), dtype=np.uint64), width - GRAM + 1)[starts]
        key = placed & ~PLACE
        piece = np.repeat(np.arange(len(pieces)), n)
        new = np.ones(len(starts), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (key[1:] != key[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(starts)) - 1
        bucket = (mix(key[a]) % np.uint64(buckets)).astype(np.int64)
        # where the string's minimiser is, and in the last bit whether its windows have it at several places
        anchor = ((placed[a] & PLACE).astype(np.int64) - starts[a]) * 2 + (placed[a] != placed[b])
        met: dict[bytes, list] = {}
        own = piece[a]
        for x, y, k, p, at, to in zip(starts[a].tolist(), (starts[b] + width).tolist(), bucket.tolist(), own.tolist(), (starts[a] - first[own]).tolist(), anchor.tolist()):
            doc, base, _ = pieces[p]
            met.setdefault(text[x:y], []).append((doc, base + at, k, to))
        for string, found in met.items():
            doc, at, k, to = found[0]
            if len(found) == 1:
                out.put(k, string, doc, at, to)
                continue
            out.put(k, string, int(SETTLED), 0, to)
            for doc, at, _, _ in found:
                if doc != SETTLED:
                    out.span(doc, at, at + len(string))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = BucketWriter(buckets)
        for ids, bodies in chunks(batches, CHUNK):
            pieces, held = [], 0
            for doc, body in zip(ids, bodies):
                for base in range(0, max(1, len(body) - width + 1), CHUNK):
                    pieces.append((int(SETTLED) if doc is None else doc, base, body[base : base + CHUNK + width - 1]))
                    held += len(pieces[-1][2])
                    if held >= CHUNK:
                        settle_chunk(pieces, out)
                        pieces, held = [], 0
            settle_chunk(pieces, out)
            if out.full():
                yield from out.flush()
        yield from out.flush()

    return work


def any_repeat(width: int):
    def judge(raw: bytes, head: np.ndarray):
        size, doc, pos, anchor = head
        first: dict[bytes, int] = {}
        copies, at = [], 0
        for k, n in enumerate(size.tolist()):
            one = first.setdefault(raw[at : at + n], k)
            at += n
            if one != k:
                copies += [one, k]
        if copies:  # equal strings are repeated as a whole; one of them stays, as an occurrence
            at = distinct(np.array(copies))
            named = at[doc[at] != SETTLED]
            yield doc[named], pos[named], pos[named] + size[named]
            doc = doc.copy()
            doc[at] = SETTLED
        kept = np.fromiter(first.values(), np.int64, len(first))
        texts = list(first)
        del first
        # equal windows have equal minimisers: a string whose minimiser no other has, at one place of its own, repeats nothing
        begin = np.cumsum(size) - size + (anchor >> 1)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        key = gram_hash(eight[begin[kept]], eight[begin[kept] + 8])
        order = np.argsort(key)
        runs = starts_of(key[order])
        held = np.diff(np.append(runs, len(key)))
        likely = np.empty(len(key), bool)
        likely[order] = np.repeat(held > 1, held)
        likely |= anchor[kept] & 1 == 1
        some = np.flatnonzero(likely)
        if not len(some):
            return
        kept, texts = kept[some], [texts[k] for k in some]
        owner, unit = repeated_places(texts, anchor[kept] >> 1, width)
        yield gather(owner, unit, np.stack([size[kept], doc[kept], pos[kept]]), width)

    return judge


def kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, digests = [], [], [], []
        for body, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            digest, gone, at = hashlib.sha256(), 0, 0
            runs = union_of(packed, len(body))
            for lo, hi in runs:
                digest.update(body[at:lo])
                gone += hi - lo
                at = hi
            digest.update(body[at:])
            n_bytes.append(len(body))
            n_removed.append(gone)
            n_spans.append(len(runs))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, width: int = 200) -> DataFrame:
    """doc_id and its list of packed (begin, end) byte pairs, for documents that lose any."""
    return spans_of(docs, cut_bytes(buckets_for(docs, 1 << 20), width), any_repeat(width))


def without_repeated_bytes(docs: DataFrame, width: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of ``docs``."""
    rows = with_spans(docs, repeated_bytes(docs, width))
    return rows.mapInArrow(frugal(kept_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
