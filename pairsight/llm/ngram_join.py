"""Jaccard join of shingle sets with token-combination prefixes.

1. A chunk's documents become sets of 64-bit shingle hashes; equal sets of a chunk are
   one set. Occurrences meet by hash and learn whether their shingle is unique in the
   corpus, rare, or frequent (``FREQUENT`` sets or more; where one chunk alone holds so
   many, its occurrences need no meeting). Only shingles that are not unique go on.
2. Shingles are ordered: unique, rare by hash, frequent by hash. A set of n shingles that
   links at threshold t shares at least a = ceil(t n) of them, so the first k shared ones
   lie within its first n - a + k. With k = ``GROUPS`` + 1, either one of them is rare and
   indexes the set alone, or two frequent ones lie in the same hash group and index it as
   a combination. Sets with a < k are indexed under every shingle as well.
3. Sets with an index key in common are candidates, unless a bound on what they share
   rules a link out: unique shingles are not shared, and parity bitmaps of the others
   differ in no more bits than the sets in shingles. Neighbours under a set's least keys
   (a sketch of its keys: near copies share some of them) are verified first, and links
   give components; then every candidate pair that is still in two
   components is verified, so no link between components is lost, while a group of
   near copies costs a few pairs per member. A pair is made at the first key that its
   sets share and hardly ever again (never where one of the ``EARLIER`` keys before is
   shared), however many keys they have in common.

Defined results: null and blank texts have the empty set and link with nothing; fewer
words than a shingle make one shingle of the whole sequence; a row without doc_id has its
n_shingles and no component; rows that repeat a doc_id are one node; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.llm.common import buckets_for, chunks, cut, distinct, expand, forget, frugal, mix, shuffle_parts, spread, squeeze, starts_of, texts
from pairsight.llm.components import components
from pairsight.llm.substring_dedup import word_hashes

CHUNK = 2 << 20
FREQUENT = 64
GROUPS = 4
#: How many of a set's earlier keys are held beside a key, to see that a pair has come from one of them.
EARLIER = 16
#: Under so many of a set's keys, the least ones, neighbours are looked for first; what that misses is left to the candidates of all keys.
LEAST_KEYS = 8
#: Kinds of rows in the shuffles: a chunk's table of sets, its frequent occurrences, shingles to be counted, their answer.
TABLE, OWN, COUNT, ANSWER = 0, 1, 2, 3
ROW = "bucket int, chunk long, kind int, part binary"
SET_ROW = "doc_id long, n_shingles long, rep long, tokens array<long>, keys array<long>, low long, high long"
SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: sorted numbers as differences then compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def joined(raw: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel()


def packed(owner: np.ndarray, value: np.ndarray, often: np.ndarray) -> bytes:
    """Occurrences, sorted by value."""
    return squeeze(np.int64(len(value)).tobytes() + planes(np.diff(value, prepend=np.uint64(0))) + planes(owner.astype(np.uint32)) + often.tobytes())


def unpacked(part: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = expand(part)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return joined(raw[8 + 8 * n :], "<u4", n), np.cumsum(joined(raw[8:], "<u8", n)), np.frombuffer(raw, bool, n, 8 + 12 * n)


def shingle_sets(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, sorted."""
    split = [b.lower().split() for b in bodies]
    count = np.fromiter(map(len, split), np.int64, len(split))
    h = word_hashes(list(itertools.chain.from_iterable(split)))
    first = np.cumsum(count) - count
    n = np.maximum(count - width + 1, 0)
    at = spread(first, n)
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value = mix(value + h[at + k] * SALT[k % 4] + np.uint64(k))
    owner = np.repeat(np.arange(len(split)), n)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = []
        for s in short:
            x = np.zeros(1, np.uint64)
            for k in range(count[s]):
                x = mix(x + h[first[s] + k : first[s] + k + 1] * SALT[k % 4] + np.uint64(k))
            extra.append(mix(x + np.uint64(1000 + count[s])))
        value, owner = np.concatenate([value, *extra]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new]


def cut_shingles(buckets: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (ids, bodies) in enumerate(chunks(batches, CHUNK)):
            owner, value = shingle_sets(bodies, width)
            size = np.bincount(owner, minlength=len(ids))
            first = np.cumsum(size) - size
            met: dict[bytes, int] = {}
            rep = np.full(len(ids), -1, np.int64)  # number of the row that stands for this one's set
            for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)):
                if size[k] and ids[k] is not None:
                    rep[k] = met.setdefault(value[first[k] : first[k] + size[k]].tobytes(), k)
            known = np.array([0 if d is None else d for d in ids], np.int64)
            none = np.array([d is None for d in ids], bool)
            chunk = TaskContext.get().partitionId() << 32 | turn
            rows = [(chunk % buckets, chunk, TABLE, squeeze(np.int64(len(ids)).tobytes() + known.tobytes() + none.tobytes() + size.astype(np.int64).tobytes() + rep.tobytes()))]
            mine = rep[owner] == owner
            value, owner = value[mine], owner[mine].astype(np.uint32)
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            runs = starts_of(value)
            held = np.diff(np.append(runs, len(value)))
            often = np.repeat(held >= FREQUENT, held)
            if often.any():
                rows.append((chunk % buckets, chunk, OWN, packed(owner[often], value[often], often[often])))
            # one entry stands for a frequent shingle of this chunk
            lead = np.zeros(len(value), bool)
            lead[runs] = True
            keep = ~often | lead
            weight = np.where(often, np.uint32(FREQUENT), np.uint32(1))[keep].astype(np.uint32)
            value, owner = value[keep], np.where(often, np.uint32(0xFFFFFFFF), owner)[keep].astype(np.uint32)
            edges = np.searchsorted(value, np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)) if buckets > 1 else np.zeros(0, np.int64)
            for k, (lo, hi) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(value)])):
                if hi > lo:
                    rows.append((k, chunk, COUNT, squeeze(np.int64(hi - lo).tobytes() + planes(np.diff(value[lo:hi], prepend=np.uint64(0))) + planes(owner[lo:hi]) + planes(weight[lo:hi]))))
            for k in range(0, len(rows), 300):
                yield as_batch(rows[k : k + 300])

    return work


def as_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "chunk", "kind", "part"])


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts one bucket after another; tells each chunk which of its shingles are not unique, and which are frequent."""
    held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    at = None

    def done() -> Iterator[pa.RecordBatch]:
        value = np.concatenate([h[1] for h in held])
        owner = np.concatenate([h[2] for h in held])
        weight = np.concatenate([h[3] for h in held]).astype(np.int64)
        chunk = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        order = np.argsort(value, kind="stable")
        value, owner, weight, chunk = value[order], owner[order], weight[order], chunk[order]
        runs = starts_of(value)
        total = np.repeat(np.add.reduceat(weight, runs), np.diff(np.append(runs, len(value))))
        tell = (total > 1) & (owner != np.uint32(0xFFFFFFFF))
        value, owner, often, chunk = value[tell], owner[tell], (total[tell] >= FREQUENT), chunk[tell]
        order = np.argsort(chunk, kind="stable")
        value, owner, often, chunk = value[order], owner[order], often[order], chunk[order]
        first = starts_of(chunk)
        rows = []
        for lo, hi in zip(first, [*first[1:], len(chunk)]):
            rows.append((0, held[chunk[lo]][0], ANSWER, packed(owner[lo:hi], value[lo:hi], often[lo:hi])))
        for k in range(0, len(rows), 300):
            yield as_batch(rows[k : k + 300])

    for batch in batches:
        for bucket, chunk, kind, part in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "part"))):
            if kind != COUNT:
                yield as_batch([(bucket, chunk, kind, part)])
                continue
            if at is not None and bucket != at and held:
                yield from done()
                held = []
            at = bucket
            raw = expand(part)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            held.append((chunk, np.cumsum(joined(raw[8:], "<u8", n)), joined(raw[8 + 8 * n :], "<u4", n), joined(raw[8 + 12 * n :], "<u4", n)))
    if held:
        yield from done()


def index_keys(n: int, rare: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set of n shingles, of which these (each sorted by hash) are not unique in the corpus."""
    need, k = (percent * n + 99) // 100, GROUPS + 1
    keys = []
    if need < k:
        keys.append(mix(np.concatenate([rare, often]) ^ SALT[1]))
    left = n - need + k - (n - len(rare) - len(often))
    if left > 0:
        keys.append(mix(rare[:left] ^ SALT[2]))
        often = often[: max(0, left - len(rare))]
        for g in range(GROUPS):
            some = often[often % np.uint64(GROUPS) == g]
            a, b = np.triu_indices(len(some), 1)
            keys.append(mix(mix(some[a]) * SALT[0] + some[b]))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def build_sets(percent: int):
    """Reads rows sorted by chunk; gives each document's size, the shingles it may share, and its index keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            table = next(expand(p) for k, p in held if k == TABLE)
            n = int(np.frombuffer(table, np.int64, 1)[0])
            known = np.frombuffer(table, np.int64, n, 8)
            none = np.frombuffer(table, bool, n, 8 + 8 * n)
            size = np.frombuffer(table, np.int64, n, 8 + 9 * n)
            rep = np.frombuffer(table, np.int64, n, 8 + 17 * n)
            owners, values, oftens = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for kind, part in held:
                if kind == TABLE:
                    continue
                for got, more in zip((owners, values, oftens), unpacked(part)):
                    got.append(more)
            owner, value, often = np.concatenate(owners), np.concatenate(values), np.concatenate(oftens)
            order = np.lexsort((value, often, owner))
            owner, value, often = owner[order], value[order], often[order]
            edge = np.searchsorted(owner, np.arange(n + 1))
            out = []
            for k in range(n):
                doc, stand = None if none[k] else int(known[k]), None
                tokens = keys = low = high = None
                if rep[k] >= 0 and rep[k] != k:
                    stand = int(known[rep[k]])
                elif rep[k] == k:
                    v, o = value[edge[k] : edge[k + 1]], often[edge[k] : edge[k + 1]]
                    if len(v) * 100 >= percent * size[k]:
                        found = distinct(index_keys(int(size[k]), v[~o], v[o], percent))
                        if len(found):
                            tokens, keys = v.view(np.int64), found.view(np.int64)
                            low, high = parity(v)
                out.append((doc, int(size[k]), stand, tokens, keys, low, high))
                if len(out) == 500:
                    yield sets_batch(out)
                    out = []
            if out:
                yield sets_batch(out)

        for batch in batches:
            for chunk, kind, part in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "part"))):
                if at is not None and chunk != at:
                    yield from done()
                    held = []
                at = chunk
                held.append((kind, part))
        if held:
            yield from done()

    return work


def parity(values: np.ndarray) -> tuple[int, int]:
    """128 bits: whether an odd number of the hashes falls on each."""
    bits = np.bincount((values & np.uint64(127)).astype(np.int64), minlength=128) & 1
    low, high = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).tolist()
    return low, high


def sets_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_shingles", "rep", "tokens", "keys", "low", "high"])


def neighbours(percent: int):
    """Pairs of each row with the next two of its key; rows come sorted by key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((6, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([tail, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "n_shingles", "shareable", "low", "high")])], axis=1)
            found = []
            for gap in (1, 2):
                a, b = rows[:, :-gap], rows[:, gap:]
                new = b.shape[1] - batch.num_rows if b.shape[1] > batch.num_rows else 0  # pairs of the rows kept from before
                a, b = a[:, new:], b[:, new:]
                least, most = np.minimum(a[2], b[2]), np.maximum(a[2], b[2])
                differ = np.bitwise_count(a[4] ^ b[4]).astype(np.int64) + np.bitwise_count(a[5] ^ b[5])
                shared = np.minimum(2 * np.minimum(a[3], b[3]), a[3] + b[3] - differ)  # twice what they share at most
                ok = (a[0] == b[0]) & (a[1] != b[1]) & (least * 100 >= percent * most) & (shared * (100 + percent) >= 2 * percent * (a[2] + b[2]))
                found.append(np.stack([np.minimum(a[1], b[1])[ok], np.maximum(a[1], b[1])[ok]]))
            tail = rows[:, -2:]
            pairs = np.concatenate(found, axis=1)
            if pairs.shape[1]:
                order = np.lexsort((pairs[1], pairs[0]))
                pairs = pairs[:, order]
                pairs = pairs[:, np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0))]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return work


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, verified on the whole sets (unique shingles count in sizes only)."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    return both.where(shared * 100 >= (F.col("na") + F.col("nb") - shared) * percent).select("a", "b")


def similar_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``; sets link when 100 * shared >= percent * union."""
    parts = shuffle_parts(docs.sparkSession)
    buckets = buckets_for(docs, 4 << 20)
    sent = texts(docs).mapInArrow(frugal(cut_shingles(buckets, width)), ROW).repartition(parts, "bucket").sortWithinPartitions("bucket")
    told = sent.mapInArrow(frugal(answer), ROW).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
    every = cut(told.mapInArrow(frugal(build_sets(percent)), SET_ROW), "sets")
    sets = every.where("keys is not null").select("doc_id", "n_shingles", "tokens")
    posted = cut(every.where("keys is not null").select("doc_id", "n_shingles", F.size("tokens").cast("long").alias("shareable"), "low", "high", F.explode("keys").alias("key")), "set-keys")
    sketch = every.where("keys is not null").select("doc_id", "n_shingles", F.size("tokens").cast("long").alias("shareable"), "low", "high", F.explode(F.slice("keys", 1, LEAST_KEYS)).alias("key"))
    ordered = sketch.repartitionByRange(parts, F.col("key"), F.xxhash64("key", "doc_id")).sortWithinPartitions("key", F.xxhash64("key", "doc_id"))
    first = ordered.select("key", "doc_id", "n_shingles", "shareable", "low", "high").mapInArrow(frugal(neighbours(percent)), "a long, b long").distinct()
    links = cut(linked(first, sets, percent), "links-1")
    label = components(links)
    # what is left: candidates in different components; of a key's components the largest is matched by the others' members
    labelled = posted.join(label, posted["doc_id"] == label["node"], "left").select("key", "doc_id", "n_shingles", "shareable", "low", "high", F.coalesce("comp", "doc_id").alias("comp"))
    labelled = cut(labelled, "set-labels")
    main = labelled.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main")).where("comps > 1")
    hit = F.struct("key", (F.col("comp") != F.col("main")).alias("rest"))
    split = labelled.join(main.select("key", "main"), "key").groupBy("doc_id", "n_shingles", "shareable", "low", "high", "comp").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    split = split_table = cut(split.select("doc_id", "n_shingles", "shareable", "low", "high", "comp", F.col("hits.key").alias("keys"), F.col("hits.rest").alias("rests")), "set-split")
    forget(posted, labelled)
    # a pair comes from the first key that its sets share: at a later one both hold an earlier shared key among those just before
    one = F.transform("keys", lambda key, i: F.struct(key.alias("key"), F.get("rests", i).alias("rest"), F.slice("keys", F.greatest(i - EARLIER, F.lit(0)) + 1, F.least(i, F.lit(EARLIER))).alias("earlier")))
    split = split.select("doc_id", "n_shingles", "shareable", "low", "high", "comp", F.inline(one))
    rest = split.where("rest").select("key", F.col("doc_id").alias("x"), F.col("n_shingles").alias("nx"), F.col("shareable").alias("sx"), F.col("low").alias("lx"), F.col("high").alias("hx"), F.col("comp").alias("cx"), F.col("earlier").alias("ex"))
    differ = (F.bit_count(F.col("lx").bitwiseXOR(F.col("low"))) + F.bit_count(F.col("hx").bitwiseXOR(F.col("high")))).cast("long")
    shared = F.least(F.least("sx", "shareable") * 2, F.col("sx") + F.col("shareable") - differ)
    near = (F.col("cx") != F.col("comp")) & (F.least("nx", "n_shingles") * 100 >= F.greatest("nx", "n_shingles") * percent) & (shared * (100 + percent) >= (F.col("nx") + F.col("n_shingles")) * 2 * percent)
    once = (~F.col("rest") | (F.col("x") < F.col("doc_id"))) & ~F.arrays_overlap("ex", "earlier")
    second = rest.join(split, "key").where(near & once).select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()
    more = cut(linked(second, sets, percent), "links-2")
    final = components(links.union(more)) if more.limit(1).count() else label
    forget(links, more, split_table, *([label] if final is not label else []))
    node = F.coalesce("rep", "doc_id")
    out = every.select("doc_id", "n_shingles", node.alias("at")).join(final, F.col("at") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "at").alias("component_id"))
