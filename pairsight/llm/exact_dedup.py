"""Exact duplicates through a log-structured merge index.

Every task keeps a memtable (digest -> best row, count, representative). A hit in the
memtable is verified byte for byte against the representative's text at once. A full
memtable is flushed as one sorted run per bucket, each with a Bloom filter. Compaction
merges a bucket's runs tier by tier and keeps the best row of each digest; digests in
several runs (cross-run hits) have the runs' representatives compared byte for byte in
a later step. A group of copies therefore sends one record per memtable, not one per row.

Defined results: null text is empty text, and all empty texts are one group; of equal
texts the row with most code points, then the smallest doc_id stays; a null doc_id loses
against any other; rows that repeat a (doc_id, text) get the same answer; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.llm.common import SPACES, cut, frugal, mix, shuffle_parts, starts_of, texts

#: Stands for a null doc_id inside the index: larger than any other.
NO_ID = np.iinfo(np.int64).max
RECORD = np.dtype([("digest", "S32"), ("points", "<i8"), ("doc", "<i8"), ("count", "<i8"), ("rep", "<i8")])
FLUSH_BYTES = 24 << 20
FLUSH_ROWS = 100_000
FILTER_BITS = 10
#: So many rows of a digest and an id are broadcast at most.
BROADCAST_REPS = 200_000
SCHEMA_ROWS = "doc_id long, digest binary, bucket int, run binary, filter binary"


class DigestCollision(RuntimeError):
    """Two different texts have one digest."""


def normal(body: bytes) -> bytes:
    return body.translate(None, SPACES)


def words_of(digests: np.ndarray) -> np.ndarray:
    """The first 16 bytes of each digest as two 64-bit words."""
    return np.ascontiguousarray(digests).view(np.uint8).reshape(len(digests), 32)[:, :16].copy().view("<u8")


class Filter:
    """A Bloom filter over digests: three probes, ``FILTER_BITS`` bits a digest."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def over(cls, digests: np.ndarray) -> Filter:
        bits = np.zeros(max(8, len(digests) * FILTER_BITS // 8 + 1), np.uint8)
        made = cls(bits)
        for at in made.places(digests):
            np.bitwise_or.at(bits, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        return made

    def places(self, digests: np.ndarray) -> list[np.ndarray]:
        pair, size = words_of(digests), np.uint64(len(self.bits) * 8)
        return [mix(pair[:, 0] + np.uint64(k) * pair[:, 1]) % size for k in range(3)]

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        found = np.ones(len(digests), bool)
        for at in self.places(digests):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def best_of(records: np.ndarray) -> np.ndarray:
    """One record for each digest: most code points, then the smallest id; counts are added."""
    order = np.lexsort((records["doc"], -records["points"], records["digest"]))
    records = records[order]
    first = starts_of(records["digest"])
    kept = records[first]
    if len(records):
        kept["count"] = np.add.reduceat(records["count"], first)
    return kept


class Memtable:
    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.held: dict[bytes, list] = {}
        self.bytes = 0

    def put(self, digest: bytes, points: int, doc: int, text: bytes) -> None:
        found = self.held.get(digest)
        if found is None:
            self.held[digest] = [points, doc, 1, doc, text]
            self.bytes += len(text) + 200
            return
        if found[4] != text:
            raise DigestCollision(digest.hex())
        found[2] += 1
        if (-points, doc) < (-found[0], found[1]):
            found[0], found[1] = points, doc

    def full(self) -> bool:
        return self.bytes >= FLUSH_BYTES or len(self.held) >= FLUSH_ROWS

    def flush(self) -> Iterator[tuple[int, bytes, bytes]]:
        """A sorted run and its filter for each bucket that has records."""
        run = np.array([(d, *row[:4]) for d, row in self.held.items()], RECORD)
        run.sort(order="digest")
        bucket = (mix(words_of(run["digest"])[:, 0]) % np.uint64(self.buckets)).astype(np.int64) if len(run) else []
        order = np.argsort(bucket, kind="stable")
        run, bucket = run[order], np.asarray(bucket)[order]
        for lo, hi in zip(first := starts_of(bucket), [*first[1:], len(run)]):
            yield int(bucket[lo]), run[lo:hi].tobytes(), Filter.over(run["digest"][lo:hi]).bits.tobytes()
        self.clear()


def compact(runs: list[tuple[np.ndarray, Filter]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged records; digest and representative for every record of a digest that several runs hold."""
    hit_digests, hit_reps = [], []
    level: dict[int, tuple[np.ndarray, Filter]] = {}
    for run in runs:
        tier = 0
        while tier in level:  # two runs of a tier become one of the next
            older, newer = level.pop(tier), run
            likely = newer[0][older[1].may_hold(newer[0]["digest"])]
            at = np.searchsorted(older[0]["digest"], likely["digest"])
            at = np.minimum(at, len(older[0]) - 1)
            same = older[0]["digest"][at] == likely["digest"]
            for part in (likely[same], older[0][at[same]]):
                hit_digests.append(part["digest"])
                hit_reps.append(part["rep"])
            merged = best_of(np.concatenate([older[0], newer[0]]))
            run = (merged, Filter.over(merged["digest"]))
            tier += 1
        level[tier] = run
    rest = [level[t] for t in sorted(level)]
    while len(rest) > 1:
        a, b = rest.pop(0), rest.pop(0)
        likely = a[0][b[1].may_hold(a[0]["digest"])]
        at = np.minimum(np.searchsorted(b[0]["digest"], likely["digest"]), len(b[0]) - 1)
        same = b[0]["digest"][at] == likely["digest"]
        for part in (likely[same], b[0][at[same]]):
            hit_digests.append(part["digest"])
            hit_reps.append(part["rep"])
        merged = best_of(np.concatenate([a[0], b[0]]))
        rest.insert(0, (merged, Filter.over(merged["digest"])))
    none = np.zeros(0, RECORD)
    return (rest[0][0] if rest else none), np.concatenate([none["digest"], *hit_digests]), np.concatenate([none["rep"], *hit_reps])


def fixed(digests: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(digests).tobytes()
    return [raw[k : k + 32] for k in range(0, len(raw), 32)]


def index_rows(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Memtable(buckets)

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = list(table.flush()) if table.held else []
            if rows:
                none = [None] * len(rows)
                bucket, run, bloom = zip(*rows)
                yield batch_of(none, none, bucket, run, bloom)

        def batch_of(docs, digests, bucket, run, bloom) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((docs, digests, bucket, run, bloom), kinds)], names=["doc_id", "digest", "bucket", "run", "filter"])

        for batch in batches:
            docs, bodies = batch.column("doc_id").to_pylist(), batch.column("text")
            points = pc.utf8_length(bodies.cast(pa.string())).to_pylist()
            digests = []
            for doc, body, n in zip(docs, bodies.to_pylist(), points):
                text = normal(body)
                digests.append(hashlib.sha256(text).digest())
                table.put(digests[-1], n, NO_ID if doc is None else doc, text)
                if table.full():
                    yield from flushed()
            none = [None] * len(docs)
            yield batch_of(docs, digests, none, none, none)
        yield from flushed()

    return work


def merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compacts one bucket after another; rows come sorted by bucket."""
    held: list[tuple[np.ndarray, Filter]] = []
    at = None

    def done() -> pa.RecordBatch:
        records, hits, reps = compact(held)
        pairs: dict[bytes, set] = {}
        for digest, rep in zip(fixed(hits), reps.tolist()):
            pairs.setdefault(digest, set()).add(rep)
        digests = fixed(records["digest"])
        return pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(records["doc"], pa.int64()), pa.array(records["count"], pa.int64()), pa.array([sorted(pairs[d]) if d in pairs else None for d in digests], pa.list_(pa.int64()))],
            names=["digest", "keep_id", "group_size", "reps"],
        )

    for batch in batches:
        for bucket, run, bloom in zip(*(batch.column(c).to_pylist() for c in ("bucket", "run", "filter"))):
            if at is not None and bucket != at:
                yield done()
                held = []
            at = bucket
            held.append((np.frombuffer(run, RECORD), Filter(np.frombuffer(bloom, np.uint8))))
    if held:
        yield done()


def verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares texts of one digest, which come one after another; a difference ends the job."""
    seen, kept, count = None, b"", 0
    out: list[tuple[bytes, int]] = []
    for batch in batches:
        for digest, body in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
            text = normal(body)
            if hashlib.sha256(text).digest() != digest:  # another row with the same doc_id
                continue
            if digest != seen:
                if seen is not None:
                    out.append((seen, count))
                seen, kept, count = digest, text, 0
            elif text != kept:
                raise DigestCollision(digest.hex())
            count += 1
    if seen is not None:
        out.append((seen, count))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64())], names=["digest", "verified_runs"])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, verified_runs: one row for each row of ``docs``.

    ``verified_runs``: how many representatives of the group from different runs were
    compared byte for byte (0 where one memtable held the whole group and compared it).
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    body = texts(docs)
    rows = cut(body.mapInArrow(frugal(index_rows(4 * parts)), SCHEMA_ROWS), "dedup-runs")
    runs = rows.where("run is not null").select("bucket", "run", "filter").repartition(parts, "bucket").sortWithinPartitions("bucket")
    groups = cut(runs.mapInArrow(frugal(merge_rows), "digest binary, keep_id long, group_size long, reps array<long>"), "dedup-groups")
    reps = groups.where("reps is not null").select("digest", F.explode("reps").alias("doc_id"))
    # few documents stand for groups that several runs hold: the others' texts are not dealt where these can be broadcast
    small = groups.agg(F.sum(F.array_size("reps"))).first()[0] or 0
    met = body.join(F.broadcast(reps) if small <= BROADCAST_REPS else reps, "doc_id").select("digest", "text").repartition(parts, "digest").sortWithinPartitions("digest")
    verified = met.mapInArrow(frugal(verify_rows), "digest binary, verified_runs long")
    settled = cut(groups.drop("reps").join(verified, "digest", "left"), "dedup-settled")
    each = rows.where("run is null").select("doc_id", "digest")
    keep = F.when(F.col("keep_id") != F.lit(int(NO_ID)), F.col("keep_id"))
    return each.join(settled, "digest").select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        F.coalesce(F.col("doc_id"), F.lit(int(NO_ID))).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.coalesce("verified_runs", F.lit(0)).cast("long").alias("verified_runs"),
    )
