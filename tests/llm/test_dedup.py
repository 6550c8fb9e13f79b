"""Exact dedup, repeated bytes and words, similar sets: against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairsight.llm import exact_dedup, substring_dedup, suffix_dedup
from pairsight.llm.common import sliding_min
from pairsight.llm.ngram_join import similar_components
from tests.llm.fixtures import as_dict, corpus, frame

SPACE = b" \t\n\x0b\x0c\r"


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("parts", [1, 5])
def test_exact_copies(spark, parts):
    rows = corpus()
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").encode().translate(None, SPACE)].append((-len(t or ""), float("inf") if d is None else d))
    got = as_dict(exact_dedup.exact_duplicates(frame(spark, rows, parts)), "keep_id", "group_size", "kept", "text_sha256")
    for d, t in rows:
        key = (t or "").encode().translate(None, SPACE)
        keep = min(groups[key])[1]
        assert got[d] == (None if keep == float("inf") else keep, len(groups[key]), keep == (float("inf") if d is None else d), sha(key))


def test_many_flushes_and_compaction(spark, monkeypatch):
    rng = random.Random(0)
    runs = []
    want = Counter()
    for _ in range(9):
        table = exact_dedup.Memtable(1)
        for _ in range(50):
            x = rng.randrange(60)
            want[x] += 1
            table.put(hashlib.sha256(bytes([x])).digest(), x, rng.randrange(10**6), bytes([x]))
        runs += [(np.frombuffer(r, exact_dedup.RECORD), exact_dedup.Filter(np.frombuffer(f, np.uint8))) for _, r, f in table.flush()]
    merged, hits, _ = exact_dedup.compact(runs)
    assert sorted(merged["count"]) == sorted(want.values()) and list(merged["digest"]) == sorted(merged["digest"])
    in_runs = Counter(d for run, _ in runs for d in exact_dedup.fixed(run["digest"]))
    assert set(exact_dedup.fixed(hits)) == {d for d, n in in_runs.items() if n > 1}


def test_collision_is_seen():
    table = exact_dedup.Memtable(1)
    table.put(b"d" * 32, 1, 1, b"a")
    with pytest.raises(exact_dedup.DigestCollision):
        table.put(b"d" * 32, 1, 2, b"b")


def test_empty_tables(spark):
    empty = frame(spark, []).limit(0)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert substring_dedup.without_repeated_words(empty).count() == 0
    assert suffix_dedup.without_repeated_bytes(empty).count() == 0
    assert similar_components(empty).count() == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 2, 7, 185, 500):
        assert (sliding_min(x, w) == [x[k : k + w].min() for k in range(len(x) - w + 1)]).all()


def brute_words(rows, width):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if d is not None and first[tuple(w[k : k + width])] < d:
                gone |= set(range(k, k + width))
        out[d] = (len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("width, parts", [(13, 1), (13, 4), (3, 2)])
def test_repeated_words(spark, width, parts):
    rows = corpus()
    assert as_dict(substring_dedup.without_repeated_words(frame(spark, rows, parts), width), "n_words", "n_removed", "kept_sha256") == brute_words(rows, width)


def brute_bytes(rows, width):
    count = Counter()
    for d, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + width] for k in range(len(b) - width + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if d is not None and count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        out[d] = (len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("width, parts", [(200, 1), (200, 4), (40, 2)])
def test_repeated_bytes(spark, width, parts):
    rows = corpus()
    assert as_dict(suffix_dedup.without_repeated_bytes(frame(spark, rows, parts), width), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, width)


def test_long_documents_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(1)
    block = "".join(rng.choice("abcd ") for _ in range(3000))
    rows = [(1, "".join(rng.choice("abcd ") for _ in range(40_000)) + block), (2, "q" + block + "w")]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)
    out = [b for b in suffix_dedup.cut_bytes(4, 200)(iter([as_batch(rows)]))]
    assert sum(b.num_rows for b in out) > 0
    monkeypatch.undo()
    assert as_dict(suffix_dedup.without_repeated_bytes(frame(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 200)


def as_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t.encode() for _, t in rows], pa.binary())], names=["doc_id", "text"])


def test_cover_offsets_meet():
    inside = set(suffix_dedup.COVER)
    for x in range(suffix_dedup.PERIOD):
        for y in range(suffix_dedup.PERIOD):
            k = int(suffix_dedup.OFFSETS[x, y])
            assert (x + k) % suffix_dedup.PERIOD in inside and (y + k) % suffix_dedup.PERIOD in inside


@pytest.mark.parametrize("letters, width, block", [(2, 70, 64), (3, 200, 1 << 18), (1, 90, 100), (2, 40, 64)])
def test_blocks_sort_suffixes(monkeypatch, letters, width, block):
    """Ranks order the sample's suffixes, ties come out in the order of their suffixes, and neighbours tell what is repeated."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(letters)
    base = bytes(rng.choice(b"ab\0"[:letters]) for _ in range(500))
    texts = list({base[x : x + rng.randrange(width, 400)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) for x in (rng.randrange(200) for _ in range(40))})
    anchors = np.array([rng.randrange(50) for _ in texts])
    count = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    want = {(n, k) for n, t in enumerate(texts) for k in range(len(t) - width + 1) if count[t[k : k + width]] > 1}
    own, unit = suffix_dedup.repeated_places(texts, anchors, width)
    assert set(zip(own.tolist(), unit.tolist())) == want
    size = np.array([len(t) for t in texts])
    lead = -anchors % 64
    blocks = -(-(lead + size) // 64)
    start = (np.cumsum(blocks) - blocks) * 64 + lead
    data = np.zeros(int(blocks.sum()) * 64 + 128 + width, np.uint8)
    for s, t in zip(start, texts):
        data[s : s + len(t)] = np.frombuffer(t, np.uint8)
    eights = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    rank = suffix_dedup.sample_ranks(eights, np.repeat(np.arange(len(texts)), blocks), start, start + size)
    sample = [(t[k:], int(rank[suffix_dedup.sample_number(np.array([s + k]))[0]])) for s, t in zip(start, texts) for k in range(len(t)) if (s + k) % 64 in suffix_dedup.COVER]
    assert [r for _, r in sorted(sample)] == sorted(r for _, r in sample) and len({x for x, _ in sample}) == len({r for _, r in sample})
    if width > 64:
        places = np.concatenate([np.arange(s, s + max(0, len(t) - width + 1)) for s, t in zip(start, texts)])
        x, group = suffix_dedup.sorted_ties(data, eights, places, rank, width)
        text_at = lambda p: (n := int(np.searchsorted(start, p, "right")) - 1, texts[n][p - start[n] :])[1]
        got = [text_at(p) for p in x]
        assert got == sorted(got)


def brute_components(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = [d for d in sets if d is not None]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), None if d is None else find(d)) for d, s in sets.items()}


def near_rows(seed=5):
    """Groups of near copies around a base, changed in a few words each, so that links form chains."""
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([2, 5, 40])):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(4000)}"
            rows.append((len(rows), " ".join(words + ["all rights are reserved by the owner"] * (g % 2))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("rows", [corpus(), near_rows(), near_rows(6)])
def test_components(spark, rows, width, percent, monkeypatch):
    got = as_dict(similar_components(frame(spark, rows), width, percent), "n_shingles", "component_id")
    assert got == brute_components(rows, width, percent)
