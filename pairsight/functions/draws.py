"""Draws from MD5 in blocks of NumPy integers: what ``md5(concat(seed, '|', rep, '|', place))`` gives in SQL, many at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Draws hashed at once (the buffers stay in a core's cache), and cells of the table that tells a place's interval.
BLOCK, CELLS = 1 << 14, 1 << 16
SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
SINES = [int(abs(np.sin(k + 1.0)) * 4294967296.0) & 0xFFFFFFFF for k in range(64)]
START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
ORDERS = (1, 0), (5, 1), (3, 5), (7, 0)

Word = np.ndarray | int


def words_of(numbers: np.ndarray, digits: int, at: int) -> dict[int, np.ndarray]:
    """The message's 32-bit words that ASCII numbers of so many digits have a part in from byte ``at`` on."""
    words: dict[int, np.ndarray] = {}
    rest = numbers.astype(np.uint64)
    for k in range(at + digits - 1, at - 1, -1):
        tens = rest // np.uint64(10)
        byte = (rest - tens * np.uint64(10)).astype(np.uint32) + np.uint32(48)
        words[k // 4] = words.get(k // 4, np.uint32(0)) | byte << np.uint32(8 * (k % 4))
        rest = tens
    return words


def spans(low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(first, end, digits): the numbers from low to below high, apart by how many digits they have."""
    while low < high:
        digits = len(str(low))
        end = min(high, 10**digits)
        yield low, end, digits
        low = end


def first_words(message: list[Word], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The digest's first two words for messages of one block; a word is one number for all or an array that broadcasts."""
    a, b, c, d, t, u = (np.empty(shape, np.uint32) for _ in range(6))
    for x, value in zip((a, b, c, d), START):
        x.fill(value)
    for k in range(64):
        turn = k // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif turn == 1:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif turn == 2:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(a, t, out=a)
        step, first = ORDERS[turn]
        word = message[(step * k + first) % 16]
        if isinstance(word, int):
            np.add(a, np.uint32((word + SINES[k]) & 0xFFFFFFFF), out=a)
        else:
            np.add(a, word, out=a)
            np.add(a, np.uint32(SINES[k]), out=a)
        s = SHIFTS[turn][k % 4]
        np.left_shift(a, np.uint32(s), out=u)
        np.right_shift(a, np.uint32(32 - s), out=a)
        np.bitwise_or(a, u, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    np.add(a, np.uint32(START[0]), out=a)
    np.add(b, np.uint32(START[1]), out=b)
    return a, b


def hashed(seed: int, reps: tuple[int, int], places: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(first replicate, numbers of 60 bits by replicate and place): the digest's first 15 hex digits of ``seed|rep|place``, each pair once, in blocks."""
    head = f"{seed}|".encode()
    for r0, r1, rep_digits in spans(*reps):
        at = len(head) + rep_digits + 1
        for j0, j1, digits in spans(*places):
            size = at + digits
            if size > 55:
                raise ValueError(f"a message of {size} bytes does not fit one block of MD5")
            fixed = [0] * 16
            for k, byte in [*enumerate(head), (at - 1, ord("|")), (size, 0x80)]:
                fixed[k // 4] |= byte << 8 * (k % 4)
            fixed[14] = 8 * size
            wide = min(j1 - j0, BLOCK)
            tall = max(1, BLOCK // wide)
            for j in range(j0, j1, wide):
                by_place = words_of(np.arange(j, min(j + wide, j1)), digits, at)
                for r in range(r0, r1, tall):
                    by_rep = words_of(np.arange(r, min(r + tall, r1)), rep_digits, len(head))
                    message: list[Word] = list(fixed)
                    for k in by_rep.keys() | by_place.keys():
                        word = np.array([[fixed[k]]], np.uint32)
                        if k in by_rep:
                            word = word | by_rep[k][:, None]
                        if k in by_place:
                            word = word | by_place[k][None, :]
                        message[k] = word if word.size > 1 else int(word[0, 0])
                    shape = min(tall, r1 - r), min(wide, j1 - j)
                    a, b = first_words(message, shape)
                    yield r, (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> np.uint32(4))


def sums(seed: int, n: int, reps: tuple[int, int], places: tuple[int, int], edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """By group and replicate, the sum of the values drawn at these places.

    A draw is a place among ``n`` sorted items. edges: by group, where each value but the first begins; values: all of them.
    Groups of equal n share their draws, so each is hashed once.
    """
    cuts = np.unique(edges[(edges > 0) & (edges < n)]).astype(np.int64)
    starts = np.concatenate([[0], cuts])
    worth = np.array([values[np.searchsorted(e, starts, "right")] for e in edges], np.int64)  # by group and interval
    shift = max(0, int(n - 1).bit_length() - (CELLS.bit_length() - 1))
    cells = np.arange(0, (n - 1 >> shift) + 1, dtype=np.int64) << shift
    table = np.searchsorted(cuts, cells, "right")
    mixed = table != np.searchsorted(cuts, np.minimum(cells + (1 << shift), n) - 1, "right")
    bins = len(starts)
    table[mixed] = bins
    found = np.zeros((reps[1] - reps[0], bins), np.int64)
    size = np.uint64(n)
    for r, number in hashed(seed, reps, places):
        at = (number - number // size * size).astype(np.int64)
        inside = table[at >> shift]
        if mixed.any() and (open_ := inside == bins).any():
            inside[open_] = np.searchsorted(cuts, at[open_], "right")
        tall = len(inside)
        inside += (np.arange(tall) * bins)[:, None]
        found[r - reps[0] : r - reps[0] + tall] += np.bincount(inside.ravel(), minlength=tall * bins).reshape(tall, bins)
    return worth @ found.T
